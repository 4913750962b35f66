"""Split / folds: exact, stratified, independent of partitioning."""

from pyspark.sql import functions as F

from riskframe.operators import features as M


def _frame(spark, n=3000, parts=1):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 13 == 0).cast("int").alias("y"))
    return df.repartition(parts)


def test_split_is_exact_and_partition_independent(spark):
    a = M.stratified_split(_frame(spark, parts=1), "y", "k", 0.2, 42)
    b = M.stratified_split(_frame(spark, parts=7), "y", "k", 0.2, 42)
    ka = {r.k: r.split for r in a.collect()}
    kb = {r.k: r.split for r in b.collect()}
    assert ka == kb
    counts = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    n1 = sum(1 for i in range(3000) if i % 13 == 0)
    assert counts[(1, "test")] == round(0.2 * n1)
    assert counts[(0, "test")] == round(0.2 * (3000 - n1))


def test_split_equals_single_window(spark):
    from pyspark.sql import Window
    df = _frame(spark, parts=3)
    h = M.hash_of("k", 42)
    w = Window.partitionBy("y").orderBy(h, "k")
    ref = df.withColumn("rn", F.row_number().over(w)) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("y"))) \
        .select("k", F.when(F.col("rn") <= F.round(F.col("n") * 0.2), "test").otherwise("train").alias("s"))
    got = M.stratified_split(df, "y", "k", 0.2, 42).select("k", F.col("split").alias("s"))
    assert ref.exceptAll(got).count() == 0 and got.exceptAll(ref).count() == 0


def test_folds_balanced(spark):
    f = M.stratified_folds(_frame(spark, parts=4), "y", "k", 5, 42)
    per = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [per[(y, i)] for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_routing_boundary_half_imputes(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0), (None, None)], "a double, b double")
    imp, pas = M.route_lists(df, ["a", "b"], 0.5)
    assert imp == ["a"] and pas == ["b"]


def test_preprocessor_roundtrip(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "x", 0), (3.0, None, 1), (None, "y", 0)], "v double, c string, b int")
    pre = M.fit_preprocessor(train, ["v"], ["c"], [], ["b"])
    assert pre.feature_names == ["v", "c_None", "c_x", "c_y", "b"]
    out = pre.transform(train).collect()
    # median 2, mean of imputed [1,3,2] = 2, population sd = sqrt(2/3)
    assert abs(out[0].v + 1.224744871) < 1e-6 and out[2].v == 0.0
    assert [r.c_None for r in out] == [0.0, 1.0, 0.0]
    pre.save(str(tmp_path / "pre"))
    again = M.Preprocessor.load(spark, str(tmp_path / "pre"))
    assert [tuple(r) for r in again.transform(train).collect()] == [tuple(r) for r in out]


def test_clinical_spec_engineering(spark):
    """The original clinical schema runs through the same operators."""
    from riskframe.spec import clinical_spec
    spec = clinical_spec()
    cols = ("hadm_id long, subject_id long, pi_flag int, age double, los_days double, albumin double, "
            "hemoglobin double, creatinine double, white_blood_cells double, platelet_count double, "
            "braden_sensory_perception double, braden_moisture double, braden_activity double, "
            "braden_mobility double, braden_nutrition double, braden_friction_shear double, "
            "gender string, race string, insurance string, icu_flag int")
    rows = [(1, 1, 1, 80.0, 10.0, 2.0, 9.0, 1.0, 8.0, 200.0, 2.0, 2.0, 1.0, 2.0, 3.0, 1.0, "F", "W", None, 1),
            (2, 2, 0, 40.0, 400.0, None, 12.0, 1.0, 8.0, 250.0, None, None, None, None, None, None,
             "M", "B", "Medicare", 0)]
    df = spark.createDataFrame(rows, cols)
    w, num, cat, binary = M.engineer(df, spec)
    r = {x.hadm_id: x for x in w.collect()}
    assert r[1].braden_total == 11.0 and r[2].braden_total is None
    assert r[1].age_over_75 == 1 and r[2].los_days is None          # 400 days is outside [0, 365]
    assert r[1].albumin_low == 1 and r[2].albumin_missing == 1
    assert num[-1] == "braden_total" and cat == ["gender", "race", "insurance"]
    assert binary[:6] == ["icu_flag", "age_over_75", "los_over_7", "los_over_14", "albumin_low",
                          "hemoglobin_low"]


def test_split_ranks_only_the_boundary(spark):
    """Ties of the key, a NULL class, tiny classes; rows of the input are not shuffled."""
    rows = [(i, i % 2 if i % 50 else None) for i in range(1000)] + [(2000, 7), (2001, 8), (2002, 8), (2003, 8)]
    df = spark.createDataFrame(rows, "k long, y int").repartition(3)
    from pyspark.sql import Window
    h = M.hash_of("k", 42)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy(h, "k"))) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("y"))) \
        .select("k", F.when(F.col("rn") <= F.round(F.col("n") * 0.2), "test").otherwise("train").alias("s"))
    out = M.stratified_split(df, "y", "k", 0.2, 42)
    assert out.columns == ["k", "y", "split"]
    got = out.select("k", F.col("split").alias("s"))
    assert ref.exceptAll(got).isEmpty() and got.exceptAll(ref).isEmpty()
    for share, side in ((0.0, "train"), (1.0, "test")):
        assert {r.split for r in M.stratified_split(df, "y", "k", share, 42).collect()} == {side}
    assert M.stratified_split(df.where("k < 0"), "y", "k").count() == 0


def test_split_does_not_bring_a_class_to_one_task(spark):
    """The rows are joined with the last test row of their class where they are."""
    df = spark.range(0, 4000, 1, 8).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = M.stratified_split(df.union(df.where("k < 0")), "y", "k", 0.2, 42)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert out.where("split = 'test'").count() == 800
