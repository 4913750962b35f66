"""MLlib models: what a training task holds is bounded."""

from pyspark.sql import functions as F

from riskframe.operators import model as L


def test_training_partitions_are_bounded(spark, monkeypatch):
    """A table in one part is dealt by its rows; a small one stays as it lies."""
    df = spark.range(0, 4_000, 1, 1)
    many = L.dealt(df, 100)
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 120 and sum(sizes) == 4_000
    assert L.dealt(df, 4_000) is df

    asked = []
    real = L.dealt
    monkeypatch.setattr(L, "PARTITION_ROWS", 100)
    monkeypatch.setattr(L, "dealt", lambda t: asked.append(real(t)) or asked[-1])
    rows = df.select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("flag"),
                     F.lit(1.0).alias("weight"), (F.col("id") % 3).cast("int").alias("fold"))
    L.train_gbt(rows, ["a"], max_iter=1, max_depth=2)
    L.tune(rows, ["a"], n_iter=1, grid={"maxIter": [1], "maxDepth": [2], "stepSize": [0.1],
                                                  "minInstancesPerNode": [1], "subsamplingRate": [0.8]})
    assert [t.rdd.getNumPartitions() for t in asked] == [max(40, spark.sparkContext.defaultParallelism)] * 2


def test_tune_searches_the_whole_grid(spark, monkeypatch):
    """The registered search draws as many settings, from the same values, as the
    original; its table names every value drawn."""
    from types import SimpleNamespace

    from riskframe.plans import q_model as Q
    rows = spark.range(0, 60, 1, 1).select(
        F.col("id").alias(Q.SPEC.entity_key), (F.col("id") % 2).cast("int").alias(Q.SPEC.label),
        F.rand(1).alias("a"), F.lit(1.0).alias("weight"), F.lit("train").alias("split"))
    asked = {}
    monkeypatch.setattr(Q, "prepared", lambda *_: SimpleNamespace(table=rows, feature_names=["a"]))
    monkeypatch.setattr(L, "tune", lambda train, *_, **more: asked.update(more, folds=train.select("fold").distinct().count())
                        or (None, "rows"))
    assert Q.q_tune(spark, "") == "rows" and asked["n_iter"] == 30 and asked["folds"] == 5
    grid = asked["grid"]
    assert [len(v) for v in grid.values()] == [4, 5, 4, 4, 4, 4] and max(grid["maxIter"]) == 500
    assert len(L.sample_grid(L.gbt(), asked["n_iter"], Q.SPEC.seed, grid)) == 30

    monkeypatch.undo()
    folds = rows.withColumn("fold", (F.col(Q.SPEC.entity_key) % 3).cast("int"))
    one = {"maxIter": [1], "maxDepth": [2], "featureSubsetStrategy": ["0.7"]}
    got = L.tune(folds, ["a"], Q.SPEC.label, grid=one)[1].collect()
    assert [(r.maxIter, r.maxDepth, r.stepSize, r.featureSubsetStrategy) for r in got] == [(1, 2, 0.1, "0.7")]
