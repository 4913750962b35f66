"""Direct checks of shape / profile operators on inline frames."""

from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators import quality as Q
from riskframe.operators import shape as SH
from riskframe.sources.readers import union_sources


def test_flag_join_keeps_cardinality_with_duplicate_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    out = SH.flag_join(left, keys, "k", "hit")
    assert sorted((r.k, r.hit) for r in out.collect()) == [(1, 1), (2, 0), (3, 1)]


def test_lookup_items_case_insensitive_and_null_label(spark):
    d = spark.createDataFrame([(1, "Red WIDGET"), (2, None), (3, "gear box"), (4, "bolt")],
                              "id long, label string")
    got = sorted((r.term, r.id) for r in SH.lookup_items(d, "label", ["widget", "gear"], "id").collect())
    assert got == [("gear", 3), ("widget", 1)]


def test_histogram_last_bin_closed_and_dense(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (10.0, 1), (5.0, 1)], "x double, y int")
    h = P.histogram_by_class(df, "x", "y", 5)
    rows = {(r.bin, r.y): r["count"] for r in h.collect()}
    assert len(rows) == 10                                 # 5 bins x 2 classes, empty ones included
    assert rows[(4, 1)] == 1 and rows[(0, 0)] == 2 and rows[(2, 1)] == 1


def test_missingness_order_and_group_compare_sort(spark):
    df = spark.createDataFrame([(None, 1.0, 0, 1.0), (None, None, 1, 5.0), (1.0, 2.0, 1, 3.0)],
                               "a double, b double, y int, c double")
    m = [(r.column, round(r.missing_pct, 4)) for r in P.missingness(df).collect()]
    assert m == [("a", 66.6667), ("b", 33.3333)]
    asc = [r.column for r in P.missingness(df, ascending=True).collect()]
    assert asc == ["b", "a"]
    g = [r.feature for r in P.group_compare(df, "y", ["b", "c"]).collect()]
    assert g == ["c", "b"]                                  # |delta| 3 vs 1


def test_union_sources_missing_columns_become_null(spark):
    a = spark.createDataFrame([(1, "x")], "k long, s string")
    b = spark.createDataFrame([(2,)], "k long")
    got = sorted((r.k, r.s) for r in union_sources([a, b]).collect())
    assert got == [(1, "x"), (2, None)]


def test_head_tail_and_dedup(spark):
    df = spark.range(20).select((F.col("id") % 10).alias("k"))
    assert [r.k for r in Q.head_n(df, ["k"], 3).collect()] == [0, 0, 1]
    assert [r.k for r in Q.tail_n(df, ["k"], 3).collect()] == [9, 9, 8]
    assert Q.dedup_rows(df).count() == 10


def test_out_of_range_only_positive(spark):
    df = spark.createDataFrame([(0.1, 5.0), (9.0, 6.0), (None, 7.0)], "a double, b double")
    got = [(r.column, r.n_out) for r in Q.out_of_range(df, [("a", 0.5, 7.0), ("b", 0.0, 10.0)]).collect()]
    assert got == [("a", 2)]


def test_clean_log_counts(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "x double, g string")
    out, log = Q.clean(df, ["dropna", "dedup"])
    assert [(r.step, r.rows) for r in log.orderBy("seq").collect()] == [("input", 3), ("dropna", 2), ("dedup", 1)]
    assert out.count() == 1


def test_observed_counts_without_extra_job(spark):
    df = spark.range(100).where(F.col("id") % 3 == 0)
    obs_df, obs = P.with_observed_counts(df, "kept")
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 34


def test_describe_methods_agree(spark):
    df = spark.range(500).select((F.col("id") % 37 * 1.5).alias("x"))
    a = P.describe_numeric(df, ["x"], method="bounded").first()
    b = P.describe_numeric(df, ["x"], method="inmemory").first()
    assert (a.q25, a.q50, a.q75) == (b.q25, b.q50, b.q75)


def test_distinct_counts_without_expand(spark):
    from riskframe.operators import profile as P
    rows = [(i % 7, float(i % 3) if i % 4 else None, None, "x" if i % 2 else "y", -0.0 if i % 2 else 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b double, c string, `d e` string, z double").repartition(6)
    counts = P.distinct_counts(df, df.columns)
    assert {r["column"]: r["distinct"] for r in counts.collect()} == {"a": 7, "b": 3, "c": 0, "d e": 2, "z": 1}
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {r["distinct"] for r in P.distinct_counts(df.where("a < 0"), df.columns).collect()} == {0}
    many = spark.range(200_000).select((F.col("id") % 150_001).alias("u"))
    assert P.distinct_counts(many, ["u"]).first()["distinct"] == 150_001


def test_correlation_of_a_wide_table_equals_pandas(spark):
    import numpy as np
    import pandas as pd
    from riskframe.operators import profile as P
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 150)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4], x[:, 5] = 7.25, np.nan, x[:, 6] * 2
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(150)])
    df = spark.createDataFrame(pdf).repartition(4)
    got = {(r.col_a, r.col_b): r["corr"] for r in P.correlation_matrix(df, df.columns).collect()}
    want = pdf.corr()
    assert len(got) == 150 * 150 and got["c3", "c7"] is None and got["c4", "c4"] is None and got["c9", "c9"] == 1.0
    for (a, b), v in got.items():
        w = want.loc[a, b] if "c3" not in (a, b) else np.nan
        assert (v is None and np.isnan(w)) or abs(v - w) < 1e-8, (a, b, v, w)
    assert P.correlation_matrix(df, []).count() == 0
    assert {r["corr"] for r in P.correlation_matrix(df.where("c0 < 0"), ["c0", "c1"]).collect()} == {None}
