"""Exact quantiles equal Spark's in-memory ``percentile`` at the settings every
query uses: many distinct values, ties, a value holding a third of the rows,
NULLs."""

from pyspark.sql import functions as F

from riskframe.operators.quantiles import exact_quantiles, exact_quantiles_long

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(df):
    got = exact_quantiles(df, df.columns, PROBS)
    ref = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in PROBS])).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert got[c] == list(ref[c]), c


def test_quantiles_match_percentile(spark):
    check(spark.range(30000).select(
        ((F.col("id") * 7919) % 1000 / 10.0).alias("ties"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.sin(F.col("id")) * 100).alias("hot"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.cos(F.col("id"))).alias("nulls")))


def test_more_than_a_million_distinct_values(spark):
    check(spark.range(0, 1_500_000, 1, 8).select(F.rand(3).alias("x")))


def test_grouped_and_empty(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"),
                                  (F.col("id") * 1.5).alias("v"))
    got = exact_quantiles_long(df, "g", "v", [0.5])
    ref = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {k: v[0] for k, v in got.items()} == ref
    empty = spark.range(5).select(F.lit(None).cast("double").alias("x"))
    assert exact_quantiles(empty, ["x"], [0.5]) == {"x": [None]}
