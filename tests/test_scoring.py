"""The one scoring call: same scores as the prepared table, no shuffle."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from riskframe.operators import quality as Q
from riskframe.plans.analytic import wide_table
from riskframe.plans.q_model import SPEC, q_batch_score, trained
from riskframe.plans.scoring import score_table, scorer_of


def test_score_table(spark):
    p, model = trained(spark, SF_SMALL)
    scorer = scorer_of(spark, model, p.preprocessor)
    wide = wide_table(spark, SF_SMALL)
    out = score_table(wide, scorer, SPEC)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    before = q_batch_score(spark, SF_SMALL).select(SPEC.entity_key, F.col("probability").alias("p"))
    both = out.join(before, SPEC.entity_key)
    assert both.count() == wide.count()
    assert both.filter(F.abs(F.col("probability") - F.col("p")) > 1e-12).isEmpty()
    sparse = score_table(wide.drop(*SPEC.score_parts), scorer, SPEC)
    assert sparse.filter("probability is null or risk_tier is null").isEmpty()


def test_lump_to_fixed_values(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert [r.c for r in Q.lump_to(rows, "c", ["a", "b", "Other"]).collect()] == ["a", "b", "Other", "Other"]


def test_rounding_of_large_values(spark):
    from riskframe.functions.scalar import round_half_up
    x = spark.createDataFrame([(2.0 ** 41 + 0.0078125,), (1e17,)], "x double").select(round_half_up(F.col("x"), 2).alias("y"))
    assert [r.y for r in x.collect()] == [2.0 ** 41 + 0.01, 1e17]
