"""Registered queries: rules (F10-F13) and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import rules as R
from riskframe.functions.scalar import row_sum
from riskframe.operators import report as G
from riskframe.plans.analytic import WIDE_COLUMNS, wide_table
from riskframe.plans.oracle_base import SCORE_SQL, r, with_wide
from riskframe.plans.q_evaluate import (AU, OPT, SC, SCC, TAB, _cc, _div, fixed_score,
                                        metrics_table, scored)
from riskframe.plans.q_model import trained
from riskframe.plans.registry import query, rounded
from riskframe.spec import tpch_binding

SPEC = tpch_binding()
SUBS = ["sub_click", "sub_view", "sub_purchase", "sub_signup"]
_OPS = {"<": "<", "<=": "<=", ">": ">", ">=": ">=", "==": "="}


def _with_total(df):
    return df.withColumn("sub_total", row_sum(SUBS))


def _total_sql() -> str:
    return ("CASE WHEN coalesce(" + ", ".join(SUBS) + ") IS NOT NULL THEN "
            + " + ".join(f"coalesce({c}, 0)" for c in SUBS) + " END")


def _rules_sql(rules) -> str:
    return "concat_ws('; ', " + ", ".join(
        f"CASE WHEN {x.column} {_OPS[x.op]} {x.value!r} THEN '{x.message}' END" for x in rules) + ")"


# ------------------------------------------------------------------ F10
@query("risk_tier", with_wide(f"""
SELECT o_orderkey, {r('p')} AS score,
       CASE WHEN p < 0.15 THEN 'Low' WHEN p < 0.4 THEN 'Moderate' WHEN p IS NOT NULL THEN 'High' END AS risk_tier
FROM sc""", SC))
def q_risk_tier(spark, base):
    s = scored(spark, base)
    return rounded(s.select("o_orderkey", "score",
                            R.risk_tier("score", SPEC.tier_low, SPEC.tier_moderate).alias("risk_tier")))


# ------------------------------------------------------------------ F11 F12
@query("risk_warnings", with_wide(
    f"SELECT o_orderkey, {_rules_sql(SPEC.warnings)} AS warnings FROM "
    f"(SELECT *, {_total_sql()} AS sub_total FROM wide)"))
def q_risk_warnings(spark, base):
    w = _with_total(wide_table(spark, base))
    return w.select("o_orderkey", F.array_join(R.rule_messages(SPEC.warnings), "; ").alias("warnings"))


@query("recommendations", with_wide(
    f"SELECT o_orderkey, CASE WHEN {_rules_sql(SPEC.recommendations)} = '' THEN "
    f"'{SPEC.default_recommendation}' ELSE {_rules_sql(SPEC.recommendations)} END AS recommendations "
    "FROM wide"))
def q_recommendations(spark, base):
    w = wide_table(spark, base)
    recs = R.recommendations(SPEC.recommendations, SPEC.default_recommendation)
    return w.select("o_orderkey", F.array_join(recs, "; ").alias("recommendations"))


@query("scored_rules", with_wide(f"""
SELECT o_orderkey, {r('p')} AS score,
       CASE WHEN p < 0.15 THEN 'Low' WHEN p < 0.4 THEN 'Moderate' WHEN p IS NOT NULL THEN 'High' END AS risk_tier,
       {_rules_sql(SPEC.warnings)} AS warnings
FROM (SELECT *, {SCORE_SQL} AS p, {_total_sql()} AS sub_total FROM wide)"""))
def q_scored_rules(spark, base):
    """F10 + F11 on one scored table (what batch scoring emits per entity)."""
    w = _with_total(wide_table(spark, base))
    out = R.with_rules(w.withColumn("score", fixed_score(w)), SPEC, prob="score")
    return rounded(out.select("o_orderkey", "score", "risk_tier",
                              F.array_join("warnings", "; ").alias("warnings")))


# ------------------------------------------------------------------ G1
_metrics = metrics_table


def _fmt(x, d=4):
    return f"printf('%.{d}f', {r(x, d)})"


_METRIC_CTES = (SC, TAB, OPT, SCC, AU, _cc("(SELECT threshold FROM opt)"),
                "mt AS (SELECT auroc, " + _div("tp", "tp + fn") + " AS sensitivity, "
                + _div("tn", "tn + fp") + " AS specificity, " + _div("tp", "tp + fp") + " AS precision, "
                + _div("2 * tp", "2 * tp + fp + fn") + " AS f1, (SELECT avg((p - y) * (p - y)) FROM sc) "
                "AS brier_score, (SELECT threshold FROM opt) AS threshold FROM cc, au)")


def _gate_sql(x, t):
    return f"CASE WHEN {x} >= {t} THEN ' [PASS]' ELSE ' [BELOW TARGET]' END"


@query("report_performance", with_wide(f"""
SELECT 'metrics' AS section, 1 AS seq, 'AUROC' AS key, {_fmt('auroc')} || {_gate_sql('auroc', 0.8)} AS value FROM mt
UNION ALL SELECT 'metrics', 2, 'Sensitivity', {_fmt('sensitivity')} || {_gate_sql('sensitivity', 0.8)} FROM mt
UNION ALL SELECT 'metrics', 3, 'Specificity', {_fmt('specificity')} FROM mt
UNION ALL SELECT 'metrics', 4, 'Precision', {_fmt('precision')} FROM mt
UNION ALL SELECT 'metrics', 5, 'F1 Score', {_fmt('f1')} FROM mt
UNION ALL SELECT 'metrics', 6, 'Brier Score', {_fmt('brier_score')} FROM mt
UNION ALL SELECT 'metrics', 7, 'Threshold', {_fmt('threshold', 2)} FROM mt
UNION ALL SELECT 'targets', 1, 'AUROC target', '>= 0.8'
UNION ALL SELECT 'targets', 2, 'Sensitivity target', '>= 0.8'""", *_METRIC_CTES))
def q_report_performance(spark, base):
    return G.performance_report(_metrics(spark, base), SPEC)


# ------------------------------------------------------------------ G2
_WIDE_TYPES = ["bigint", "bigint", "string", "string", "double", "string", "double", "int", "int",
               "double", "double", "double", "double", "double", "double", "double"]


def _dataset_sql():
    miss = " UNION ALL ".join(
        f"SELECT 'missing' AS section, {i + 1} AS seq, '{c}' AS key, "
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM wide"
        for i, c in enumerate(WIDE_COLUMNS))
    cols = " UNION ALL ".join(f"SELECT 'columns', {i + 1}, '{c}', '{t}'"
                              for i, (c, t) in enumerate(zip(WIDE_COLUMNS, _WIDE_TYPES)))
    return with_wide(f"""
SELECT 'summary' AS section, 1 AS seq, 'Total entities' AS key, format('{{:,}}', count(*)) AS value FROM wide
UNION ALL SELECT 'summary', 2, 'Total features', '{len(WIDE_COLUMNS) - 1}'
UNION ALL SELECT 'summary', 3, 'Positive cases', format('{{:,}}', CAST(sum(flag) AS BIGINT)) FROM wide
UNION ALL SELECT 'summary', 4, 'Prevalence', {_fmt('avg(flag) * 100.0', 2)} || '%' FROM wide
UNION ALL SELECT section, seq, key, {_fmt('share * 100.0', 1)} || '%' FROM ({miss}) WHERE share > 0
UNION ALL {cols}""")


@query("report_dataset", _dataset_sql())
def q_report_dataset(spark, base):
    return G.dataset_report(wide_table(spark, base), "flag")


# ------------------------------------------------------------------ G3
@query("report_importance")
def q_report_importance(spark, base):
    from riskframe.operators.model import feature_importance
    p, model = trained(spark, base)
    return G.importance_report(feature_importance(model, p.feature_names, spark))


# ------------------------------------------------------------------ G4
def _full_sql():
    res = " UNION ALL ".join(f"SELECT 'results', {i + 1}, '{c}', {_fmt(c)} FROM mt" for i, c in enumerate(
        ["auroc", "sensitivity", "specificity", "precision", "f1", "brier_score", "threshold"]))
    return with_wide(f"""
SELECT 'config' AS section, 1 AS seq, 'Algorithm' AS key, 'Gradient-boosted trees (Spark MLlib)' AS value
UNION ALL SELECT 'config', 2, 'Test split', '20%'
UNION ALL SELECT 'config', 3, 'Random state', '42'
UNION ALL SELECT 'config', 4, 'AUROC target', '>= 0.8'
UNION ALL SELECT 'config', 5, 'Sensitivity target', '>= 0.8'
UNION ALL SELECT 'dataset', 1, 'Entities', format('{{:,}}', count(*)) FROM wide
UNION ALL SELECT 'dataset', 2, 'Positive cases', format('{{:,}}', CAST(sum(flag) AS BIGINT)) FROM wide
UNION ALL SELECT 'dataset', 3, 'Prevalence', {_fmt('avg(flag) * 100.0', 2)} || '%' FROM wide
UNION ALL {res}""", *_METRIC_CTES)


@query("report_full", _full_sql())
def q_report_full(spark, base):
    return G.full_report(wide_table(spark, base), "flag", _metrics(spark, base), SPEC)
