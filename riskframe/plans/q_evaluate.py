"""Registered queries: evaluation (L4-L10) on the fixed score of the binding,
so every metric is checked by SQL without a trained model."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from riskframe.operators import evaluate as E
from riskframe.plans.analytic import wide_table
from riskframe.plans.oracle_base import SCORE_SQL, r, with_wide
from riskframe.plans.registry import query, rounded


def fixed_score(df):
    """The binding's deterministic score (a logistic expression of two columns)."""
    z = F.lit(-2.6) + F.lit(0.00005) * F.coalesce(F.col("lab_r"), F.lit(36000.0)) \
        - F.lit(0.0001) * F.col("c_acctbal")
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)


def scored(spark, base):
    w = wide_table(spark, base)
    return w.select("o_orderkey", "flag", fixed_score(w).alias("score"))


def optimal(spark, base):
    return E.optimal_threshold(scored(spark, base), "score", "flag")


# ------------------------------------------------------------------ SQL blocks
SC = f"sc AS (SELECT o_orderkey, {SCORE_SQL} AS p, flag AS y FROM wide)"
TAB = """tab AS (
  SELECT t, tp, fp, fn,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS sens,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM (SELECT g.t, count(*) FILTER (WHERE p >= g.t AND y = 1) AS tp,
               count(*) FILTER (WHERE p >= g.t AND y <> 1) AS fp,
               (SELECT count(*) FROM sc WHERE y = 1) - count(*) FILTER (WHERE p >= g.t AND y = 1) AS fn
        FROM (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(1, 50) r(i)) g, sc GROUP BY g.t))"""
OPT = """opt AS (
  SELECT threshold, f1, sensitivity, method FROM (
    SELECT t AS threshold, f1, sens AS sensitivity, 'f1' AS method, 1 AS pr,
           row_number() OVER (ORDER BY f1 DESC, t) AS rn FROM tab WHERE sens >= 0.8 AND f1 > 0
    UNION ALL
    SELECT t, f1, sens, 'sensitivity', 2, row_number() OVER (ORDER BY sens DESC, t)
    FROM tab WHERE sens > 0
    UNION ALL
    SELECT 0.5, NULL, NULL, 'default', 3, 1)
  WHERE rn = 1 ORDER BY pr LIMIT 1)"""
SCC = ("scc AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg "
       "FROM sc GROUP BY p)")
AU = ("au AS (SELECT sum(pos * (cn + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auroc FROM "
      "(SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
      "AS cn FROM scc))")


def _cc(t: str) -> str:
    return (f"cc AS (SELECT count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, "
            f"count(*) FILTER (WHERE p >= {t} AND y <> 1) AS fp, "
            f"count(*) FILTER (WHERE p < {t} AND y <> 1) AS tn, "
            f"count(*) FILTER (WHERE p < {t} AND y = 1) AS fn FROM sc)")


def _div(a, b):
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


# ------------------------------------------------------------------ L4
@query("optimal_threshold", with_wide(
    f"SELECT {r('threshold')} AS threshold, {r('f1')} AS f1, {r('sensitivity')} AS sensitivity, method FROM opt",
    SC, TAB, OPT))
def q_optimal_threshold(spark, base):
    return rounded(optimal(spark, base))


@query("threshold_table", with_wide(
    f"SELECT {r('t')} AS threshold, tp, fp, fn, {r('sens')} AS sensitivity, "
    f"{r(_div('tp', 'tp + fp'))} AS precision, {r('f1')} AS f1 FROM tab", SC, TAB))
def q_threshold_table(spark, base):
    return rounded(E.threshold_table(scored(spark, base), "score", "flag"))


# ------------------------------------------------------------------ L5
@query("evaluate", with_wide(
    f"SELECT {r('auroc')} AS auroc, {r(_div('tp', 'tp + fn'))} AS sensitivity, "
    f"{r(_div('tn', 'tn + fp'))} AS specificity, {r(_div('tp', 'tp + fp'))} AS precision, "
    f"{r(_div('2 * tp', '2 * tp + fp + fn'))} AS f1, "
    f"{r('(SELECT avg((p - y) * (p - y)) FROM sc)')} AS brier_score, "
    f"{r('(SELECT threshold FROM opt)')} AS threshold FROM cc, au",
    SC, TAB, OPT, SCC, AU, _cc("(SELECT threshold FROM opt)")))
def q_evaluate(spark, base):
    return rounded(metrics_table(spark, base))


@lru_cache(maxsize=4)
def metrics_table(spark, base):
    """L4 + L5 at the chosen threshold, written once per session like the
    original pipeline's metrics file; reports and the JSON sink read it."""
    from riskframe.session import materialize
    t = optimal(spark, base).select("threshold").scalar()
    return materialize(E.evaluate(scored(spark, base), "score", "flag", t), "metrics")


@query("auroc", with_wide(f"SELECT {r('auroc')} AS auroc FROM au", SC, SCC, AU))
def q_auroc(spark, base):
    return rounded(E.auroc(scored(spark, base), "score", "flag"))


# ------------------------------------------------------------------ L6
def _report_sql():
    p1, r1 = _div("tp", "tp + fp"), _div("tp", "tp + fn")
    p0, r0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")
    return with_wide(f"""
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, CAST(tp + tn AS DOUBLE) / n, n FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
                   (f0 * s0 + f1 * s1) / n, n FROM m)""",
        SC, TAB, OPT, _cc("(SELECT threshold FROM opt)"),
        f"m0 AS (SELECT *, {p0} AS p0, {r0} AS r0, {p1} AS p1, {r1} AS r1, tn + fp AS s0, "
        f"tp + fn AS s1, tp + fp + tn + fn AS n FROM cc)",
        f"m AS (SELECT *, {_div('2 * p0 * r0', 'p0 + r0')} AS f0, {_div('2 * p1 * r1', 'p1 + r1')} AS f1 FROM m0)")


@query("classification_report", _report_sql())
def q_classification_report(spark, base):
    s = scored(spark, base)
    t = optimal(spark, base).select("threshold").scalar()
    return rounded(E.classification_report(s, "score", "flag", t))


# ------------------------------------------------------------------ L7
@query("confusion_matrix", with_wide("""
SELECT 0 AS actual, 0 AS predicted, tn AS count FROM cc UNION ALL
SELECT 0, 1, fp FROM cc UNION ALL SELECT 1, 0, fn FROM cc UNION ALL SELECT 1, 1, tp FROM cc""",
    SC, _cc("0.5")))
def q_confusion_matrix(spark, base):
    return E.confusion_matrix(scored(spark, base), "score", "flag", 0.5)


# ------------------------------------------------------------------ L8 L9
_CUM = ("cum AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn, "
        "(SELECT sum(pos) FROM scc) AS tot_pos, (SELECT sum(neg) FROM scc) AS tot_neg FROM scc)")


@query("roc_curve", with_wide(f"""
SELECT {r('p')} AS threshold, {r('CAST(cn AS DOUBLE) / tot_neg')} AS fpr, {r('CAST(cp AS DOUBLE) / tot_pos')} AS tpr FROM cum
UNION ALL SELECT NULL, 0.0, 0.0""", SC, SCC, _CUM))
def q_roc_curve(spark, base):
    return rounded(E.roc_curve(scored(spark, base), "score", "flag"))


@query("pr_curve", with_wide(f"""
SELECT {r('p')} AS threshold, {r('CAST(cp AS DOUBLE) / (cp + cn)')} AS precision,
       {r('CAST(cp AS DOUBLE) / tot_pos')} AS recall FROM cum
UNION ALL SELECT NULL, 1.0, 0.0""", SC, SCC, _CUM))
def q_pr_curve(spark, base):
    return rounded(E.pr_curve(scored(spark, base), "score", "flag"))


# ------------------------------------------------------------------ L10
_EDGES = [i * (1.0 + 1e-8) / 10 for i in range(1, 10)]


@query("calibration", with_wide(
    "SELECT bin, " + r("avg(p)") + " AS mean_predicted, " + r("avg(CAST(y AS DOUBLE))")
    + " AS fraction_positive, count(*) AS count FROM (SELECT p, y, "
    + " + ".join(f"CAST(p > {e!r} AS INTEGER)" for e in _EDGES)
    + " AS bin FROM sc WHERE p IS NOT NULL) GROUP BY bin", SC))
def q_calibration(spark, base):
    return rounded(E.calibration(scored(spark, base), "score", "flag"))
