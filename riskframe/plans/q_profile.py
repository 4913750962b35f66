"""Registered queries: profiles (A3-A15, A17, A18) on the wide table, raw
``events.value`` and ``documents x labels``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.plans.analytic import (wide_table, label_keys, open_tables,
                                      per_order_lines, per_user_events, build_analytic_dataset)
from riskframe.plans.oracle_base import NUMERIC, WIDE_CTE, r, with_wide
from riskframe.plans.registry import query, rounded
from riskframe.sources.readers import read_table

SUBS = ["sub_click", "sub_view", "sub_purchase", "sub_signup"]
CMP_COLS = NUMERIC + ["err_flag"]
CORR_COLS = NUMERIC + ["flag"]
WIDE_ALL = ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "los_days", "segment",
            "c_acctbal", "flag", "err_flag", "lab_a", "lab_n", "lab_r"] + SUBS
WIDE_NUM = ["o_custkey", "o_orderkey", "los_days", "c_acctbal", "flag", "err_flag",
            "lab_a", "lab_n", "lab_r"] + SUBS
WIDE_CAT = ["o_orderpriority", "o_orderstatus", "segment"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ A3
@query("value_counts", with_wide("""
SELECT segment, count(*) AS count FROM wide WHERE segment IS NOT NULL GROUP BY segment"""))
def q_value_counts(spark, base):
    return P.value_counts(wide_table(spark, base), "segment")


# ------------------------------------------------------------------ A4
@query("class_distribution", with_wide(f"""
SELECT flag, count(*) AS count, {r('round(count(*) * 100.0 / (SELECT count(*) FROM wide), 1)')} AS percent,
       CASE flag WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS class
FROM wide GROUP BY flag"""))
def q_class_distribution(spark, base):
    w = wide_table(spark, base)
    return rounded(P.class_distribution(w, "flag", {0: "negative", 1: "positive"}))


# ------------------------------------------------------------------ A5
@query("prevalence_by_group", with_wide(f"""
SELECT o_orderstatus, {r('round(avg(flag) * 100.0, 2)')} AS rate, count(*) AS count
FROM wide WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus"""))
def q_prevalence_by_group(spark, base):
    return rounded(P.prevalence_by_group(wide_table(spark, base), "o_orderstatus", "flag"))


@query("prevalence_by_segment", with_wide(f"""
SELECT segment, {r('round(avg(flag) * 100.0, 2)')} AS rate, count(*) AS count
FROM wide WHERE segment IS NOT NULL GROUP BY segment"""))
def q_prevalence_by_segment(spark, base):
    return rounded(P.prevalence_by_group(wide_table(spark, base), "segment", "flag"))


# ------------------------------------------------------------------ A6
def _group_compare_sql():
    parts = [f"SELECT '{c}' AS feature, {r(f'avg({c}) FILTER (WHERE flag = 0)')} AS mean_a, "
             f"{r(f'avg({c}) FILTER (WHERE flag = 1)')} AS mean_b, "
             f"{r(f'avg({c}) FILTER (WHERE flag = 1) - avg({c}) FILTER (WHERE flag = 0)')} AS delta "
             f"FROM wide" for c in CMP_COLS]
    return with_wide(_union(parts))


@query("group_compare", _group_compare_sql())
def q_group_compare(spark, base):
    return rounded(P.group_compare(wide_table(spark, base), "flag", CMP_COLS))


# ------------------------------------------------------------------ A7
def _describe_sql(cols, src="wide"):
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})')} AS mean, "
             f"{r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
             f"{r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, "
             f"{r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM {src}"
             for c in cols]
    return _union(parts)


@query("describe_numeric", with_wide(_describe_sql(NUMERIC)))
def q_describe_numeric(spark, base):
    return rounded(P.describe_numeric(wide_table(spark, base), NUMERIC))


@query("describe_events", f"SELECT * FROM ({_describe_sql(['value'], 'events')})")
def q_describe_events(spark, base):
    return rounded(P.describe_numeric(read_table(spark, base, "events"), ["value"]))


# ------------------------------------------------------------------ A8
def _describe_all_sql():
    num = [f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
           f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {r(f'avg({c})')} AS mean, "
           f"{r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
           f"{r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, "
           f"{r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM wide"
           for c in WIDE_NUM]
    cat = [f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM wide) AS count, "
           f"(SELECT count(DISTINCT {c}) FROM wide) AS \"unique\", v AS top, n AS freq, "
           "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, "
           "NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max FROM "
           f"(SELECT {c} AS v, count(*) AS n FROM wide WHERE {c} IS NOT NULL GROUP BY 1 "
           f"ORDER BY n DESC, v ASC LIMIT 1)" for c in WIDE_CAT]
    return with_wide(_union(num + cat))


@query("describe_all", _describe_all_sql())
def q_describe_all(spark, base):
    return rounded(P.describe_all(wide_table(spark, base)))


# ------------------------------------------------------------------ A9
_TYPES = {"o_custkey": "bigint", "o_orderkey": "bigint", "o_orderpriority": "string",
          "o_orderstatus": "string", "los_days": "double", "segment": "string",
          "c_acctbal": "double", "flag": "int", "err_flag": "int"}


def _profile_sql():
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS non_null, "
             f"{r(f'round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0, 1)')} AS null_pct, "
             f"count(DISTINCT {c}) AS \"distinct\", '{_TYPES.get(c, 'double')}' AS dtype FROM wide"
             for c in WIDE_ALL]
    return with_wide(_union(parts))


@query("column_profile", _profile_sql())
def q_column_profile(spark, base):
    return rounded(P.column_profile(wide_table(spark, base)))


# ------------------------------------------------------------------ A10
def _missing_sql():
    parts = [f"SELECT '{c}' AS \"column\", "
             f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS m FROM wide"
             for c in WIDE_ALL]
    return with_wide(f"SELECT \"column\", {r('m')} AS missing_pct FROM ({_union(parts)}) WHERE m > 0")


@query("missingness", _missing_sql())
def q_missingness(spark, base):
    return rounded(P.missingness(wide_table(spark, base)))


# ------------------------------------------------------------------ A11
def _corr_sql():
    parts = []
    for a, b in combinations(CORR_COLS, 2):
        for x, y in ((a, b), (b, a)):
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, {r(f'corr({a}, {b})')} AS corr FROM wide")
    for c in CORR_COLS:
        parts.append(f"SELECT '{c}' AS col_a, '{c}' AS col_b, CASE WHEN count({c}) > 1 AND "
                     f"stddev_samp({c}) > 0 THEN 1.0 END AS corr FROM wide")
    return with_wide(_union(parts))


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, base):
    return rounded(P.correlation_matrix(wide_table(spark, base), CORR_COLS))


# ------------------------------------------------------------------ A12
def _iqr_sql(cols, src):
    parts = [f"SELECT '{c}' AS feature, {r('q1 - 1.5 * (q3 - q1)')} AS lower_bound, "
             f"{r('q3 + 1.5 * (q3 - q1)')} AS upper_bound, "
             f"(SELECT count(*) FROM {src} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) "
             f"AS outlier_count FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
             f"quantile_cont({c}, 0.75) AS q3 FROM {src})" for c in cols]
    return _union(parts)


@query("iqr_outliers", _iqr_sql(["value"], "events"))
def q_iqr_outliers(spark, base):
    return rounded(P.iqr_outliers(read_table(spark, base, "events"), ["value"]))


@query("iqr_outliers_wide", with_wide(_iqr_sql(NUMERIC, "wide")))
def q_iqr_outliers_wide(spark, base):
    return rounded(P.iqr_outliers(wide_table(spark, base), NUMERIC))


# ------------------------------------------------------------------ A13
def _hist_sql(src, col, label, bins, where="TRUE"):
    return f"""
  d AS (SELECT {col} AS x, {label} AS y FROM {src} WHERE {col} IS NOT NULL AND {label} IS NOT NULL AND {where}),
  b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS w FROM d),
  c AS (SELECT CASE WHEN w > 0 THEN least(CAST(floor((x - lo) / w) AS INTEGER), {bins - 1}) ELSE 0 END AS bin,
               y, count(*) AS n FROM d, b GROUP BY 1, 2),
  g AS (SELECT DISTINCT y, CAST(s.bin AS INTEGER) AS bin FROM d, range(0, {bins}) s(bin))
SELECT g.bin, {r('lo + g.bin * w')} AS bin_lo, {r('lo + (g.bin + 1) * w')} AS bin_hi,
       g.y AS {label}, coalesce(c.n, 0) AS count
FROM g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin AND c.y = g.y"""


@query("histogram_by_class", "WITH dl AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)),"
       + _hist_sql("dl", "n_chars", "quality", 20))
def q_histogram_by_class(spark, base):
    docs = read_table(spark, base, "documents", ["doc_id", "n_chars"])
    labels = read_table(spark, base, "labels", ["doc_id", "quality"])
    return rounded(P.histogram_by_class(docs.join(labels, "doc_id"), "n_chars", "quality", 20))


@query("los_histogram", f"WITH {WIDE_CTE}," + _hist_sql("wide", "los_days", "flag", 60, "los_days <= 60"))
def q_los_histogram(spark, base):
    w = wide_table(spark, base).where(F.col("los_days") <= 60)
    return rounded(P.histogram_by_class(w, "los_days", "flag", 60))


@query("age_histogram", f"WITH {WIDE_CTE}," + _hist_sql("wide", "c_acctbal", "flag", 40))
def q_age_histogram(spark, base):
    return rounded(P.histogram_by_class(wide_table(spark, base), "c_acctbal", "flag", 40))


# ------------------------------------------------------------------ A14
def _box_sql():
    melted = _union([f"SELECT flag, '{c[4:]}' AS measure, {c} AS value FROM wide WHERE {c} IS NOT NULL"
                     for c in SUBS])
    return with_wide(f"""
SELECT measure, flag, n, {r('mn')} AS min, {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3,
       {r('mx')} AS max, {r('wlo')} AS whisker_lo, {r('whi')} AS whisker_hi
FROM (SELECT b.measure, b.flag, b.n, b.mn, b.q1, b.med, b.q3, b.mx,
             min(m.value) FILTER (WHERE m.value BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)) AS wlo,
             max(m.value) FILTER (WHERE m.value BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)) AS whi
      FROM melted m JOIN box b ON m.measure = b.measure AND m.flag = b.flag
      GROUP BY ALL)""", f"melted AS ({melted})",
        "box AS (SELECT measure, flag, count(*) AS n, min(value) AS mn, quantile_cont(value, 0.25) AS q1, "
        "quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, max(value) AS mx "
        "FROM melted GROUP BY measure, flag)")


@query("boxplot_by_class", _box_sql())
def q_boxplot_by_class(spark, base):
    return rounded(P.boxplot_by_class(wide_table(spark, base), SUBS, "flag", prefix="sub_"))


# ------------------------------------------------------------------ A15 A17 A18
@query("dataset_summary", with_wide(f"""
SELECT count(*) AS rows, 15 AS features, CAST(sum(flag) AS BIGINT) AS positives,
       {r('avg(flag)')} AS prevalence FROM wide"""))
def q_dataset_summary(spark, base):
    return rounded(P.dataset_summary(wide_table(spark, base), "flag"))


@query("class_prevalence", with_wide(f"""
SELECT flag, count(*) AS count, {r('(SELECT avg(flag) FROM wide)')} AS prevalence
FROM wide GROUP BY flag"""))
def q_class_prevalence(spark, base):
    return rounded(P.class_prevalence(wide_table(spark, base), "flag"))


@query("step_log", f"""
SELECT * FROM (VALUES
 (0, 'orders', (SELECT count(*) FROM orders)),
 (1, 'lines_per_order', (SELECT count(DISTINCT l_orderkey) FROM lineitem)),
 (2, 'label_keys', (SELECT count(*) FROM ({_union(["SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND ((l_linestatus = 'F' AND regexp_matches(p_brand, '^Brand#1[0-9]$') AND p_type = 'PROMO') OR (l_linestatus = 'O' AND starts_with(p_brand, 'Brand#7')))"])}))),
 (3, 'users_with_events', (SELECT count(DISTINCT user_id) FROM events)),
 (4, 'cohort_customers', (SELECT count(*) FROM customer WHERE c_acctbal >= 0)),
 (5, 'analytic_rows', (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0))
) t(seq, step, rows)""")
def q_step_log(spark, base):
    t = open_tables(spark, base)
    stages = [("orders", t["orders"]),
              ("lines_per_order", per_order_lines(t["lineitem"])),
              ("label_keys", label_keys(t["lineitem"], t["part"])),
              ("users_with_events", per_user_events(t["events"])),
              ("cohort_customers", t["customer"].where(F.col("c_acctbal") >= 0)),
              ("analytic_rows", build_analytic_dataset(t))]
    return P.step_log(stages)
