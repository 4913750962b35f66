"""Registered queries: validation and cleaning."""

from __future__ import annotations

from riskframe.operators import quality as Q
from riskframe.plans.analytic import wide_table
from riskframe.plans.oracle_base import NUMERIC, RANGES, r, with_wide
from riskframe.plans.registry import query, rounded
from riskframe.sources.readers import read_table
from riskframe.spec import tpch_binding

SPEC = tpch_binding()
KEYS = ["o_custkey", "o_orderkey"]
CAT = ["o_orderpriority", "o_orderstatus", "segment"]
SUBS = ["sub_click", "sub_view", "sub_purchase", "sub_signup"]
# category levels of the bound columns (TPC-H domains; HOUSEHOLD is the NULL level)
LEVELS = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
          "o_orderstatus": ["F", "O", "P"],
          "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]}
RMAP = {c: (lo, hi) for c, lo, hi in RANGES}


def _validated_sql() -> str:
    cols = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}"
                     for c, lo, hi in RANGES)
    return (f"validated AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, segment, "
            f"flag, err_flag, {cols} FROM wide)")


def _num_out(src_cols: dict[str, str]) -> str:
    return ", ".join(f"{r(expr)} AS {c}" for c, expr in src_cols.items())


# ------------------------------------------------------------------ F2
@query("validate_ranges", with_wide(
    f"SELECT o_orderkey, {_num_out({c: c for c in NUMERIC})} FROM validated", _validated_sql()))
def q_validate_ranges(spark, base):
    w = Q.validate_ranges(wide_table(spark, base), SPEC.valid_ranges)
    return rounded(w.select("o_orderkey", *NUMERIC))


# ------------------------------------------------------------------ F3 / C8
def _clip_expr(c):
    lo, hi = RMAP[c]
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


@query("clip_ranges", with_wide(
    f"SELECT o_orderkey, {_num_out({c: _clip_expr(c) for c in NUMERIC})} FROM wide"))
def q_clip_ranges(spark, base):
    w = Q.clip_ranges(wide_table(spark, base), SPEC.clip_ranges)
    return rounded(w.select("o_orderkey", *NUMERIC))


# ------------------------------------------------------------------ F4
@query("missing_flags", with_wide(
    "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in ["lab_a", "lab_n", "lab_r"])
    + " FROM validated", _validated_sql()))
def q_missing_flags(spark, base):
    w = Q.validate_ranges(wide_table(spark, base), SPEC.valid_ranges)
    w = Q.missing_flags(w, SPEC.indicator_columns)
    return w.select("o_orderkey", *[f"{c}_missing" for c in SPEC.indicator_columns])


# ------------------------------------------------------------------ F5
@query("row_sum", with_wide(
    f"SELECT o_orderkey, {r('CASE WHEN coalesce(' + ', '.join(SUBS) + ') IS NOT NULL THEN ' + ' + '.join(f'coalesce({c}, 0)' for c in SUBS) + ' END')} AS sub_total FROM validated",
    _validated_sql()))
def q_row_sum(spark, base):
    w = Q.validate_ranges(wide_table(spark, base), SPEC.valid_ranges)
    return rounded(Q.add_row_sum(w, SPEC.score_parts, SPEC.score_total)
                   .select("o_orderkey", SPEC.score_total))


# ------------------------------------------------------------------ F6
_FLAG_SQL = {"acctbal_over_7500": "c_acctbal >= 7500", "los_over_7": "los_days > 7",
             "los_over_14": "los_days > 14", "lab_a_low": "lab_a < 20000",
             "lab_n_low": "lab_n < 10000"}


@query("threshold_flags", with_wide(
    "SELECT o_orderkey, " + ", ".join(f"coalesce(CAST({e} AS INTEGER), 0) AS {n}"
                                      for n, e in _FLAG_SQL.items())
    + " FROM validated", _validated_sql()))
def q_threshold_flags(spark, base):
    w = Q.validate_ranges(wide_table(spark, base), SPEC.valid_ranges)
    w = Q.threshold_flags(w, SPEC.threshold_flags)
    return w.select("o_orderkey", *SPEC.engineered_binary)


# ------------------------------------------------------------------ T3 / F7
@query("top_categories", """
SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count DESC, p_brand ASC LIMIT 5""")
def q_top_categories(spark, base):
    return Q.top_categories(read_table(spark, base, "part"), "p_brand", 5)


@query("consolidate_categories", """
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
             ORDER BY count(*) DESC, p_brand ASC LIMIT 5)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand
FROM part""")
def q_consolidate_categories(spark, base):
    p = read_table(spark, base, "part", ["p_partkey", "p_brand"])
    return Q.consolidate_categories(p, "p_brand", 5)


# ------------------------------------------------------------------ A16
def _oor_sql():
    parts = [f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
             f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_out FROM wide"
             for c, lo, hi in RANGES]
    return with_wide("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_out > 0")


@query("out_of_range", _oor_sql())
def q_out_of_range(spark, base):
    return rounded(Q.out_of_range(wide_table(spark, base), SPEC.valid_ranges))


# ------------------------------------------------------------------ C1 C2
@query("impute_median", with_wide(
    f"SELECT o_orderkey, {_num_out({c: f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM wide))' for c in NUMERIC})} FROM wide"))
def q_impute_median(spark, base):
    w = wide_table(spark, base)
    return rounded(Q.impute_median(w, NUMERIC).select("o_orderkey", *NUMERIC))


@query("impute_mean", with_wide(
    f"SELECT o_orderkey, {_num_out({c: f'coalesce({c}, (SELECT avg({c}) FROM wide))' for c in NUMERIC})} FROM wide"))
def q_impute_mean(spark, base):
    w = wide_table(spark, base)
    return rounded(Q.impute_mean(w, NUMERIC).select("o_orderkey", *NUMERIC))


# ------------------------------------------------------------------ C3
def _mode_sql(c, src="wide"):
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@query("impute_mode", with_wide(
    "SELECT o_orderkey, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in CAT)
    + " FROM wide"))
def q_impute_mode(spark, base):
    w = wide_table(spark, base)
    return Q.impute_mode(w, CAT).select("o_orderkey", *CAT)


# ------------------------------------------------------------------ C4 C5
def _minmax(c, src="wide"):
    lo, hi = f"(SELECT min({c}) FROM {src})", f"(SELECT max({c}) FROM {src})"
    return f"CASE WHEN {hi} > {lo} THEN ({c} - {lo}) / ({hi} - {lo}) ELSE {c} END"


def _z(c, src="wide"):
    mu, sd = f"(SELECT avg({c}) FROM {src})", f"(SELECT stddev_samp({c}) FROM {src})"
    return f"CASE WHEN {sd} > 0 THEN ({c} - {mu}) / {sd} ELSE {c} END"


@query("minmax_scale", with_wide(
    f"SELECT o_orderkey, {_num_out({c: _minmax(c) for c in NUMERIC})} FROM wide"))
def q_minmax_scale(spark, base):
    w = wide_table(spark, base)
    return rounded(Q.minmax_scale(w, NUMERIC).select("o_orderkey", *NUMERIC))


@query("zscore", with_wide(
    f"SELECT o_orderkey, {_num_out({c: _z(c) for c in NUMERIC})} FROM wide"))
def q_zscore(spark, base):
    w = wide_table(spark, base)
    return rounded(Q.zscore(w, NUMERIC).select("o_orderkey", *NUMERIC))


# ------------------------------------------------------------------ C6
def _one_hot_cols(levels=LEVELS):
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\""
                     for c, lv in levels.items() for v in lv)


@query("one_hot", with_wide(f"SELECT o_orderkey, {_one_hot_cols()} FROM wide"))
def q_one_hot(spark, base):
    w = wide_table(spark, base).select("o_orderkey", *CAT)
    return Q.one_hot(w, CAT)


# ------------------------------------------------------------------ P9 / C7
@query("clean_dropna", with_wide(f"""
SELECT o_orderkey, {_num_out({c: c for c in NUMERIC})}, o_orderpriority, o_orderstatus, segment,
       flag, err_flag, o_custkey
FROM wide WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMERIC + CAT)}"""))
def q_clean_dropna(spark, base):
    return rounded(Q.dropna_any(wide_table(spark, base)))


# ------------------------------------------------------------------ C10
CHAIN = ["clip", "impute_median", "zscore", "impute_mode", "one_hot", "dedup"]
CHAIN_NUM = ["los_days", "c_acctbal", "err_flag", "lab_a", "lab_n", "lab_r"] + SUBS


def _chain_sql():
    clipped = ", ".join(
        (_clip_expr(c) + f" AS {c}") if c in RMAP else c for c in CHAIN_NUM)
    s1 = f"s1 AS (SELECT o_custkey, o_orderkey, flag, {', '.join(CAT)}, {clipped} FROM wide)"
    s2 = ("s2 AS (SELECT o_custkey, o_orderkey, flag, " + ", ".join(CAT) + ", " + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM s1)) AS {c}" for c in CHAIN_NUM)
        + " FROM s1)")
    s3 = ("s3 AS (SELECT o_custkey, o_orderkey, flag, " + ", ".join(CAT) + ", " + ", ".join(
        f"{_z(c, 's2')} AS {c}" for c in CHAIN_NUM) + " FROM s2)")
    s4 = ("s4 AS (SELECT o_custkey, o_orderkey, flag, " + ", ".join(CHAIN_NUM) + ", " + ", ".join(
        f"coalesce({c}, {_mode_sql(c, 's3')}) AS {c}" for c in CAT) + " FROM s3)")
    body = (f"SELECT DISTINCT o_custkey, o_orderkey, flag, {_num_out({c: c for c in CHAIN_NUM})}, "
            f"{_one_hot_cols()} FROM s4")
    return with_wide(body, s1, s2, s3, s4)


@query("clean_chain", _chain_sql())
def q_clean_chain(spark, base):
    w = wide_table(spark, base)
    out, _ = Q.clean(w, CHAIN, exclude=["o_custkey", "o_orderkey", "flag"],
                     clip_ranges_=SPEC.clip_ranges)
    return rounded(out)


def _log_sql():
    hot = " + ".join(f"count(DISTINCT {c})" for c in CAT)
    rows = ["(0, 'input', (SELECT count(*) FROM wide), 16)"]
    for i, step in enumerate(Q.STEPS, 1):
        source = "(SELECT DISTINCT * FROM kept)" if step == "dedup" else "kept"
        columns = f"(SELECT CAST({16 - len(CAT)} + {hot} AS INTEGER) FROM kept)" if step in ("one_hot", "dedup") else "16"
        rows.append(f"({i}, '{step}', (SELECT count(*) FROM {source}), {columns})")
    kept = "kept AS (SELECT * FROM wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC + CAT) + ")"
    return with_wide(f'SELECT * FROM (VALUES {", ".join(rows)}) t(seq, step, "rows", "columns")', kept)


@query("clean_log", _log_sql())
def q_clean_log(spark, base):
    """The log of all nine steps."""
    _, log = Q.clean(wide_table(spark, base), list(Q.STEPS), exclude=["o_custkey", "o_orderkey", "flag"],
                     clip_ranges_=SPEC.clip_ranges)
    return log
