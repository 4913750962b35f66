"""Registered queries: flagship, joins, shape, predicates (J1-J4, A1, A2, P1-P14,
R2, F1, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.scalar import duration_days, map_values, strip_prefix
from riskframe.operators import quality as Q
from riskframe.operators.shape import (distinct_keys, eav_pivot_min, flag_join, left_join,
                                       lookup_items, melt)
from riskframe.plans.analytic import (LAB_CODES, SUB_CODES, analytic_dataset, label_keys,
                                      wide_table)
from riskframe.plans.graph import driver_graph, wide_from_graph
from riskframe.plans.oracle_base import r, with_wide
from riskframe.plans.registry import query, rounded
from riskframe.sources.readers import read_table, union_sources

_WIDE_COLS = ("o_custkey, o_orderkey, o_orderpriority, o_orderstatus, {los} AS los_days, segment, "
              "{acct} AS c_acctbal, flag, err_flag, {la} AS lab_a, {ln} AS lab_n, {lr} AS lab_r, "
              "{sc} AS sub_click, {sv} AS sub_view, {sp} AS sub_purchase, {ss} AS sub_signup")


def _wide_select() -> str:
    return _WIDE_COLS.format(los=r("los_days"), acct=r("c_acctbal"), la=r("lab_a"),
                             ln=r("lab_n"), lr=r("lab_r"), sc=r("sub_click"),
                             sv=r("sub_view"), sp=r("sub_purchase"), ss=r("sub_signup"))


@query("analytic_dataset", with_wide(f"SELECT {_wide_select()} FROM wide"))
def q_analytic_dataset(spark, base):
    return rounded(analytic_dataset(spark, base))


@query("analytic_from_graph", with_wide(f"SELECT {_wide_select()} FROM wide"))
def q_analytic_from_graph(spark, base):
    """J4 from the declared source graph of the same tables."""
    return rounded(wide_from_graph(spark, driver_graph(), base))


@query("join_left", f"""
SELECT o_orderkey, o_custkey, c_mktsegment, {r('c_acctbal')} AS c_acctbal
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_join_left(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, base, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    return rounded(left_join(o, c, "o_custkey", "c_custkey"))


@query("flag_join", """
SELECT o_orderkey, o_custkey,
       CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey
                         AND e.event_type = 'error') THEN 1 ELSE 0 END AS err_flag
FROM orders o""")
def q_flag_join(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    ev = read_table(spark, base, "events", ["user_id", "event_type"])
    keys = distinct_keys(ev, "user_id", where=F.col("event_type") == "error")
    return flag_join(o, keys, "o_custkey", "err_flag", key="user_id")


@query("wide_join", f"""
SELECT o.o_orderkey, {r('li.lab_a')} AS lab_a, {r('li.lab_n')} AS lab_n, {r('li.lab_r')} AS lab_r
FROM orders o LEFT JOIN (
  SELECT l_orderkey, min(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS lab_a,
         min(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS lab_n,
         min(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS lab_r
  FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey""")
def q_wide_join(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey"])
    li = read_table(spark, base, "lineitem")
    labs = eav_pivot_min(li, "l_orderkey", "l_returnflag", "l_extendedprice", LAB_CODES)
    return rounded(left_join(o, labs, "o_orderkey", "l_orderkey"))


@query("pivot_min", f"""
SELECT l_orderkey,
       {r("min(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END)")} AS lab_a,
       {r("min(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END)")} AS lab_n,
       {r("min(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END)")} AS lab_r
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey""")
def q_pivot_min(spark, base):
    li = read_table(spark, base, "lineitem")
    return rounded(eav_pivot_min(li, "l_orderkey", "l_returnflag", "l_extendedprice", LAB_CODES))


@query("pivot_min_events", f"""
SELECT user_id,
       {r("min(value) FILTER (WHERE event_type = 'click')")} AS sub_click,
       {r("min(value) FILTER (WHERE event_type = 'view')")} AS sub_view,
       {r("min(value) FILTER (WHERE event_type = 'purchase')")} AS sub_purchase,
       {r("min(value) FILTER (WHERE event_type = 'signup')")} AS sub_signup
FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup') AND value IS NOT NULL
GROUP BY user_id""")
def q_pivot_min_events(spark, base):
    ev = read_table(spark, base, "events")
    return rounded(eav_pivot_min(ev, "user_id", "event_type", "value", SUB_CODES))


@query("distinct_keys", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def q_distinct_keys(spark, base):
    ev = read_table(spark, base, "events")
    return distinct_keys(ev, "user_id", where=F.col("event_type") == "error")


@query("flag_by_code", """
SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R'
  AND ((l_linestatus = 'F' AND regexp_matches(p_brand, '^Brand#1[0-9]$') AND p_type = 'PROMO')
    OR (l_linestatus = 'O' AND starts_with(p_brand, 'Brand#7')))""")
def q_flag_by_code(spark, base):
    return label_keys(read_table(spark, base, "lineitem"), read_table(spark, base, "part"))


@query("duration_days", f"""
SELECT o_orderkey, {r("(epoch_us(d) - epoch_us(o_orderdate)) / 86400000000.0")} AS los_days
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) x
  ON x.l_orderkey = o_orderkey""")
def q_duration_days(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_orderdate"])
    li = read_table(spark, base, "lineitem").groupBy("l_orderkey") \
        .agg(F.max("l_shipdate").alias("d"))
    j = left_join(o, li, "o_orderkey", "l_orderkey")
    return rounded(j.select("o_orderkey", duration_days("o_orderdate", "d").alias("los_days")))


@query("cohort_filter", f"""
SELECT c_custkey, {r('c_acctbal')} AS c_acctbal FROM customer WHERE c_acctbal >= 0""")
def q_cohort_filter(spark, base):
    c = read_table(spark, base, "customer", ["c_custkey", "c_acctbal"])
    return rounded(c.where(F.col("c_acctbal") >= 0))


@query("cohort_los", with_wide(f"""
SELECT o_orderkey, flag, {r('los_days')} AS los_days FROM wide WHERE los_days <= 60"""))
def q_cohort_los(spark, base):
    w = wide_table(spark, base)
    return rounded(w.where(F.col("los_days") <= 60).select("o_orderkey", "flag", "los_days"))


@query("melt", with_wide(f"""
SELECT o_orderkey, flag, regexp_replace(variable, '^sub_', '') AS variable, {r('value')} AS value
FROM (UNPIVOT (SELECT o_orderkey, flag, sub_click, sub_view, sub_purchase, sub_signup FROM wide)
      ON sub_click, sub_view, sub_purchase, sub_signup INTO NAME variable VALUE value)"""))
def q_melt(spark, base):
    w = wide_table(spark, base)
    long = melt(w, ["o_orderkey", "flag"], list(SUB_CODES.values()))
    long = long.where(F.col("value").isNotNull())
    return rounded(long.withColumn("variable", strip_prefix("variable", "sub_")))


@query("filter_in", f"""
SELECT l_orderkey, l_linenumber, l_returnflag, {r('l_extendedprice')} AS l_extendedprice
FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def q_filter_in(spark, base):
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag",
                                               "l_extendedprice"])
    return rounded(li.where(F.col("l_returnflag").isin("A", "R")))


@query("project_rename", f"""
SELECT c_custkey AS subject_id, c_mktsegment AS gender, {r('c_acctbal')} AS age FROM customer""")
def q_project_rename(spark, base):
    c = read_table(spark, base, "customer")
    return rounded(c.select(F.col("c_custkey").alias("subject_id"),
                            F.col("c_mktsegment").alias("gender"),
                            F.col("c_acctbal").alias("age")))


@query("drop_null_subset", with_wide(f"""
SELECT o_orderkey, {r('lab_a')} AS lab_a, {r('lab_n')} AS lab_n FROM wide
WHERE lab_a IS NOT NULL AND lab_n IS NOT NULL"""))
def q_drop_null_subset(spark, base):
    w = wide_table(spark, base).select("o_orderkey", "lab_a", "lab_n")
    return rounded(Q.drop_null_subset(w, ["lab_a", "lab_n"]))


@query("map_labels", with_wide("""
SELECT o_orderkey, flag, CASE flag WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS outcome
FROM wide"""))
def q_map_labels(spark, base):
    w = wide_table(spark, base)
    return w.select("o_orderkey", "flag",
                    map_values("flag", {0: "negative", 1: "positive"}).alias("outcome"))


@query("head_n", f"""
SELECT o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_orderkey LIMIT 5""")
def q_head_n(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return rounded(Q.head_n(o, ["o_orderkey"], 5))


@query("tail_n", f"""
SELECT o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_orderkey DESC LIMIT 5""")
def q_tail_n(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return rounded(Q.tail_n(o, ["o_orderkey"], 5))


@query("lookup_items", """
SELECT t.term, p_partkey, p_name FROM part
JOIN (VALUES ('widget'), ('gear'), ('bolt'), ('ring')) t(term)
  ON contains(lower(p_name), lower(t.term))
WHERE p_name IS NOT NULL""")
def q_lookup_items(spark, base):
    p = read_table(spark, base, "part")
    return lookup_items(p, "p_name", ["widget", "gear", "bolt", "ring"], "p_partkey")


@query("union_sources", f"""
SELECT o_orderkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O', 'P')""")
def q_union_sources(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    parts = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return rounded(union_sources(parts))


@query("dedup_rows", "SELECT DISTINCT * FROM lineitem")
def q_dedup_rows(spark, base):
    return Q.dedup_rows(read_table(spark, base, "lineitem"))
