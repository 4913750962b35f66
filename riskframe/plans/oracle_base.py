"""Shared DuckDB oracle fragments (independent SQL formulations)."""

# The wide analytic table, written directly in SQL.
WIDE_CTE = """
wide AS (
  WITH li AS (
    SELECT l_orderkey, max(l_shipdate) AS discharge,
           min(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS lab_a,
           min(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS lab_n,
           min(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS lab_r
    FROM lineitem GROUP BY l_orderkey),
  fk AS (
    SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R'
      AND ((l_linestatus = 'F' AND regexp_matches(p_brand, '^Brand#1[0-9]$') AND p_type = 'PROMO')
        OR (l_linestatus = 'O' AND starts_with(p_brand, 'Brand#7')))),
  ev AS (
    SELECT user_id,
           min(CASE WHEN event_type = 'click' THEN value END) AS sub_click,
           min(CASE WHEN event_type = 'view' THEN value END) AS sub_view,
           min(CASE WHEN event_type = 'purchase' THEN value END) AS sub_purchase,
           min(CASE WHEN event_type = 'signup' THEN value END) AS sub_signup
    FROM events GROUP BY user_id),
  ek AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
  SELECT o.o_custkey, o.o_orderkey, o.o_orderpriority, o.o_orderstatus,
         (epoch_us(li.discharge) - epoch_us(o.o_orderdate)) / 86400000000.0 AS los_days,
         nullif(c.c_mktsegment, 'HOUSEHOLD') AS segment, c.c_acctbal,
         CASE WHEN fk.l_orderkey IS NULL THEN 0 ELSE 1 END AS flag,
         CASE WHEN ek.user_id IS NULL THEN 0 ELSE 1 END AS err_flag,
         li.lab_a, li.lab_n, li.lab_r, ev.sub_click, ev.sub_view, ev.sub_purchase, ev.sub_signup
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN fk ON fk.l_orderkey = o.o_orderkey
  LEFT JOIN ev ON ev.user_id = o.o_custkey
  LEFT JOIN ek ON ek.user_id = o.o_custkey
  WHERE c.c_acctbal >= 0
)"""

NUMERIC = ["c_acctbal", "los_days", "lab_a", "lab_n", "lab_r",
           "sub_click", "sub_view", "sub_purchase", "sub_signup"]

# valid ranges of the binding (inclusive)
RANGES = [("los_days", 0, 2000), ("lab_a", 1000, 100000), ("lab_n", 1000, 100000),
          ("lab_r", 1000, 100000), ("sub_click", 0.5, 15), ("sub_view", 0.5, 15),
          ("sub_purchase", 0.5, 15), ("sub_signup", 0.5, 15), ("c_acctbal", 0, 9000)]

# the fixed evaluation score of the binding (equal in both engines)
SCORE_SQL = ("round(1 / (1 + exp(-(-2.6 + 0.00005 * coalesce(lab_r, 36000) "
             "- 0.0001 * c_acctbal))), 4)")


def with_wide(body: str, *ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return f"WITH {WIDE_CTE}{extra}\n{body}"


def r(expr: str, digits: int = 6) -> str:
    """Round like ``registry.round_half_up`` (and fold -0.0)."""
    x = f"CAST({expr} AS DOUBLE)"
    s = f"1e{digits}"
    whole = max(1e12, 2.0 ** 52 / 10 ** digits)
    return f"(CASE WHEN abs({x}) < {whole!r} THEN floor({x} * {s} + 0.5) / {s} ELSE {x} END + 0.0)"
