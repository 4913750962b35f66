"""Registered queries: sources and sinks.

Each round trip writes the given table under the session's shared
checkpoint folder (``spark.checkpoint.dir``; a fresh path per call) and
reads it back through the engine's readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.plans.oracle_base import r, with_wide
from riskframe.plans.q_report import _METRIC_CTES, _full_sql, _metrics
from riskframe.plans.registry import query, rounded
from riskframe.session import scratch_path
from riskframe.sources import readers as S
from riskframe.sources import sinks as K

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])

ORDERS_SQL = (f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice, "
              "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")


def _orders_out(df):
    return rounded(df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))


@query("parquet_roundtrip", ORDERS_SQL)
def q_parquet_roundtrip(spark, base):
    path = scratch_path(spark, "orders_parquet")
    K.write_parquet(S.read_table(spark, base, "orders"), path)
    return _orders_out(spark.read.parquet(path))


@query("csv_roundtrip", ORDERS_SQL)
def q_csv_roundtrip(spark, base):
    path = scratch_path(spark, "orders_csv")
    K.write_csv(S.read_table(spark, base, "orders"), path)
    back = S.scan_csv(spark, path, schema=ORDERS_SCHEMA)
    return _orders_out(back)


@query("scan_csv", ORDERS_SQL)
def q_scan_csv(spark, base):
    """S1 + S4: the file exists only as ``.csv.gz``; the scan falls back to
    it and applies the typed schema."""
    path = scratch_path(spark, "orders")
    K.write_csv(S.read_table(spark, base, "orders"), path + ".csv.gz", compression="gzip")
    back = S.scan_csv(spark, path + ".csv", schema=ORDERS_SCHEMA)
    return _orders_out(back)


@query("read_any", f"""
SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment, 'parquet' AS via FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')}, c_mktsegment, 'csv' FROM customer""")
def q_read_any(spark, base):
    """S6 + S7: suffix dispatch; the CSV side is read with inferred types."""
    cust = S.read_table(spark, base, "customer")
    root = scratch_path(spark, "customer")
    K.write_parquet(cust, root + "/customer.PARQUET")
    K.write_csv(cust, root + "/customer_csv")
    a = S.read_any(spark, root + "/customer.PARQUET").withColumn("via", F.lit("parquet"))
    b = S.read_any(spark, root + "/customer_csv").withColumn("via", F.lit("csv"))
    b = b.select(*[F.col(c).cast(cust.schema[c].dataType) for c in cust.columns], "via")
    return rounded(a.unionByName(b))


@query("json_roundtrip", with_wide(
    "SELECT " + ", ".join(f"{r(c)} AS {c}" for c in
                          ["auroc", "sensitivity", "specificity", "precision", "f1", "brier_score",
                           "threshold"]) + " FROM mt", *_METRIC_CTES))
def q_json_roundtrip(spark, base):
    """K3 + S10: metrics written as a JSON record and read back."""
    path = scratch_path(spark, "metrics_json")
    K.write_json(_metrics(spark, base), path)
    back = S.read_json_records(spark, path)
    return rounded(back.select("auroc", "sensitivity", "specificity", "precision", "f1",
                               "brier_score", "threshold"))


@query("text_report", "SELECT CASE WHEN key = '' THEN value ELSE key || ': ' || value END AS value FROM ("
       + _full_sql().split("\n", 1)[0] + "\n" + _full_sql().split("\n", 1)[1] + ")")
def q_text_report(spark, base):
    """K6: the full report written as ordered text lines and read back."""
    from riskframe.operators.report import full_report
    from riskframe.plans.analytic import analytic_dataset
    from riskframe.spec import tpch_binding
    rep = full_report(analytic_dataset(spark, base), "flag", _metrics(spark, base), tpch_binding())
    path = scratch_path(spark, "report_txt")
    K.write_text_report(rep, path)
    return spark.read.text(path)


@query("union_csv_parquet", f"""
SELECT o_orderkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_orderstatus, {r('o_totalprice')} FROM orders WHERE o_orderstatus <> 'F'""")
def q_union_csv_parquet(spark, base):
    """U1 across formats: one status from CSV, the rest from parquet."""
    o = S.read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    path = scratch_path(spark, "orders_f_csv")
    K.write_csv(o.where(F.col("o_orderstatus") == "F"), path)
    f = S.scan_csv(spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double")
    return rounded(S.union_sources([f, o.where(F.col("o_orderstatus") != "F")]))
