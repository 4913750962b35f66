"""Shape operators: distinct keys (A1), EAV pivot with min (A2/R1), joins
(J1-J3), melt (R2), dictionary lookup (P6).

Scale notes
* ``eav_pivot_min`` is one hash aggregation with partial (map-side)
  aggregation, so a hot key collapses to one row per map task before the
  shuffle: one exchange, against two for ``GroupedData.pivot``.
* Joins carry no broadcast hints: AQE switches to a broadcast join only when
  the runtime size of a side is under ``autoBroadcastJoinThreshold`` (a
  checked bound), and otherwise keeps a sort-merge join whose skewed
  partitions are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """A1: distinct non-null keys (optionally of the rows matching ``where``)."""
    src = df.where(where) if where is not None else df
    return src.select(key).where(F.col(key).isNotNull()).distinct()


def eav_pivot_min(df: DataFrame, key: str, code: str, value: str,
                  codes: dict, extra_aggs: list[Column] | None = None) -> DataFrame:
    """A2: long (key, code, value) -> one row per key with ``min(value)`` per
    known code (``codes`` maps code value -> output column).

    Rows with a NULL key or value are ignored.  The schema is fixed by
    ``codes``: a code with no rows gives an all-NULL column.  ``extra_aggs``
    fold further per-key aggregates into the same single pass.
    """
    src = df.where(F.col(key).isNotNull())
    if not extra_aggs:
        # pushes ``In(code, ...)`` and ``IsNotNull(value)`` into the scan
        src = src.where(F.col(code).isin(list(codes)) & F.col(value).isNotNull())
    aggs = [F.min(F.when(F.col(code) == F.lit(c), F.col(value))).alias(name)
            for c, name in codes.items()]
    return src.groupBy(key).agg(*aggs, *(extra_aggs or []))


def flag_join(left: DataFrame, keys: DataFrame, left_key: str, flag_name: str,
              key: str | None = None) -> DataFrame:
    """Left join to distinct keys; ``flag_name`` = 1 when matched else 0.
    Left cardinality is unchanged because ``keys`` is made distinct."""
    key = key or left_key
    k = keys.select(F.col(key).alias("__fk")).distinct().withColumn("__hit", F.lit(1))
    out = left.join(k, F.col(left_key) == F.col("__fk"), "left")
    return out.withColumn(flag_name, F.coalesce(F.col("__hit"), F.lit(0))).drop("__fk", "__hit")


def left_join(left: DataFrame, right: DataFrame, left_key: str,
              right_key: str | None = None) -> DataFrame:
    """Many-to-one left join on one key; the right key is dropped."""
    right_key = right_key or left_key
    if right_key == left_key:
        return left.join(right, left_key, "left")
    return left.join(right, F.col(left_key) == F.col(right_key), "left").drop(right_key)


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """R2: wide -> long."""
    return df.unpivot(ids, values, var, value)


def lookup_items(dictionary: DataFrame, label: str, terms: list[str],
                 key: str) -> DataFrame:
    """Case-insensitive substring lookup of each term in a dictionary's
    ``label`` column; NULL labels never match.  The terms side is a literal
    list (bounded by the caller), so the non-equi match is a broadcast
    nested-loop join that streams the dictionary once."""
    spark = dictionary.sparkSession
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    d = dictionary.select(key, label).where(F.col(label).isNotNull())
    cond = F.contains(F.lower(F.col(label)), F.lower(F.col("term")))
    return d.join(F.broadcast(t), cond, "inner").select("term", key, label)
