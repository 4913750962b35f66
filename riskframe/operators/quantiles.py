"""Exact ranks at any size: one primitive for quantiles and running totals.

Values are counted per distinct (key, value), range-partitioned by it and
written once with the number of their partition.  Totals per partition give
every partition's offset; only the partitions that hold a needed rank are
ordered, each on its own.  No task sees more than its range, the number of
ranges follows Spark's shuffle partitions, and only totals per range and the
picked values reach the driver.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize


def ranged(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with its range
    number ``__p`` (equal rows share a range; ranges ascend)."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialize(dealt.withColumn("__p", F.spark_partition_id()), name)


def _ranks(n: int, probs):
    out = []
    for p in probs:
        pos = (n - 1) * p
        out.append((pos, int(math.floor(pos)), int(math.ceil(pos))))
    return out


def order_statistics(long: DataFrame, need) -> dict:
    """``{(key, rank): value}`` for ``long`` (``__k``, ``__v`` not NULL).

    ``need(counts)`` gets ``{key: rows}`` and returns ``{key: 0-based ranks}``."""
    pairs = ranged(long.groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("__n")), ["__k", "__v"], "ranks")
    totals: dict[str, list] = {}
    for r in pairs.groupBy("__k", "__p").agg(F.sum("__n").alias("n")).collect():
        totals.setdefault(r["__k"], []).append((r["__p"], r["n"]))
    wanted, offset = [], {}
    ranks = need({k: sum(n for _, n in t) for k, t in totals.items()})
    for k, rs in ranks.items():
        parts, ends, acc = sorted(totals[k]), [], 0
        for _, n in parts:
            acc += n
            ends.append(acc)
        for rank in rs:
            i = bisect_right(ends, rank)
            before = ends[i - 1] if i else 0
            wanted.append((k, parts[i][0], rank - before))
            offset[(k, parts[i][0])] = before
    if not wanted:
        return {}
    rows = long.sparkSession.createDataFrame(wanted, "k string, p int, r long")
    some = pairs.where(F.col("__p").isin(sorted({p for _, p, _ in wanted})))
    w = Window.partitionBy("__k", "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("__end", F.sum("__n").over(w))
    hit = some.join(rows, (F.col("__k") == F.col("k")) & (F.col("__p") == F.col("p"))
                    & (F.col("r") < F.col("__end")) & (F.col("r") >= F.col("__end") - F.col("__n")))
    return {(r["k"], r["r"] + offset[(r["k"], r["p"])]): r["__v"] for r in hit.select("k", "p", "r", "__v").collect()}


def exact_quantiles_long(long: DataFrame, key: str, value: str, probs) -> dict:
    """Exact quantiles of ``value`` per ``key`` (column names, class labels):
    ``{key: [q(p) for p in probs]}`` with linear interpolation as pandas,
    DuckDB ``quantile_cont`` and Spark ``percentile``.  NULLs are ignored; a
    key without values is missing."""
    src = long.select(F.col(key).cast("string").alias("__k"), F.col(value).cast("double").alias("__v")) \
        .where(F.col("__v").isNotNull())
    plan: dict[str, list] = {}

    def need(counts):
        plan.update({k: _ranks(n, probs) for k, n in counts.items()})
        return {k: sorted({r for _, lo, hi in items for r in (lo, hi)}) for k, items in plan.items()}

    got = order_statistics(src, need)
    # Spark ``percentile`` interpolation (same rounding path)
    return {k: [got[(k, lo)] if hi == lo else (hi - pos) * got[(k, lo)] + (pos - lo) * got[(k, hi)]
                for pos, lo, hi in items] for k, items in plan.items()}


def exact_quantiles(df: DataFrame, cols, probs) -> dict:
    """Exact quantiles per column: {column: [q(p) for p in probs]}."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")) \
        .select("s.k", "s.v")
    got = exact_quantiles_long(long, "k", "v", probs)
    return {c: got.get(c, [None] * len(probs)) for c in cols}
