"""Validation and cleaning.

Fitted statistics (median, mean, mode, min/max, mean/sd) are computed by one
global aggregate and referenced through scalar subqueries
(``DataFrame.scalar()``).  Catalyst merges the subqueries of one aggregate
into a single job, the result is a single row by construction, and nothing
is collected to the driver or cross-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import scalar as S

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


# ---------------------------------------------------------------- P3 column sets
def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns (ids and label included unless excluded)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def present(df: DataFrame, cols) -> list[str]:
    """Keep-if-present (silently skip absent columns)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def stats(df: DataFrame, aggs: dict[str, Column]) -> dict[str, Column]:
    """One global aggregate -> ``{name: scalar-subquery Column}``."""
    if not aggs:
        return {}
    row = df.agg(F.struct(*[e.alias(k) for k, e in aggs.items()]).alias("s"))
    s = row.select("s").scalar()
    return {k: s[k] for k in aggs}


# ---------------------------------------------------------------- F2-F7
def validate_ranges(df: DataFrame, ranges) -> DataFrame:
    """values outside inclusive ``[lo, hi]`` become NULL."""
    todo = {c: S.in_range_or_null(c, lo, hi) for c, lo, hi in ranges if c in df.columns}
    return df.withColumns(todo) if todo else df


def clip_ranges(df: DataFrame, ranges) -> DataFrame:
    """Clip to ``[lo, hi]``; NULL stays NULL."""
    todo = {c: S.clip(c, lo, hi) for c, lo, hi in ranges if c in df.columns}
    return df.withColumns(todo) if todo else df


def missing_flags(df: DataFrame, cols, suffix: str = "_missing") -> DataFrame:
    """``<col>_missing`` = 1 when NULL."""
    todo = {f"{c}{suffix}": S.is_missing(c) for c in cols if c in df.columns}
    return df.withColumns(todo) if todo else df


def add_row_sum(df: DataFrame, parts, total: str) -> DataFrame:
    """``total`` = sum of present parts, NULL only when all are NULL."""
    cols = present(df, parts)
    return df.withColumn(total, S.row_sum(cols)) if cols else df


def threshold_flags(df: DataFrame, flags) -> DataFrame:
    """0/1 flags; NULL input -> 0."""
    todo = {t.name: S.flag(t.column, t.op, t.value) for t in flags if t.column in df.columns}
    return df.withColumns(todo) if todo else df


def top_categories(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-null values (ties: value ascending)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
            .orderBy(F.col("count").desc(), F.col(column).asc()).limit(n))


def consolidate_categories(df: DataFrame, column: str, n: int = 5,
                           other: str = "Other") -> DataFrame:
    """keep the top-``n`` values (counted on the whole input), else
    ``other``; NULL -> ``other``.  Case-sensitive.  The top list has at most
    ``n`` rows, so broadcasting it is bounded by ``n``, not by the data."""
    top = top_categories(df, column, n).select(F.col(column).alias("__top"))
    j = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")
    return j.withColumn(column, F.when(F.col("__top").isNotNull(), F.col(column))
                        .otherwise(F.lit(other))).drop("__top")


def lump_to(df: DataFrame, column: str, levels, other: str = "Other") -> DataFrame:
    """F7 with the kept values fixed (e.g. those of the training table), so
    that a new table is lumped without counting anything."""
    kept = [v for v in levels if v != other]
    return df.withColumn(column, F.when(F.col(column).isin(kept), F.col(column)).otherwise(F.lit(other)))


def out_of_range(df: DataFrame, ranges) -> DataFrame:
    """Per ranged column, count of non-null values outside ``[lo, hi]``;
    only columns with a positive count.  One pass."""
    rs = [(c, lo, hi) for c, lo, hi in ranges if c in df.columns]
    aggs = [F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(c) for c, lo, hi in rs]
    wide = df.agg(*aggs)
    bounds = F.create_map(*[x for c, lo, hi in rs
                            for x in (F.lit(c), F.array(F.lit(float(lo)), F.lit(float(hi))))])
    long = wide.unpivot([], [c for c, _, _ in rs], "column", "n_out")
    return (long.where(F.col("n_out") > 0)
            .select("column", bounds[F.col("column")][0].alias("lo"),
                    bounds[F.col("column")][1].alias("hi"), "n_out"))


# ---------------------------------------------------------------- C1-C6
def impute_median(df: DataFrame, cols=None, exclude=(), approx: bool = False,
                  method: str = "bounded") -> DataFrame:
    """NULL -> exact median.  ``method='bounded'`` selects it exactly
    with bounded state (``quantiles``); ``'inmemory'`` uses Spark's
    ``percentile``; ``approx=True`` uses ``percentile_approx``."""
    cols = cols if cols is not None else numeric_columns(df, exclude)
    if not cols:
        return df
    if not approx and method == "bounded":
        from riskframe.operators.quantiles import exact_quantiles
        med = exact_quantiles(df, cols, (0.5,))
        st = {c: F.lit(med[c][0]).cast("double") for c in cols}
    else:
        agg = (lambda c: F.percentile_approx(c, 0.5, 10000)) if approx \
            else (lambda c: F.percentile(c, 0.5))
        st = stats(df, {c: agg(c) for c in cols})
    return df.withColumns({c: _filled(df, c, st[c]) for c in cols})


def _filled(df: DataFrame, c: str, value):
    """NULL -> ``value``; an integral column becomes double, as its mean or
    median need not be integral."""
    kind = df.schema[c].dataType
    kind = T.DoubleType() if isinstance(kind, T.IntegralType) else kind
    return F.coalesce(F.col(c).cast(kind), value.cast(kind))


def impute_mean(df: DataFrame, cols=None, exclude=()) -> DataFrame:
    """NULL -> mean."""
    cols = cols if cols is not None else numeric_columns(df, exclude)
    st = stats(df, {c: F.avg(c) for c in cols})
    return df.withColumns({c: _filled(df, c, st[c]) for c in cols}) if cols else df


def mode_row(df: DataFrame, column: str) -> DataFrame:
    """Most frequent non-null value (ties -> smallest) and its count, as one
    row.  Counting is a distributed group-by (partial aggregation) and the
    pick is a top-1 (each task keeps one row), so no task ever holds every
    distinct value -- unlike the ``mode`` aggregate."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
            .orderBy(F.col("count").desc(), F.col(column).asc()).limit(1))


def impute_mode(df: DataFrame, cols=None, exclude=()) -> DataFrame:
    """NULL -> most frequent value (ties -> smallest); an all-NULL
    column is left as is."""
    cols = cols if cols is not None else categorical_columns(df, exclude)
    st = {c: mode_row(df, c).select(c).scalar() for c in cols}
    return df.withColumns({c: F.coalesce(F.col(c), st[c]) for c in cols}) if cols else df


def minmax_scale(df: DataFrame, cols=None, exclude=()) -> DataFrame:
    """C4: (x - min) / (max - min); constant / all-NULL columns untouched."""
    cols = cols if cols is not None else numeric_columns(df, exclude)
    aggs = {}
    for c in cols:
        aggs[f"{c}__lo"] = F.min(c).cast("double")
        aggs[f"{c}__hi"] = F.max(c).cast("double")
    st = stats(df, aggs)
    out = {}
    for c in cols:
        lo, hi = st[f"{c}__lo"], st[f"{c}__hi"]
        out[c] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c).cast("double"))
    return df.withColumns(out) if out else df


def zscore(df: DataFrame, cols=None, exclude=()) -> DataFrame:
    """(x - mean) / sample sd; sd NULL or 0 -> untouched."""
    cols = cols if cols is not None else numeric_columns(df, exclude)
    aggs = {}
    for c in cols:
        aggs[f"{c}__mu"] = F.avg(c)
        aggs[f"{c}__sd"] = F.stddev_samp(c)
    st = stats(df, aggs)
    out = {}
    for c in cols:
        mu, sd = st[f"{c}__mu"], st[f"{c}__sd"]
        out[c] = F.when(sd > 0, (F.col(c) - mu) / sd).otherwise(F.col(c).cast("double"))
    return df.withColumns(out) if out else df


def category_levels(df: DataFrame, column: str, max_levels: int = 1000) -> list:
    """Distinct non-null levels, ascending.  Output columns depend on the
    data, so this is the one bounded collect of the cleaning family: at
    most ``max_levels + 1`` values reach the driver, else an error."""
    got = (df.select(column).where(F.col(column).isNotNull()).distinct()
           .orderBy(column).limit(max_levels + 1).collect())
    if len(got) > max_levels:
        raise ValueError(f"{column}: more than {max_levels} levels; one-hot refused")
    return [r[0] for r in got]


def one_hot(df: DataFrame, cols=None, exclude=(), levels: dict | None = None,
            max_levels: int = 1000, drop: bool = True) -> DataFrame:
    """``<col>_<level>`` 0/1 columns for every level (none dropped);
    NULL -> all zeros; levels ascending.  ``levels`` fixes them up front
    (e.g. learned on a training split)."""
    cols = cols if cols is not None else categorical_columns(df, exclude)
    levels = dict(levels or {})
    new = {}
    for c in cols:
        lv = levels.get(c)
        if lv is None:
            lv = category_levels(df, c, max_levels)
        for v in lv:
            new[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    out = df.withColumns(new) if new else df
    return out.drop(*cols) if drop else out


# ---------------------------------------------------------------- P8-P12
def drop_null_subset(df: DataFrame, cols) -> DataFrame:
    """P8."""
    return df.dropna(how="any", subset=list(cols))


def dropna_any(df: DataFrame) -> DataFrame:
    """P9 / C7."""
    return df.dropna(how="any")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup (partial dedup on the map side, then one
    exchange on the row hash)."""
    return df.dropDuplicates()


def head_n(df: DataFrame, order, n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit key order (TakeOrderedAndProject:
    each task keeps ``n`` rows, the driver merges ``n x tasks``)."""
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def tail_n(df: DataFrame, order, n: int = 5) -> DataFrame:
    """Last ``n`` rows by the key order (reverse order + limit)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


# ---------------------------------------------------------------- C10
STEPS = ("dropna", "impute_median", "impute_mean", "impute_mode", "clip", "minmax",
         "zscore", "one_hot", "dedup")


FITTED = ("impute_median", "impute_mean", "impute_mode", "minmax", "zscore", "one_hot")


def clean(df: DataFrame, steps, exclude=(), clip_ranges_=(),
          materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply cleaning steps in the given order.

    Numeric / categorical column sets are frozen once, before the first
    step (so one-hot columns are not rescaled).  Returns the cleaned frame
    and its step log ``(seq, step, rows, columns)``.

    With ``materialize`` (default) the table is written under
    ``spark.checkpoint.dir`` where steps that change rows (dropna, dedup) end,
    and once at the end; the log's counts are observed in these writes.  Steps
    between them share passes: means, deviations and ranges are carried from
    step to step (``cleaning``).  An input that is no table of
    ``session.materialize`` is written first if steps fit statistics.  Without
    it nothing but the ranges of medians and the category counts is written, and
    the log is one lazy aggregate per stage.

    A column without values is neither filled nor scaled, a constant one not
    scaled; so is one whose values are not all finite.  An empty table stays
    empty.  A second ``dropna`` finds nothing: no step makes NULLs.
    """
    from riskframe.operators.cleaning import run_chain
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown cleaning step {unknown[0]!r}; known: {STEPS}")
    return run_chain(df, list(steps), numeric_columns(df, exclude), categorical_columns(df, exclude),
                     clip_ranges_, materialize)
