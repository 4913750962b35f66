"""Profiles (A3-A15, A17, A18): one aggregate over all columns, then
``unpivot`` to long form -- never a job per column.

Exact quantiles use ``percentile`` (linear interpolation, equal to pandas'
default); ``approx=True`` switches to ``percentile_approx`` whose state is
bounded by its accuracy argument instead of the number of distinct values.
Above ~150 aggregate expressions the aggregate is split in chunks so that
generated code stays within JVM method limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.quality import categorical_columns, numeric_columns, stats

CHUNK = 150
#: Columns of a block of the correlation's sums.
CORR_BLOCK = 64


def _q(c, p, approx):
    if approx:
        return F.percentile_approx(F.col(c).cast("double"), p, 10000).cast("double")
    return F.percentile(F.col(c).cast("double"), p)


def _lit_array(vals):
    return F.array(*[F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in vals])


def _qs(c, probs, approx):
    """All quantiles of one column from ONE aggregate state (an array)."""
    x = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        return F.percentile_approx(x, arr, 10000)
    return F.percentile(x, arr)


def _agg_long(df: DataFrame, names: list[str], per_col) -> DataFrame:
    """Evaluate ``per_col(c) -> {stat: Column}`` for every column in one (or a
    few chunked) aggregates and return ``(column, stat...)`` rows."""
    if not names:
        raise ValueError("no columns to profile")
    stat_names = list(per_col(names[0]).keys())
    per_chunk = max(1, CHUNK // max(1, len(stat_names)))
    out = None
    for i in range(0, len(names), per_chunk):
        chunk = names[i:i + per_chunk]
        exprs = []
        for c in chunk:
            for s, e in per_col(c).items():
                exprs.append(e.alias(f"{s}@@{c}"))
        row = df.agg(*exprs)
        structs = [F.struct(F.lit(c).alias("column"),
                            *[F.col(f"`{s}@@{c}`").alias(s) for s in stat_names])
                   for c in chunk]
        part = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- A3 A4 A5 A17
def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: counts of non-null values, descending (ties: value ascending)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
            .orderBy(F.col("count").desc(), F.col(column).asc()))


def class_distribution(df: DataFrame, label: str, names: dict | None = None) -> DataFrame:
    """A4: class, count, percent of total (1 dp)."""
    total = stats(df, {"n": F.count(F.lit(1))})["n"]
    g = df.groupBy(label).count()
    out = g.withColumn("percent", F.round(F.col("count") * 100.0 / total, 1))
    if names:
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        out = out.withColumn("class", m[F.col(label)])
    return out


def prevalence_by_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """A5: per non-null group: rate = mean(label)*100 rounded to 2 dp, count;
    sorted by rate descending."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.round(F.avg(label) * 100.0, 2).alias("rate"), F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("rate").desc(), F.col(group)))


def class_prevalence(df: DataFrame, label: str) -> DataFrame:
    """Class counts plus the prevalence scalar on every row."""
    prev = stats(df, {"p": F.avg(F.col(label).cast("double"))})["p"]
    return df.groupBy(label).count().withColumn("prevalence", prev)


# ---------------------------------------------------------------- A6
def group_compare(df: DataFrame, label: str, cols=None, a=0, b=1) -> DataFrame:
    """Per numeric column: mean in class ``a``, mean in class ``b``,
    delta = b - a; sorted by |delta| descending."""
    cols = cols if cols is not None else [c for c in numeric_columns(df) if c != label]
    y = F.col(label)
    long = _agg_long(df, cols, lambda c: {
        "mean_a": F.avg(F.when(y == a, F.col(c))),
        "mean_b": F.avg(F.when(y == b, F.col(c)))})
    return (long.withColumn("delta", F.col("mean_b") - F.col("mean_a"))
            .withColumnRenamed("column", "feature")
            .orderBy(F.abs(F.col("delta")).desc_nulls_last(), "feature"))


# ---------------------------------------------------------------- A7 A8 A9 A10
def describe_numeric(df: DataFrame, cols=None, approx: bool = False,
                     method: str = "bounded") -> DataFrame:
    """Count, mean, std (n-1), min, 25 %, 50 %, 75 %, max per column.
    Quartiles: ``method='bounded'`` (exact, bounded state, see
    ``quantiles``), ``'inmemory'`` (Spark ``percentile``) or ``approx``."""
    cols = cols if cols is not None else numeric_columns(df)
    probs = (0.25, 0.5, 0.75)
    if not approx and method == "bounded":
        from riskframe.operators.quantiles import exact_quantiles
        exact = exact_quantiles(df, cols, probs)
        qcol = lambda c: _lit_array(exact[c])
    else:
        qcol = lambda c: _qs(c, probs, approx)
    long = _agg_long(df, cols, lambda c: {
        "count": F.count(c),
        "mean": F.avg(c),
        "std": F.stddev_samp(c),
        "min": F.min(c).cast("double"),
        "qs": qcol(c),
        "max": F.max(c).cast("double")})
    return long.select("column", "count", "mean", "std", "min",
                       *[F.col("qs")[i].cast("double").alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
                       "max")


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """``column, distinct``: distinct non-null values of every column, in one
    shuffle of (column, hash) pairs that are distinct per batch before they
    leave the task; no row is multiplied in the plan.  Values are told apart by
    96 bits of hash.  Columns without a value count 0."""
    cols = list(cols)
    hashed = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")).alias(f"a{i}")
                         for i, c in enumerate(cols)], *[F.hash(f"`{c}`").alias(f"b{i}") for i, c in enumerate(cols)])

    def distinct(batches):
        for batch in batches:
            for i in range(len(cols)):
                pairs = pa.table({"a": batch.column(i), "b": batch.column(len(cols) + i)}) \
                    .filter(batch.column(i).is_valid()).group_by(["a", "b"]).aggregate([])
                yield from pa.table({"col": pa.array([i] * len(pairs), pa.int32()), "a": pairs["a"],
                                     "b": pairs["b"]}).to_batches()

    pairs = hashed.mapInArrow(distinct, "col int, a long, b int").distinct()
    counts = pairs.groupBy("col").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column string")
    return names.join(counts, F.col("i") == F.col("col"), "left").select(
        "column", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"))


def describe_categorical(df: DataFrame, cols=None) -> DataFrame:
    """A8 (categorical part): count, unique, top (ties -> smallest), freq."""
    cols = cols if cols is not None else categorical_columns(df)
    from riskframe.operators.quality import mode_row
    long = _agg_long(df, cols, lambda c: {"count": F.count(c)}).join(
        distinct_counts(df, cols).withColumnRenamed("distinct", "unique"), "column")
    # top value and its frequency: a bounded top-1 over distributed counts
    tops = None
    for c in cols:
        t = mode_row(df, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("top"),
                                   F.col("count").alias("freq"))
        tops = t if tops is None else tops.unionByName(t)
    return long.join(tops, "column", "left")


def describe_all(df: DataFrame, approx: bool = False, method: str = "bounded") -> DataFrame:
    """Numeric describe + categorical describe in one long table."""
    num = describe_numeric(df, approx=approx, method=method).select(
        "column", "count", F.lit(None).cast("long").alias("unique"),
        F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
        "mean", "std", "min", "q25", "q50", "q75", "max")
    cats = categorical_columns(df)
    if not cats:
        return num
    cat = describe_categorical(df, cats).select(
        "column", "count", "unique", "top", "freq",
        *[F.lit(None).cast("double").alias(s) for s in
          ("mean", "std", "min", "q25", "q50", "q75", "max")])
    return num.unionByName(cat)


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Type, non-null count, null % (1 dp), distinct count (NULL excluded)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = _agg_long(df, df.columns, lambda c: {
        "non_null": F.count(c),
        "null_pct": F.round(F.avg(F.col(c).isNull().cast("double")) * 100.0, 1),
        **({"distinct": F.approx_count_distinct(c)} if approx_distinct else {})})
    if not approx_distinct:
        long = long.join(distinct_counts(df, df.columns), "column")
    tmap = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return long.withColumn("dtype", tmap[F.col("column")])


def missingness(df: DataFrame, cols=None, ascending: bool = False) -> DataFrame:
    """A10: percent NULL per column, only columns with NULLs, sorted."""
    cols = cols if cols is not None else df.columns
    long = _agg_long(df, cols, lambda c: {
        "missing_pct": F.avg(F.col(c).isNull().cast("double")) * 100.0})
    long = long.where(F.col("missing_pct") > 0)
    o = F.col("missing_pct").asc() if ascending else F.col("missing_pct").desc()
    return long.orderBy(o, "column")


# ---------------------------------------------------------------- A11
def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation, pairwise-complete (each pair uses the rows
    where both are non-null), long form ``(col_a, col_b, corr)`` with the
    diagonal and both triangles; NULL where it is undefined.

    Blockwise sums per pair of columns (rows, values, squares, products), taken
    of the values less the column's mean: matrix products per batch, added per
    task, then per block of ``CORR_BLOCK`` columns.  One pass after the means,
    whatever the number of columns; a task holds four k x k matrices."""
    cols = list(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    means = df.agg(*[F.avg(F.when(~F.isnan(c), c)).alias(f"m{i}") for i, c in enumerate(x)]).first() if cols else []
    means = np.array([0.0 if m is None else m for m in means])
    k = len(cols)

    def sums(batches):
        total = np.zeros((4, k, k))
        for batch in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - means[:, None]
            have = np.isfinite(v)
            v, have = np.where(have, v, 0.0), have.astype(float)
            total += np.stack([have @ have.T, v @ have.T, (v * v) @ have.T, v @ v.T])
        for at in range(0, k, CORR_BLOCK):
            # a row block of all four, and the transposed block of the sums and squares
            part = np.concatenate([total[:, at:at + CORR_BLOCK], total[1:3, :, at:at + CORR_BLOCK].transpose(0, 2, 1)])
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "sums": pa.array([part.tobytes()])})

    def correlate(block: pa.Table) -> pa.Table:
        at = block.column("at")[0].as_py()
        rows = min(CORR_BLOCK, k - at)
        # fixed order of the sum: one result however tasks are scheduled
        total = np.zeros(6 * rows * k)
        for b in sorted(block.column("sums").to_pylist()):
            total += np.frombuffer(b) if b else 0.0
        n, sx, sxx, sxy, sy, syy = total.reshape(6, rows, k)
        with np.errstate(all="ignore"):
            cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
            # no spread beyond what rounding leaves of equal values
            flat = (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy) | (n < 2)
            corr = np.where(flat, np.nan, np.clip(cov / np.sqrt(vx * vy), -1.0, 1.0))
        own = np.arange(rows)
        corr[own, at + own] = np.where(np.isnan(corr[own, at + own]), np.nan, 1.0)
        return pa.table({"col_a": pa.array(np.repeat(cols[at:at + rows], k).tolist(), pa.string()),
                         "col_b": pa.array(cols * rows, pa.string()),
                         "corr": pa.array(corr.ravel(), pa.float64(), from_pandas=True)})

    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    parts = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)]).mapInArrow(sums, "at int, sums binary")
    # every block answers, also where the table has no partition
    parts = parts.unionByName(df.sparkSession.createDataFrame(
        [(at, bytearray()) for at in range(0, k, CORR_BLOCK)], "at int, sums binary"))
    return parts.groupBy("at").applyInArrow(correlate, "col_a string, col_b string, corr double")


# ---------------------------------------------------------------- A12
def iqr_outliers(df: DataFrame, cols=None, approx: bool = False, k: float = 1.5,
                 method: str = "bounded") -> DataFrame:
    """Bounds q1 - k*IQR, q3 + k*IQR and the count strictly outside;
    NULLs not counted; sorted by count descending.  Pass 1 computes the
    quartiles (scalar subqueries), pass 2 the conditional counts."""
    cols = cols if cols is not None else numeric_columns(df)
    if not approx and method == "bounded":
        from riskframe.operators.quantiles import exact_quantiles
        exact = exact_quantiles(df, cols, (0.25, 0.75))
        st = {c: _lit_array(exact[c]) for c in cols}
    else:
        st = stats(df, {c: _qs(c, (0.25, 0.75), approx) for c in cols})
    bounds = {}
    for c in cols:
        q1, q3 = st[c][0].cast("double"), st[c][1].cast("double")
        bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    flags = df.select(*[((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1]))
                        .cast("int").alias(c) for c in cols])
    long = _agg_long(flags, cols, lambda c: {"outlier_count": F.count(F.when(F.col(c) == 1, 1))})
    lo_map = F.create_map(*[x for c in cols for x in (F.lit(c), bounds[c][0])])
    hi_map = F.create_map(*[x for c in cols for x in (F.lit(c), bounds[c][1])])
    return (long.select(F.col("column").alias("feature"),
                        lo_map[F.col("column")].alias("lower_bound"),
                        hi_map[F.col("column")].alias("upper_bound"), "outlier_count")
            .orderBy(F.col("outlier_count").desc(), "feature"))


# ---------------------------------------------------------------- A13 A14
def histogram_by_class(df: DataFrame, column: str, label: str, bins: int,
                       lo: float | None = None, hi: float | None = None,
                       dense: bool = True) -> DataFrame:
    """Equal-width bins over ``[lo, hi]`` (data min / max when not
    given), the last bin closed; ``(bin, bin_lo, bin_hi, label, count)``.
    Rows with NULL value or label are dropped.  ``dense`` adds empty bins
    (a ``sequence`` of ``bins`` ids per class, bounded by ``bins``)."""
    src = df.where(F.col(column).isNotNull() & F.col(label).isNotNull())
    if lo is None or hi is None:
        st = stats(src, {"lo": F.min(column).cast("double"), "hi": F.max(column).cast("double")})
        lo_c = st["lo"] if lo is None else F.lit(float(lo))
        hi_c = st["hi"] if hi is None else F.lit(float(hi))
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
        src = src.where(F.col(column).between(lo, hi))
    width = (hi_c - lo_c) / bins
    b = F.least(F.floor((F.col(column) - lo_c) / width).cast("int"), F.lit(bins - 1))
    b = F.when(width > 0, b).otherwise(F.lit(0))
    counts = src.groupBy(b.alias("bin"), F.col(label).alias(label)).count()
    if dense:
        classes = src.select(label).distinct()
        grid = classes.select(label, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        counts = grid.join(counts, ["bin", label], "left") \
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)))
    return counts.select("bin", (lo_c + F.col("bin") * width).alias("bin_lo"),
                         (lo_c + (F.col("bin") + 1) * width).alias("bin_hi"), label, "count")


def boxplot_by_class(df: DataFrame, cols, label: str, prefix: str | None = None,
                     approx: bool = False, method: str = "bounded") -> DataFrame:
    """Per (measure, class): min, q1, median, q3, max and whiskers (the
    most extreme values within 1.5 IQR of the box)."""
    long = df.unpivot([label], list(cols), "measure", "value").where(F.col("value").isNotNull())
    if prefix:
        long = long.withColumn("measure", F.regexp_replace("measure", "^" + prefix, ""))
    if not approx and method == "bounded":
        # exact quantiles per (measure, class): keys are bounded by the schema
        from riskframe.operators.quantiles import exact_quantiles_long
        keyed = long.withColumn("__key", F.to_json(F.struct("measure", label)))
        exact = exact_quantiles_long(keyed, "__key", "value", (0.25, 0.5, 0.75))
        qmap = F.create_map(*[x for k, v in exact.items() for x in (F.lit(k), _lit_array(v))])
        box = long.groupBy("measure", label).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
        box = box.withColumn("qs", qmap[F.to_json(F.struct("measure", label))])
    else:
        box = long.groupBy("measure", label).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("min"),
            _qs("value", (0.25, 0.5, 0.75), approx).alias("qs"), F.max("value").alias("max"))
    box = box.select("measure", label, "n", "min",
                     *[F.col("qs")[i].cast("double").alias(n) for i, n in enumerate(("q1", "median", "q3"))],
                     "max")
    # box has one row per (measure, class): bounded by the schema, not the
    # data, so broadcasting it is safe and avoids a join on a handful of keys
    j = long.join(F.broadcast(box.select("measure", label, "q1", "q3")), ["measure", label])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    whisk = j.groupBy("measure", label).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"))
    return box.join(whisk, ["measure", label])


# ---------------------------------------------------------------- A15 A18
def dataset_summary(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns - 1, positives, prevalence."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns) - 1).alias("features"),
                  F.sum(F.col(label).cast("long")).alias("positives"),
                  F.avg(F.col(label).cast("double")).alias("prevalence"))


def step_log(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per named stage, as one lazy table (one job when read)."""
    out = None
    for i, (name, frame) in enumerate(stages):
        part = frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("seq"), F.lit(name).alias("step"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def with_observed_counts(df: DataFrame, name: str):
    """A18 without an extra job: attach an ``Observation`` counting rows as
    they stream through; read ``obs.get`` after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
