"""Feature preparation (M1-M10): routing, stratified split and folds, fitted
preprocessing (median impute + population-sd scaling, one-hot with a NULL
level), class weights, vector assembly, and the full chain.

Scale notes
* ``class_rank`` ranks rows inside each class by ``md5(seed:key)`` in two
  phases: counts per (class, 4-hex-digit bucket) -- at most 65,536 rows per
  class -- give each bucket's offset; ``row_number`` then runs per
  (class, bucket), so no window ever holds a whole class, however skewed
  the label is.  The result is identical to one global row_number.
* fitted statistics stay a one-row DataFrame referenced by scalar
  subqueries; only category levels (bounded by ``max_levels``) and the
  routing decision (one number per feature) reach the driver, because they
  decide the output schema.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators import quality as Q
from riskframe.spec import EngineSpec

NULL_LEVEL = "None"


# ---------------------------------------------------------------- M8 / L2 folds
def hash_of(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_rank(df: DataFrame, label: str, key: str, seed: int = 42,
               prefix_hex: int = 4) -> DataFrame:
    """Add ``__rank`` (1-based rank inside the class by md5(seed:key), ties
    by key) and ``__n`` (class size).  Exact; two phases (see module doc)."""
    d = (df.withColumn("__h", hash_of(key, seed))
         .withColumn("__b", F.conv(F.substring("__h", 1, prefix_hex), 16, 10).cast("int")))
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    offs = (counts
            .withColumn("__off", F.sum("__c").over(Window.partitionBy(label).orderBy("__b")
                                                    .rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("__n", F.sum("__c").over(Window.partitionBy(label)))
            .select(label, "__b", F.coalesce("__off", F.lit(0)).alias("__off"), "__n"))
    # bounded: (#classes x 16**prefix_hex) rows
    j = d.join(F.broadcast(offs), [label, "__b"])
    w = Window.partitionBy(label, "__b").orderBy("__h", key)
    return j.withColumn("__rank", F.col("__off") + F.row_number().over(w)).drop("__off", "__b")


def class_cut(df: DataFrame, label: str, key: str, share: float, seed: int = 42,
              prefix_hex: int = 4) -> DataFrame:
    """Where the first ``round(share * n_class)`` rows of each class end in
    md5(seed:key) order: ``__label, __cut_h, __cut_k`` of the last of them (NULL
    where there is none), one row per class.

    Counts per (class, first hex digits) tell in which bucket each class ends;
    only the rows of those buckets are ranked.  The buckets are written first, so
    that the planner knows how few they are and does not shuffle ``df`` to them."""
    from riskframe.session import materialize
    d = df.select(F.col(label).alias("__label"), F.col(key).alias("__cut_k"), hash_of(key, seed).alias("__cut_h"))
    d = d.withColumn("__b", F.conv(F.substring("__cut_h", 1, prefix_hex), 16, 10).cast("int"))
    counts = d.groupBy("__label", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__label")
    ends = counts.withColumn("__end", F.sum("__c").over(w.orderBy("__b"))) \
        .withColumn("__take", F.round(F.sum("__c").over(w) * F.lit(share)))
    last = ends.where((F.col("__end") >= F.col("__take")) & (F.col("__end") - F.col("__c") < F.col("__take"))) \
        .select(F.col("__label").alias("__l"), F.col("__b").alias("__lb"),
                (F.col("__take") - F.col("__end") + F.col("__c")).alias("__nth"))
    last = materialize(last, "class-ends")
    inside = d.join(last, F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__lb")))
    rank = F.row_number().over(Window.partitionBy("__label").orderBy("__cut_h", "__cut_k"))
    cut = inside.withColumn("__rank", rank).where(F.col("__rank") == F.col("__nth")).select("__label", "__cut_h", "__cut_k")
    classes = counts.select(F.col("__label").alias("__l")).distinct()
    return classes.join(cut, F.col("__l").eqNullSafe(F.col("__label")), "left").select(
        F.col("__l").alias("__label"), "__cut_h", "__cut_k")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2,
                     seed: int = 42, column: str = "split") -> DataFrame:
    """M8 (exact): per class, the first ``round(share * n_class)`` rows in
    md5(seed:key) order are 'test', the rest 'train'.  Rows are not shuffled:
    each is compared with the last test row of its class (one row per class, of
    a label with few values).  Ties of the hash go by key; NULL is a class."""
    from riskframe.session import materialize
    # written: joined as a plan, its size is unknown and all rows of a class would meet in one task
    cut = materialize(class_cut(df, label, key, test_share, seed), "class-cut")
    h, k = hash_of(key, seed), F.col(key)
    before = (h < F.col("__cut_h")) | ((h == F.col("__cut_h")) & (k <= F.col("__cut_k")))
    # no hint: the size of the written table decides
    joined = df.join(cut, F.col(label).eqNullSafe(F.col("__label")), "left")
    return joined.withColumn(column, F.when(before, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("__label", "__cut_h", "__cut_k")


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42,
               column: str = "split") -> DataFrame:
    """M8 (approximate, map-only, not stratified): 'test' when the first 8
    hex digits of md5(seed:key) fall below ``share * 16**8``."""
    cut = format(int(test_share * 16 ** 8), "08x")
    h8 = F.substring(hash_of(key, seed), 1, 8)
    return df.withColumn(column, F.when(h8 < F.lit(cut), F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     column: str = "fold") -> DataFrame:
    """L2 folds: fold = (rank inside class - 1) mod k, so every fold has the
    class shares of the whole (+-1 row)."""
    r = class_rank(df, label, key, seed)
    return r.withColumn(column, ((F.col("__rank") - 1) % k).cast("int")) \
        .drop("__rank", "__n", "__h")


# ---------------------------------------------------------------- M1
def feature_routing(df: DataFrame, cols, max_null: float = 0.5) -> DataFrame:
    """M1: null ratio per feature and its route: 'impute' (<= max_null) or
    'passthrough'.  One aggregate."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "feature", "null_ratio")
    return long.withColumn("route", F.when(F.col("null_ratio") <= max_null, F.lit("impute"))
                           .otherwise(F.lit("passthrough")))


def route_lists(df: DataFrame, cols, max_null: float = 0.5) -> tuple[list, list]:
    """Driver-side lists from M1 (k numbers, k = number of features)."""
    got = {r["feature"]: r["route"] for r in feature_routing(df, cols, max_null).collect()}
    return ([c for c in cols if got[c] == "impute"], [c for c in cols if got[c] == "passthrough"])


# ---------------------------------------------------------------- M10
def class_weights(df: DataFrame, label: str, column: str = "weight") -> DataFrame:
    """Positives weigh neg/pos (1 when there are no positives), others 1."""
    st = Q.stats(df, {"neg": F.count(F.when(F.col(label) == 0, 1)),
                      "pos": F.count(F.when(F.col(label) == 1, 1))})
    ratio = F.when(st["pos"] > 0, st["neg"] / st["pos"]).otherwise(F.lit(1.0))
    return df.withColumn(column, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------- M2-M6
@dataclass
class Preprocessor:
    """Fitted parameters: the routing lists, category levels and a one-row
    statistics frame (``fill__c``, ``mean__c``, ``scale__c``)."""
    num: list
    cat: list
    passthru: list
    binary: list
    levels: dict
    stats: DataFrame | None
    null_as_category: bool = True
    modes: dict = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        names = list(self.num)
        for c in self.cat:
            names += [f"{c}_{v}" for v in self.levels[c]]
        return names + list(self.passthru) + list(self.binary)

    def _stat_cols(self):
        s = self.stats.select(F.struct(*self.stats.columns).alias("s")).scalar()
        return s

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """M2-M5 applied: numeric -> (coalesce(x, fill) - mean) / scale;
        categorical -> one 0/1 column per training level (unknown -> zeros);
        pass-through unchanged (NULL kept); binary as double.  Absent input
        columns (L3b) act as NULL: numeric gets the training median."""
        s = self._stat_cols() if self.num else None
        have = set(df.columns)
        out = [F.col(c) for c in keep]
        for c in self.num:
            x = F.col(c).cast("double") if c in have else F.lit(None).cast("double")
            out.append(((F.coalesce(x, s[f"fill__{c}"]) - s[f"mean__{c}"]) / s[f"scale__{c}"]).alias(c))
        for c in self.cat:
            x = F.col(c) if c in have else F.lit(None).cast("string")
            if self.null_as_category:
                x = F.coalesce(x, F.lit(NULL_LEVEL))
            elif c in self.modes:
                x = F.coalesce(x, F.lit(self.modes[c]))
            for v in self.levels[c]:
                out.append(F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
        for c in self.passthru:
            x = F.col(c) if c in have else F.lit(None)
            out.append(x.cast("double").alias(c))
        for c in self.binary:
            x = F.col(c) if c in have else F.lit(0)
            out.append(x.cast("double").alias(c))
        return df.select(*out)

    def params_table(self) -> DataFrame:
        """K5: long params ``(kind, feature, position, level, fill, mean, scale)``."""
        spark = self.stats.sparkSession
        rows = []
        for i, c in enumerate(self.num):
            rows.append(F.struct(F.lit("num").alias("kind"), F.lit(c).alias("feature"),
                                 F.lit(i).alias("position"),
                                 F.lit(None).cast("string").alias("level"),
                                 F.col(f"fill__{c}").alias("fill"), F.col(f"mean__{c}").alias("mean"),
                                 F.col(f"scale__{c}").alias("scale")))
        numeric = self.stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*") \
            if rows else None
        cat_rows = [(kind, c, i, v) for kind, cols in (("cat", self.cat),)
                    for c in cols for i, v in enumerate(self.levels[c])]
        cat_rows += [("passthru", c, i, None) for i, c in enumerate(self.passthru)]
        cat_rows += [("binary", c, i, None) for i, c in enumerate(self.binary)]
        other = spark.createDataFrame(cat_rows, "kind string, feature string, position int, level string") \
            .select("kind", "feature", "position", "level", F.lit(None).cast("double").alias("fill"),
                    F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("scale"))
        return numeric.unionByName(other) if numeric is not None else other

    def save(self, path: str) -> None:
        """K5: statistics as parquet + a small JSON sidecar for the lists."""
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        meta = {"num": self.num, "cat": self.cat, "passthru": self.passthru,
                "binary": self.binary, "levels": self.levels,
                "null_as_category": self.null_as_category, "modes": self.modes}
        spark = self.stats.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string") \
            .write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "Preprocessor":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        stats = spark.read.parquet(f"{path}/stats")
        return Preprocessor(meta["num"], meta["cat"], meta["passthru"], meta["binary"],
                            meta["levels"], stats, meta["null_as_category"], meta["modes"])


def fit_preprocessor(train: DataFrame, num, cat, passthru, binary,
                     null_as_category: bool = True, max_levels: int = 1000,
                     approx: bool = False, method: str = "bounded") -> Preprocessor:
    """M2-M5 fit on the training rows: exact medians, then mean and
    population sd of the imputed columns (sd 0 -> scale 1); levels sorted."""
    stats = None
    if num:
        if not approx and method == "bounded":
            from riskframe.operators.quantiles import exact_quantiles
            got = exact_quantiles(train, num, (0.5,))
            med = {c: (F.lit(got[c][0]) if got[c][0] is not None else F.lit(None)).cast("double")
                   for c in num}
        else:
            q = (lambda c: F.percentile_approx(F.col(c).cast("double"), 0.5, 10000)) if approx \
                else (lambda c: F.percentile(F.col(c).cast("double"), 0.5))
            med = Q.stats(train, {c: q(c) for c in num})
        imputed = train.select(*[F.coalesce(F.col(c).cast("double"), med[c]).alias(c) for c in num])
        aggs = []
        for c in num:
            aggs += [F.avg(c).alias(f"__mean__{c}"), F.stddev_pop(c).alias(f"__sd__{c}")]
        raw = imputed.agg(*aggs)
        stats = raw.select(*[x for c in num for x in (
            med[c].alias(f"fill__{c}"), F.col(f"__mean__{c}").alias(f"mean__{c}"),
            F.when(F.col(f"__sd__{c}") > 0, F.col(f"__sd__{c}")).otherwise(F.lit(1.0))
            .alias(f"scale__{c}"))])
        # one row, fitted now: scoring must not read the training table again
        stats = train.sparkSession.createDataFrame([tuple(stats.first())], stats.schema)
    levels, modes = {}, {}
    for c in cat:
        src = train.select(F.coalesce(F.col(c), F.lit(NULL_LEVEL)).alias(c)) \
            if null_as_category else train
        levels[c] = [str(v) for v in Q.category_levels(src, c, max_levels)]
        if not null_as_category:
            m = Q.mode_row(train, c).select(c).first()
            m = m[0] if m is not None else None
            if m is not None:
                modes[c] = m
    if stats is None:
        stats = train.sparkSession.range(1).select(F.lit(1).alias("__none"))
    return Preprocessor(list(num), list(cat), list(passthru), list(binary), levels, stats,
                        null_as_category, modes)


def assemble(df: DataFrame, feature_names, output: str = "features",
             sentinel: float | None = -1.0e6) -> DataFrame:
    """M6: ordered feature columns -> one ML vector.  MLlib trees reject
    NaN, so NULL pass-through values become ``sentinel`` (outside every
    valid range; the ``_missing`` indicators still carry missingness).
    The ordered names go into the vector's ML attribute metadata."""
    from pyspark.ml.feature import VectorAssembler
    src = df
    if sentinel is not None:
        src = df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in feature_names})
    va = VectorAssembler(inputCols=list(feature_names), outputCol=output, handleInvalid="keep")
    return va.transform(src)


# ---------------------------------------------------------------- M7
@dataclass
class Prepared:
    table: DataFrame          # key, label, split, weight, feature columns
    preprocessor: Preprocessor
    imputable: list
    passthru: list

    @property
    def feature_names(self):
        return self.preprocessor.feature_names


def engineer(df: DataFrame, spec: EngineSpec, levels: dict | None = None) -> tuple[DataFrame, list, list, list]:
    """F2 -> F7 -> F4 -> F5/F6: validated, lumped, flagged wide table and
    the candidate numeric / categorical / binary lists.  ``levels`` (of a
    fitted preprocessor) fixes the values that lumping keeps."""
    w = Q.validate_ranges(df, spec.valid_ranges)
    if spec.lump_column and spec.lump_column in w.columns:
        w = Q.consolidate_categories(w, spec.lump_column, spec.lump_top_n) if levels is None \
            else Q.lump_to(w, spec.lump_column, levels[spec.lump_column])
    labs = Q.present(w, spec.indicator_columns)
    w = Q.missing_flags(w, labs)
    w = Q.add_row_sum(w, spec.score_parts, spec.score_total)
    w = Q.threshold_flags(w, spec.threshold_flags)
    num = Q.present(w, spec.numeric_features)
    if spec.score_total in w.columns:
        num.append(spec.score_total)
    cat = Q.present(w, spec.categorical_features)
    binary = Q.present(w, spec.binary_features) + Q.present(w, spec.engineered_binary)
    binary += [f"{c}_missing" for c in labs if f"{c}_missing" not in binary]
    return w, num, cat, binary


def prepare_data(df: DataFrame, spec: EngineSpec, materialize: bool = True,
                 null_as_category: bool = True) -> Prepared:
    """M7: engineer -> route (on all rows, before the split) -> stratified
    split -> fit on train -> transform both -> class weight.

    ``materialize`` writes the split engineered table once (parquet under
    ``spark.checkpoint.dir``): it feeds the fit and the transform of both
    parts."""
    from riskframe.session import materialize as write_once
    w, num, cat, binary = engineer(df, spec)
    imputable, passthru = route_lists(w, num, spec.routing_max_null)
    for c in passthru:
        ind = f"{c}_missing"
        if ind not in w.columns:
            w = w.withColumn(ind, F.col(c).isNull().cast("int"))
        if ind not in binary:
            binary.append(ind)
    split = stratified_split(w, spec.label, spec.entity_key, spec.test_share, spec.seed)
    if materialize:
        split = write_once(split, "prepared-split")
    train = split.where(F.col("split") == "train")
    pre = fit_preprocessor(train, imputable, cat, passthru, binary, null_as_category)
    out = pre.transform(split, keep=[spec.entity_key, spec.label, "split"])
    out = class_weights_from(out, train, spec.label)
    if materialize:   # read by training, tuning, scoring and attribution
        out = write_once(out, "prepared")
    return Prepared(out, pre, imputable, passthru)


def class_weights_from(df: DataFrame, train: DataFrame, label: str,
                       column: str = "weight") -> DataFrame:
    """M10 with the ratio taken on ``train`` and applied to ``df``."""
    st = Q.stats(train, {"neg": F.count(F.when(F.col(label) == 0, 1)),
                         "pos": F.count(F.when(F.col(label) == 1, 1))})
    ratio = F.when(st["pos"] > 0, st["neg"] / st["pos"]).otherwise(F.lit(1.0))
    return df.withColumn(column, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))
