"""Evaluation (L4-L10) of a score column against a 0/1 label.

Everything reduces first: conditional counts in one aggregate (threshold
metrics, threshold search, confusion matrix) or counts per distinct score
(AUROC, ROC, PR).  Curves need running totals over the ordered distinct
scores; ``prefix_sums`` computes them in two phases (range-partitioned
per-partition totals + broadcast offsets), so no window ever runs
un-partitioned over a large input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.quality import stats
from riskframe.operators.quantiles import ranged


def _safe_div(a, b, default=0.0):
    return F.when(b > 0, a / b).otherwise(F.lit(default))


# ---------------------------------------------------------------- reductions
def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(score, pos, neg)`` per distinct non-null score."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
                 F.count(F.when(F.col(label) != 1, 1)).alias("neg")))


def prefix_sums(df: DataFrame, order: str, cols: list[str], descending: bool = False,
                inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """Running totals of ``cols`` in numeric ``order`` (unique values), as
    ``cum_<c>``: the rows are range-partitioned by the order key and written
    once, totals per range give the offsets of the ranges before (one row per
    range), and a window runs inside each range only.  ``buckets`` fixes the
    number of ranges; by default it follows the data."""
    key = -F.col(order) if descending else F.col(order)
    d = ranged(df.withColumn("__k", key.cast("double")), ["__k"], "prefix", buckets)
    totals = d.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    prev = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offs = totals.select("__p", *[F.coalesce(F.sum(f"__t_{c}").over(prev), F.lit(0))
                                  .alias(f"__o_{c}") for c in cols])
    frame = (Window.partitionBy("__p").orderBy("__k")
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = d.join(offs, "__p")
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(frame), F.lit(0)))
    return out.drop("__p", "__k", *[f"__o_{c}" for c in cols])


# ---------------------------------------------------------------- L5 parts
def confusion_counts(df: DataFrame, score: str, label: str, threshold) -> DataFrame:
    """One row: tp, fp, tn, fn at ``score >= threshold`` (a number or Column)."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return df.agg(F.count(F.when(pred & y, 1)).alias("tp"),
                  F.count(F.when(pred & ~y, 1)).alias("fp"),
                  F.count(F.when(~pred & ~y, 1)).alias("tn"),
                  F.count(F.when(~pred & y, 1)).alias("fn"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under ROC, ties counted 1/2: one row ``auroc``."""
    sc = score_counts(df, score, label)
    cum = prefix_sums(sc, "score", ["neg"], inclusive=False)   # negatives strictly below
    return cum.agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg")))
         / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def evaluate(df: DataFrame, score: str, label: str, threshold) -> DataFrame:
    """Auroc, sensitivity, specificity, precision (0 when undefined), f1,
    brier_score, threshold -- one row.

    ``threshold`` may be a number or a one-row scalar subquery (e.g. from
    ``optimal_threshold``).  Spark only accepts the subquery inside the
    aggregates when its input is deterministic: score a model once, write
    the scores (``session.materialize``) and evaluate the written table."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    cc = confusion_counts(df, score, label, t)
    # one-row aggregates referenced as scalar subqueries (no join needed)
    brier = df.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("b")).select("b").scalar()
    area = auroc(df, score, label).select("auroc").scalar()
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    sens = _safe_div(tp, tp + fn)
    prec = _safe_div(tp, tp + fp)
    row = cc.select(area.alias("auroc"), sens.alias("sensitivity"),
                    _safe_div(tn, tn + fp).alias("specificity"), prec.alias("precision"),
                    _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), brier.alias("brier_score"))
    return row.withColumn("threshold", t.cast("double"))


# ---------------------------------------------------------------- L4
def threshold_table(df: DataFrame, score: str, label: str,
                    grid=tuple(range(1, 50)), scale: int = 100) -> DataFrame:
    """Per grid threshold i/scale: tp, fp, fn, sensitivity, precision, f1.
    One aggregate with 2 x len(grid) conditional counts (no join)."""
    y = F.col(label) == 1
    aggs = [F.count(F.when(y, 1)).alias("P")]
    for i in grid:
        t = i / scale
        aggs.append(F.count(F.when((F.col(score) >= t) & y, 1)).alias(f"tp{i}"))
        aggs.append(F.count(F.when((F.col(score) >= t) & ~y, 1)).alias(f"fp{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(i / scale).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                        F.col(f"fp{i}").alias("fp"), (F.col("P") - F.col(f"tp{i}")).alias("fn"))
               for i in grid]
    long = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return long.select("threshold", "tp", "fp", "fn",
                       _safe_div(tp, tp + fn).alias("sensitivity"),
                       _safe_div(tp, tp + fp).alias("precision"),
                       _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def optimal_threshold(df: DataFrame, score: str, label: str, min_sensitivity: float = 0.80,
                      default: float = 0.5) -> DataFrame:
    """L4: the grid threshold with the highest F1 among those with
    sensitivity >= target (lowest threshold wins ties); else the one with the
    highest sensitivity; else ``default``.  One row:
    ``threshold, f1, sensitivity, method``."""
    tab = threshold_table(df, score, label)
    feas = tab.where((F.col("sensitivity") >= min_sensitivity) & (F.col("f1") > 0)) \
        .select("threshold", "f1", "sensitivity", F.lit("f1").alias("method"), F.lit(1).alias("__p"),
                F.row_number().over(Window.orderBy(F.col("f1").desc(), "threshold")).alias("__r"))
    fall = tab.where(F.col("sensitivity") > 0) \
        .select("threshold", "f1", "sensitivity", F.lit("sensitivity").alias("method"),
                F.lit(2).alias("__p"),
                F.row_number().over(Window.orderBy(F.col("sensitivity").desc(), "threshold")).alias("__r"))
    dflt = df.sparkSession.range(1).select(
        F.lit(float(default)).alias("threshold"), F.lit(None).cast("double").alias("f1"),
        F.lit(None).cast("double").alias("sensitivity"), F.lit("default").alias("method"),
        F.lit(3).alias("__p"), F.lit(1).alias("__r"))
    # every input here has at most len(grid) rows
    allc = feas.where("__r = 1").unionByName(fall.where("__r = 1")).unionByName(dflt)
    return allc.orderBy("__p").limit(1).drop("__p", "__r")


# ---------------------------------------------------------------- L6 L7
def classification_report(df: DataFrame, score: str, label: str, threshold) -> DataFrame:
    """Per class precision / recall / f1 / support, then accuracy,
    macro avg and weighted avg rows (sklearn layout)."""
    cc = confusion_counts(df, score, label, threshold)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1, f1_0 = _safe_div(2 * p1 * r1, p1 + r1), _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    rows = [
        ("0", p0, r0, f1_0, s0),
        ("1", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _safe_div(tp + tn, n), n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
         _safe_div(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support")) for k, p, r, f, s in rows]
    return cc.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def confusion_matrix(df: DataFrame, score: str, label: str, threshold=0.5) -> DataFrame:
    """Dense 2 x 2 ``(actual, predicted, count)`` (empty cells = 0)."""
    cc = confusion_counts(df, score, label, threshold)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    structs = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
               for a, p, c in cells]
    return cc.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- L8 L9
def _curve_base(df, score, label):
    sc = score_counts(df, score, label)
    cum = prefix_sums(sc, "score", ["pos", "neg"], descending=True)
    tot = stats(sc, {"P": F.sum("pos"), "N": F.sum("neg")})
    return cum, tot


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score (descending) plus the origin:
    ``(threshold, fpr, tpr)``; threshold NULL stands for +infinity."""
    cum, tot = _curve_base(df, score, label)
    pts = cum.select(F.col("score").alias("threshold"),
                     (F.col("cum_neg") / tot["N"]).alias("fpr"),
                     (F.col("cum_pos") / tot["P"]).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, ending with
    the (precision 1, recall 0) point (threshold NULL)."""
    cum, tot = _curve_base(df, score, label)
    pts = cum.select(F.col("score").alias("threshold"),
                     (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                     (F.col("cum_pos") / tot["P"]).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# ---------------------------------------------------------------- L10
def calibration(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Uniform bins over [0, 1]; bin id = number of inner edges strictly
    below the score (an edge value belongs to the lower bin); empty bins
    are absent.  ``(bin, mean_predicted, fraction_positive, count)``."""
    edges = [i * (1.0 + 1e-8) / n_bins for i in range(1, n_bins)]
    b = sum((F.col(score) > e).cast("int") for e in edges)
    return (df.where(F.col(score).isNotNull())
            .groupBy(b.alias("bin"))
            .agg(F.avg(score).alias("mean_predicted"),
                 F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("count")))
