"""Report tables (G1-G4): ``(section, seq, key, value)`` rows built from
one-row result frames (metrics, summaries) and long profile tables, so a
report is a small lazy DataFrame; K6 writes it as ordered text lines.
Numbers are formatted only here (F14); every other table keeps numbers
numeric.  The generation timestamp is left to the writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import round_half_up
from riskframe.spec import EngineSpec


def fmt(x, decimals: int = 4):
    """Fixed-decimals text of a double, rounded half-up first."""
    return F.format_string(f"%.{decimals}f", round_half_up(x, decimals))


def pct(x, decimals: int = 2):
    """``x`` (a share) as a percentage string."""
    return F.concat(fmt(x * 100.0, decimals), F.lit("%"))


def thousands(x):
    return F.format_number(x, 0)


def _rows(frame: DataFrame, section: str, items) -> DataFrame:
    structs = [F.struct(F.lit(section).alias("section"), F.lit(i + 1).alias("seq"),
                        F.lit(k).alias("key"), v.cast("string").alias("value"))
               for i, (k, v) in enumerate(items)]
    return frame.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _gate(x, target):
    return F.when(x >= target, F.lit(" [PASS]")).otherwise(F.lit(" [BELOW TARGET]"))


def performance_report(metrics: DataFrame, spec: EngineSpec) -> DataFrame:
    """G1: the L5 metrics with PASS / BELOW gates (F13) and the targets."""
    m = [("AUROC", F.concat(fmt(F.col("auroc")), _gate(F.col("auroc"), spec.auroc_target))),
         ("Sensitivity", F.concat(fmt(F.col("sensitivity")),
                                  _gate(F.col("sensitivity"), spec.sensitivity_target))),
         ("Specificity", fmt(F.col("specificity"))),
         ("Precision", fmt(F.col("precision"))),
         ("F1 Score", fmt(F.col("f1"))),
         ("Brier Score", fmt(F.col("brier_score"))),
         ("Threshold", fmt(F.col("threshold"), 2))]
    t = [("AUROC target", F.lit(f">= {spec.auroc_target}")),
         ("Sensitivity target", F.lit(f">= {spec.sensitivity_target}"))]
    return _rows(metrics, "metrics", m).unionByName(_rows(metrics, "targets", t))


def dataset_report(df: DataFrame, label: str) -> DataFrame:
    """Summary (rows, features, positives, prevalence), missing share of
    every column with NULLs (in schema order), and the column listing."""
    summ = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"),
                  F.avg(F.col(label).cast("double")).alias("prev"))
    s = _rows(summ, "summary", [("Total entities", thousands(F.col("n"))),
                                ("Total features", F.lit(str(len(df.columns) - 1))),
                                ("Positive cases", thousands(F.col("pos"))),
                                ("Prevalence", pct(F.col("prev")))])
    miss = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i + 1))])
    m = (miss.unpivot([], df.columns, "key", "share").where(F.col("share") > 0)
         .select(F.lit("missing").alias("section"), pos[F.col("key")].alias("seq"), "key",
                 F.concat(fmt(F.col("share") * 100.0, 1), F.lit("%")).alias("value")))
    cols = df.sparkSession.createDataFrame(
        [("columns", i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "section string, seq int, key string, value string")
    return s.unionByName(m).unionByName(cols)


def importance_report(importance: DataFrame) -> DataFrame:
    """Ranked feature importances."""
    return importance.select(F.lit("importance").alias("section"), F.col("rank").alias("seq"),
                             F.col("feature").alias("key"), fmt(F.col("importance")).alias("value"))


def full_report(df: DataFrame, label: str, metrics: DataFrame, spec: EngineSpec,
                algorithm: str = "Gradient-boosted trees (Spark MLlib)") -> DataFrame:
    """Configuration, dataset summary and result metrics."""
    spark = df.sparkSession
    cfg = spark.createDataFrame(
        [("config", 1, "Algorithm", algorithm),
         ("config", 2, "Test split", f"{round(spec.test_share * 100)}%"),
         ("config", 3, "Random state", str(spec.seed)),
         ("config", 4, "AUROC target", f">= {spec.auroc_target}"),
         ("config", 5, "Sensitivity target", f">= {spec.sensitivity_target}")],
        "section string, seq int, key string, value string")
    summ = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"),
                  F.avg(F.col(label).cast("double")).alias("prev"))
    ds = _rows(summ, "dataset", [("Entities", thousands(F.col("n"))),
                                 ("Positive cases", thousands(F.col("pos"))),
                                 ("Prevalence", pct(F.col("prev")))])
    res = _rows(metrics, "results", [(c, fmt(F.col(c))) for c in
                                     ("auroc", "sensitivity", "specificity", "precision", "f1",
                                      "brier_score", "threshold")])
    return cfg.unionByName(ds).unionByName(res)
