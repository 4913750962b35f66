"""Sinks (K1-K6).  Every sink writes in parallel from the executors; the only
single-file sink is the text report, whose rows are bounded by the report
layout (a few dozen lines), not by the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K1: overwrite, no index column."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


TS_WRITE = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """K2: header, NULL written as the empty field, timestamps in one fixed
    text format (read back by ``readers.TS_READ``)."""
    w = (df.write.mode("overwrite").option("header", True)
         .option("nullValue", "").option("emptyValue", "\"\"")
         .option("timestampFormat", TS_WRITE).option("timestampNTZFormat", TS_WRITE))
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K3: JSON lines (metrics, feature names, base value are 1-row frames)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text_report(report: DataFrame, path: str) -> None:
    """K6: a ``(section, seq, key, value)`` report as ordered text lines.

    Reports hold a bounded number of rows (the layout, not the data, sets
    it), so a single ordered output file is safe here.
    """
    lines = report.select(
        "section", "seq",
        F.when(F.col("key") == "", F.col("value"))
         .otherwise(F.concat_ws(": ", "key", "value")).alias("value"))
    (lines.repartition(1).sortWithinPartitions("section", "seq").select("value")
     .write.mode("overwrite").text(path))
