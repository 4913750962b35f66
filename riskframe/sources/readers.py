"""Sources (S1-S11): typed, column-pruned scans; NaN -> NULL at every source."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn floating NaN into SQL NULL (Spark sorts NaN above every number,
    so ``max`` and ``>`` would otherwise change meaning)."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    todo = [c for c in (columns or df.columns) if c in floats]
    if not todo:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in todo})


def read_table(spark: SparkSession, base: str, name: str,
               columns: list[str] | None = None, nan: bool = False) -> DataFrame:
    """Parquet scan of ``base/name.parquet``; ``columns`` prunes the read schema.

    NaN becomes NULL.  ``nan=True`` leaves it, for callers that filter on a
    floating column (so that the filter reaches the scan) and test it there."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df if nan else nan_to_null(df)


TS_READ = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _try_csv(spark: SparkSession, path: str, schema, header: bool, infer: bool,
             timestamp_format: str | None) -> DataFrame:
    fmt = timestamp_format or TS_READ
    reader = (spark.read.option("header", header).option("mode", "FAILFAST")
              .option("timestampNTZFormat", fmt).option("timestampFormat", fmt))
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    return reader.csv(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, infer: bool = False,
             timestamp_format: str | None = None) -> DataFrame:
    """CSV scan with ``.gz`` fallback.

    Tries ``path`` and then ``path + '.gz'``; raises FileNotFoundError when
    neither exists.  An explicit schema keeps string codes as strings (no
    lost leading zeros) and parses timestamps; without one, ``infer=True``
    gives the ad-hoc behaviour.  Gzip is not splittable: land such a file
    once as parquet before repeated use.
    """
    last: Exception | None = None
    for candidate in (path, path + ".gz"):
        try:
            df = _try_csv(spark, candidate, schema, header, infer, timestamp_format)
            df.schema  # resolves the file listing: fails fast when absent
            return nan_to_null(df)
        except AnalysisException as exc:  # PATH_NOT_FOUND
            if "PATH_NOT_FOUND" not in str(exc) and "Path does not exist" not in str(exc):
                raise
            last = exc
    raise FileNotFoundError(f"Not found: {path} or {path}.gz") from last


def read_any(spark: SparkSession, path: str, **csv_opts) -> DataFrame:
    """Scan by location (S7): a ``.parquet`` suffix (any case) reads parquet,
    anything else reads CSV with a header and inferred types."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    csv_opts.setdefault("infer", True)
    return scan_csv(spark, path, **csv_opts)


def optional_source(spark: SparkSession, path: str, fmt: str = "parquet",
                    schema: T.StructType | str | None = None, **opts) -> DataFrame | None:
    """Optional source (S8).  With ``schema`` the result has its columns and
    types in any case: read from ``path`` (columns it lacks are NULL), or empty
    when the location is absent, so that callers join and aggregate it without a
    branch.  Without ``schema`` an absent location gives ``None``."""
    try:
        if fmt == "csv":
            df = scan_csv(spark, path, **opts)
        else:
            df = spark.read.format(fmt).options(**opts).load(path)
            df.schema
            df = nan_to_null(df)
    except (AnalysisException, FileNotFoundError) as exc:
        if isinstance(exc, AnalysisException) and "PATH_NOT_FOUND" not in str(exc) \
                and "Path does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], schema) if schema is not None else None
    if schema is None:
        return df
    typed = spark.createDataFrame([], schema).schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in typed])


def read_json_records(spark: SparkSession, path: str,
                      schema: T.StructType | str | None = None) -> DataFrame:
    """Records-JSON / metrics-JSON reader (S10); bare NaN tokens -> NULL.

    JSON lines are read line by line; a file that holds one array or one
    record over several lines is told by its first line."""
    head = spark.read.text(path).where(F.trim("value") != "").first()
    reader = spark.read.option("multiLine", head is not None and not _is_record(head["value"])) \
        .option("allowNonNumericNumbers", True)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.json(path))


def _is_record(line: str) -> bool:
    """Whether a line is one whole JSON object."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def tolerant(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A scan that skips truncated / corrupt files.  Only this read is
    tolerant; ``skipped_files`` tells what it left out.  Without it a scan
    fails fast."""
    reader = spark.read.format(fmt).option("ignoreCorruptFiles", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def skipped_files(df: DataFrame) -> DataFrame:
    """Listed files of a scan that gave no row: skipped or empty ones."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string")
    return listed.join(df.select(F.input_file_name().alias("file")).distinct(), "file", "left_anti")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of several scans by column name; missing columns -> NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
