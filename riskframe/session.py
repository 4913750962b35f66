"""Session helpers.

The library never creates a session behind the caller's back; these are for
tests, the bench and command-line use.  On a cluster the session comes from
the platform and only ``checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine is designed around (all are ordinary Spark SQL confs).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "riskframe",
                  checkpoint_dir: str = "/tmp/riskframe-checkpoints") -> SparkSession:
    """A local session for tests / bench: UI off, AQE on, UTC.

    ``checkpoint_dir`` is used only when neither Spark's defaults nor the
    context name a folder (one machine, so a local path is shared)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "16g")
               # per-expression Python call-site capture doubles plan-building time
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    A folder the platform already gave the context is kept; otherwise the
    session's ``spark.checkpoint.dir`` is registered.  Without either there
    is no folder that all executors share, so this raises instead of falling
    back to a machine-local one."""
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        raise RuntimeError("no shared checkpoint folder: start Spark with "
                           "spark.checkpoint.dir=<folder all executors share>, or call "
                           "SparkContext.setCheckpointDir first")
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local
    on a cluster), for tables written to cut lineage or round-trip tests."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as parquet under the shared
    checkpoint folder and reading it back.

    One pass (an eager ``Dataset.checkpoint`` evaluates its plan twice
    unless persisted), columnar on disk (later scans prune columns and push
    filters), and it survives executor loss because the files live in the
    cluster's shared folder, never in a machine-local one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    out = spark.read.parquet(path)
    out.scratch_table = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``materialize`` wrote, in whatever store they are."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside the block are deleted at its
    end, but for those given to the function it yields: these must not depend
    on the others any more, which holds for written tables."""
    scopes = _scopes.__dict__.setdefault("open", [])
    written, kept = [], set()
    scopes.append(written)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch_table)
        return table

    try:
        yield keep
    finally:
        scopes.remove(written)
        discard(spark, *(p for p in written if p not in kept))
        for scope in scopes[-1:]:
            scope.extend(p for p in written if p in kept)
