"""Query registry: each registered query is a Spark callable ``(spark, base)``
plus (when SQL can express it) an independent DuckDB oracle string.

The callable and its oracle sit next to each other in the ``q_*`` modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6

from riskframe.functions.scalar import round_half_up  # noqa: E402


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL string."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round double columns (and -0.0 -> 0.0) so two engines hash alike."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all():
    """Import every query module so the registry is filled."""
    from riskframe.plans import (q_boost, q_evaluate, q_features, q_io, q_model,  # noqa: F401
                                 q_profile, q_quality, q_report, q_shape)
    return QUERIES, ORACLE
