"""Apply a batch DataFrame -> DataFrame function (e.g. preprocess + score +
rules) to every micro-batch of a stream.

Stateless per row, so no watermark or state store is involved.  Output is
written per batch id with overwrite semantics, so a micro-batch replayed
after a failure replaces its own output instead of duplicating it; progress
lives in ``checkpoint_location`` (a shared folder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], sink_path: str,
                 checkpoint_location: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that writes ``fn(batch)`` to ``sink_path/batch_id=N``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
