"""Streaming.

The original tool has no streaming logic (no watermark, window or state):
its chunked reader is bounded batch, and Spark's partitioned scan replaces
it.  What a streaming deployment needs is the *same* batch scoring path
(L3 + F10-F12) applied to entities as they arrive; ``scoring`` provides that
adapter and adds no new semantics.
"""

from riskframe.streaming.scoring import score_stream

__all__ = ["score_stream"]
