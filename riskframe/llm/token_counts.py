"""Token counts by batch encoding in Arrow functions.

Each Arrow batch returns lengths only.  Texts are cut at safe boundaries into
segments, segments are dealt to encoder batches of about equal bytes, and the
distinct segments of a batch are encoded once: words recur, so most lengths
come from a bounded cache.

A single space between two non-space characters is a safe boundary of this
byte-level BPE: its pattern never lets a piece run across the space from the
left and always starts the next piece with it.  Special strings that hold no
white space are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
CACHE_ENTRIES, BATCH_BYTES = 400_000, 1 << 20


def worker_state(kind: str, key: str, make):
    """``make()``, kept for the life of the Python worker: tasks that follow
    in the same worker find their caches filled.  One object per kind stays."""
    import sys
    import types
    box = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if box.get(kind, (None,))[0] != key:
        box[kind] = (key, make())
    return box[kind][1]


def segments(text: str) -> list[str]:
    """``text`` cut before every safe space (the space is dropped from the
    segments: every segment after the first stands for ``' ' + segment``)."""
    return BOUNDARY.split(text)


def can_split(tokenizer_json: str) -> bool:
    """Whether cutting at single spaces is safe: a byte-level pre-tokenizer
    without prefix space, and no added token that holds white space."""
    import json
    conf = json.loads(tokenizer_json)
    pre = conf.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and conf.get("normalizer") is None
            and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip")
                        for t in conf.get("added_tokens", ())))


class _Lengths:
    """Token lengths of segments, with a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = can_split(self.tok.to_str())
        self.cache: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """Token counts of ``pieces``, in encoder batches of about ``BATCH_BYTES``."""
        out: list[int] = []
        for batch in by_bytes(pieces, BATCH_BYTES):
            out += map(len, self.tok.encode_batch_fast(batch, add_special_tokens=False))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of ``texts``; the cache is keyed by segment without its
        leading space, and the first segment of a text is encoded as it is."""
        if not self.split:
            return self.lengths(texts)
        cut = [segments(t) for t in texts]
        missing = list({p for ps in cut for p in ps[1:]}.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache = {}
            missing = list({p for ps in cut for p in ps[1:]})
        self.cache.update(zip(missing, self.lengths([" " + p for p in missing])))
        heads, get = self.lengths([ps[0] for ps in cut]), self.cache.__getitem__
        return [h + sum(map(get, ps[1:])) for h, ps in zip(heads, cut)]


def by_bytes(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Consecutive groups of texts of about ``limit`` characters each."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def n_tokens_of(tokenizer_path: str):
    """An Arrow function text -> number of tokens (NULL: empty text)."""

    @F.pandas_udf(T.LongType())
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths = worker_state("token lengths", tokenizer_path, lambda: _Lengths(tokenizer_path))
        for s in batches:
            out: list[int] = []
            for group in by_bytes(["" if t is None else t for t in s], 4 * BATCH_BYTES):
                out += lengths.counts(group)
            yield pd.Series(out, dtype="int64")

    return n_tokens


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    NULL texts count as empty, repeated rows are counted each, other columns
    are ignored.  No shuffle: texts go from the scan to the encoder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                      n_tokens_of(tokenizer_path)(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
