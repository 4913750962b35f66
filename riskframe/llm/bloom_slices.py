"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` turns documents into blocks, one row per block.  A block holds
documents of one size class: their ids and lengths, a Bloom signature of each
document cut into bit slices (slice ``p`` is a bitmap over the block's
documents: who has bit ``p`` set), and the exact term counts by a dictionary of
the block.  A signature holds a key per distinct term and per level of its
count (``LEVELS``), so that it bounds the count and not just the presence.

``search`` bounds every document for every item: the AND of a term's slices is
a bitmap that holds every document with the term (and a few more), and the sum
of the weighted slices is an upper bound of the score.  Documents whose bound
reaches the k-th best exact score found so far in the task are rescored exactly
from the block's term counts; all others are proven to be outside the task's k
best.  The k best of each task meet in one ranking per item.

Nothing is shuffled but those k best.  Items travel with the tasks in blocks of
bounded size, each against the whole index; the index is written once under
``spark.checkpoint.dir``.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import shared_table

#: A term with count tf sets a key for every level up to tf.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Bits set per key; signature bits per key (a power of two of bits, so 8 to 16).
PROBES, BITS_PER_KEY = 3, 8
#: Documents and slice bits of a block; term hashes a worker remembers.
BLOCK_DOCS, BLOCK_BITS, CACHE_TERMS = 512, 1 << 22, 500_000
#: Bytes of item texts that travel with a task.
QUERY_BYTES = 1 << 21

#: Bytes to terms: separators become blanks, A-Z become a-z, the rest stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32
             for b in range(256))

BLOCK = ("docs int, terms long, n binary, vocab binary, df binary, ends binary, place binary, tf binary, "
         "width int, slices binary")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(FOLD).split()


class TermHashes(dict):
    """Term -> 64-bit hash, with a bounded memory."""

    def __missing__(self, term: bytes) -> int:
        import xxhash
        if len(self) >= CACHE_TERMS:
            self.clear()
        self[term] = h = xxhash.xxh3_64_intdigest(term)
        return h


def probes(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``PROBES`` bit places of (term, level) keys in signatures of ``width`` bits."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        step = (x >> np.uint64(32)) | np.uint64(1)
        places = [(x + np.uint64(j) * step) & np.uint64(width - 1) for j in range(PROBES)]
    return np.stack(places).astype(np.int64)


def small(a: np.ndarray) -> np.ndarray:
    """``a`` in the narrowest unsigned type that holds it (at least one byte)."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def unpack(data: bytes, count: int, kind=None) -> np.ndarray:
    """The ``count`` numbers packed in ``data``; without ``kind`` their width tells the type."""
    return np.frombuffer(data, kind or f"u{max(1, len(data) // max(1, count))}")


def pack_block(rows: list, width: int) -> dict:
    """The columns of one block; ``rows`` are (id, length, term hashes, counts)."""
    size = np.array([len(h) for _, _, h, _ in rows])
    hashes, tf = np.concatenate([h for _, _, h, _ in rows]), np.concatenate([c for _, _, _, c in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    vocab, place = np.unique(hashes, return_inverse=True)
    bits = np.zeros((width, -(-len(rows) // 8) * 8), bool)
    for i, level in enumerate(LEVELS):
        has = tf >= level
        if not has.any():
            break
        bits[probes(hashes[has], i, width), doc[has]] = True
    n = np.array([m for _, m, _, _ in rows], np.int64)
    return {"ids": [i for i, _, _, _ in rows], "docs": len(rows), "terms": int(n.sum()), "n": n.tobytes(),
            "vocab": vocab.tobytes(), "df": np.bincount(place).astype(np.int32).tobytes(),
            "ends": np.cumsum(size).astype(np.int64).tobytes(), "place": small(place).tobytes(),
            "tf": small(tf).tobytes(), "width": width, "slices": np.packbits(bits, axis=1).tobytes()}


def _blocks_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    hashes, open_ = TermHashes(), {}

    def done(width):
        return pa.RecordBatch.from_pylist([pack_block(open_.pop(width), width)], schema=schema)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = Counter(terms_of(text.as_py() or b""))
            if not counts:
                continue
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            keys = sum(int((tf >= level).sum()) for level in LEVELS)
            width = max(256, 1 << (BITS_PER_KEY * keys - 1).bit_length())
            block = open_.setdefault(width, [])
            block.append((key, int(tf.sum()), np.array([hashes[t] for t in counts], np.uint64), tf))
            if len(block) >= min(BLOCK_DOCS, max(1, BLOCK_BITS // width)):
                yield done(width)
    for width in list(open_):
        yield done(width)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of ``docs``: one row per block.

    Every row is a document of its own, also where ids or texts repeat or ids
    are NULL.  Texts that are NULL, empty or without a term are not indexed:
    they count in no statistic and never rank.  Other columns are ignored."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string(BLOCK).fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    src = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    return shared_table(src.mapInArrow(lambda batches: _blocks_of(batches, arrow), schema), "bloom-index")


# ------------------------------------------------------------------ items
@dataclass
class Items:
    """A bounded block of items against one index: distinct terms (sorted
    hashes) with weights, and each item's terms with multiplicities."""
    numbers: list
    hashes: np.ndarray
    weights: np.ndarray
    places: list
    times: list
    documents: int
    length: int


def make_items(texts: list[tuple[int, str | None]]) -> Items:
    counted = [(q, Counter(terms_of((t or "").encode("utf-8", "surrogatepass")))) for q, t in texts]
    counted = [(q, c) for q, c in counted if c]
    of = TermHashes()
    hashes = np.unique(np.array([of[t] for _, c in counted for t in c], np.uint64))
    places = [np.searchsorted(hashes, np.array([of[t] for t in c], np.uint64)) for _, c in counted]
    times = [np.fromiter(c.values(), np.int64, len(c)) for _, c in counted]
    return Items([q for q, _ in counted], hashes, np.zeros(len(hashes), np.int64), places, times, 0, 0)


def weight_of(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def document_frequencies(index: DataFrame, hashes: np.ndarray) -> dict[int, int]:
    """Documents per place in ``hashes``: summed per task, then over tasks."""

    def count(batches):
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for vocab, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vocab, df = np.frombuffer(vocab, np.uint64), np.frombuffer(df, np.int32)
                at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
                total += np.where(vocab[at] == hashes, df[at], 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["t", "df"])

    rows = index.select("vocab", "df").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return {r["t"]: r["df"] for r in rows.collect()}


# ------------------------------------------------------------------ search
def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class BlockScorer:
    """Bounds and exact scores of one block's documents."""

    def __init__(self, row: dict, items: Items):
        self.items, self.docs = items, row["docs"]
        self.n = np.frombuffer(row["n"], np.int64)
        # Python integers: 25 * n * N may pass 64 bits
        self.m = np.array([75 + 25 * int(n) * items.documents // items.length for n in self.n], np.int64)
        self.row = row

    def bounds(self) -> np.ndarray:
        """Upper bounds, items x documents: the weighted sums of the slices."""
        row, items = self.row, self.items
        width = row["width"]
        slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)

        def bitmaps(hashes, level):
            at = probes(hashes, level, width)
            out = slices[at[0]]
            for more in at[1:]:
                out &= slices[more]
            return out

        maps = bitmaps(items.hashes, 0)
        some = np.flatnonzero(maps.any(axis=1))
        maps, lut = maps[some], np.full(len(items.hashes), -1)
        lut[some] = np.arange(len(some))
        tops = [min(nxt - 1 for nxt in LEVELS[i + 1:]) if i + 1 < len(LEVELS) else None for i in range(len(LEVELS))]
        caps = [saturation(self.n if t is None else np.minimum(t, self.n), self.m) for t in tops]
        gain = np.unpackbits(maps, axis=1, count=self.docs) * caps[0].astype(np.float64)
        rows = np.arange(len(some))
        for i in range(1, len(LEVELS)):
            maps = maps & bitmaps(items.hashes[some[rows]], i)   # a higher level needs all lower ones
            live = maps.any(axis=1)
            rows, maps = rows[live], maps[live]
            if not len(rows):
                break
            gain[rows] += np.unpackbits(maps, axis=1, count=self.docs) * (caps[i] - caps[i - 1]).astype(np.float64)
        out = np.zeros((len(items.numbers), self.docs))
        for q, (place, times) in enumerate(zip(items.places, items.times)):
            at = lut[place]
            has = at >= 0
            if has.any():
                out[q] = (times[has] * items.weights[place[has]]).astype(np.float64) @ gain[at[has]]
        return out

    def counts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of the items' terms in ``docs``: (row per term or -1, rows x docs)."""
        row, items = self.row, self.items
        vocab, ends = np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["ends"], np.int64)
        total = int(ends[-1])
        place, tf = unpack(row["place"], total), unpack(row["tf"], total)
        at = np.minimum(np.searchsorted(vocab, items.hashes), len(vocab) - 1)
        found = np.flatnonzero(vocab[at] == items.hashes)
        of_vocab, of_term = np.full(len(vocab), -1), np.full(len(items.hashes), -1)
        of_vocab[at[found]] = of_term[found] = np.arange(len(found))
        starts = np.concatenate(([0], ends[:-1]))[docs]
        size = ends[docs] - starts
        entry = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        col, term = np.repeat(np.arange(len(docs)), size), of_vocab[place[entry]]
        out, hit = np.zeros((len(found), len(docs)), np.int64), term >= 0
        out[term[hit], col[hit]] = tf[entry[hit]]
        return of_term, out

    def exact(self, wanted: list[np.ndarray]) -> list[np.ndarray]:
        """Exact scores of the documents ``wanted`` of each item."""
        docs = np.unique(np.concatenate(wanted))
        of_term, counts = self.counts(docs)
        out = []
        for q, mine in enumerate(wanted):
            score = np.zeros(len(mine), np.int64)
            if len(mine):
                at = of_term[self.items.places[q]]
                has = at >= 0
                w = self.items.times[q][has] * self.items.weights[self.items.places[q][has]]
                tf = counts[at[has]][:, np.searchsorted(docs, mine)]
                score = w @ saturation(tf, self.m[mine][None, :])
            out.append(score)
        return out


class Best:
    """The k best documents of each item so far; equal scores by id, NULL ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(items)], np.ones(items)

    def add(self, q: int, ids: list, docs: np.ndarray, scores: np.ndarray) -> None:
        new = [(-int(s), ids[d] is None, ids[d]) for d, s in zip(docs, scores) if s >= self.least[q]]
        if new:
            rows = self.rows[q] = sorted(self.rows[q] + new, key=lambda r: r[:2] + (() if r[1] else r[2:]))[:self.k]
            if len(rows) == self.k:
                self.least[q] = -rows[-1][0]


def search_block(row: dict, items: Items, best: Best) -> int:
    """Add a block's documents to ``best``; returns how many were rescored."""
    scorer = BlockScorer(row, items)
    bounds, k = scorer.bounds(), best.k
    seeds = []
    for q in range(len(items.numbers)):     # the best bounds first: they raise the bar for the rest
        live = np.flatnonzero(bounds[q] >= best.least[q])
        seeds.append(live[np.argpartition(-bounds[q][live], k - 1)[:k]] if len(live) > k else live)
    rescored = 0
    while any(map(len, seeds)):
        rescored += sum(map(len, seeds))
        for q, (docs, scores) in enumerate(zip(seeds, scorer.exact(seeds))):
            best.add(q, row["ids"], docs, scores)
            bounds[q][docs] = -1
        seeds = [np.flatnonzero(bounds[q] >= best.least[q]) for q in range(len(items.numbers))]
    return rescored


def _search_items(index: DataFrame, items: Items, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc", kind),
                           T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        best = Best(len(items.numbers), k)
        for batch in batches:
            for i in range(batch.num_rows):
                search_block(batch.slice(i, 1).to_pylist()[0], items, best)
        rows = [(items.numbers[q], r[2], -r[0]) for q, found in enumerate(best.rows) for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)],
                                         schema=arrow)

    return index.mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text",
           doc_name: str = "doc_id") -> DataFrame:
    """``<id>, rank, doc_id, score``: the ``k`` best documents of each row of
    ``queries`` with a score above 0, by score, then by ascending id (NULL last).

    Every row of ``queries`` is an item of its own, also where ids repeat; items
    without a term get no rows, nor does anything on an empty index."""
    spark = index.sparkSession
    doc = index.schema["ids"].dataType.elementType
    asked = shared_table(queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"),
                                        F.col(text_col).alias("text")), "search-items")
    documents, length = index.agg(F.sum("docs"), F.sum("terms")).first()
    found = spark.createDataFrame([], T.StructType([T.StructField("q", T.LongType()), T.StructField("doc", doc),
                                                    T.StructField("score", T.LongType())]))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES)) if documents else 0
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).select("q", "text").collect()
        items = make_items([(r["q"], r["text"]) for r in mine])
        if not items.numbers:
            continue
        items.documents, items.length = documents, length
        for t, df in document_frequencies(index, items.hashes).items():
            items.weights[t] = weight_of(documents, df)
        found = found.unionByName(_search_items(index, items, k))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(asked.select("q", "item"), "q")
            .select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_name), "score"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
dt AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
st AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dt),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM dt) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, st GROUP BY t, nd),
q AS (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT q.item_id, dt.doc_id, dt.r,
        CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * dt.n * st.nd) // st.l)))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) JOIN dt USING (r) CROSS JOIN st GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
