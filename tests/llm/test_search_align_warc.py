"""Bloom-slice search, token alignment and WARC bundles against brute force,
round trips and edge cases (NULLs, empty and long texts, ties, repeated rows,
empty tables, extra columns)."""

import hashlib
import io
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import public_tokenizers  # noqa: E402

from riskframe.llm import bloom_slices, token_alignment, warc_bundles  # noqa: E402
from riskframe.session import scratch_path  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ search
def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, ids string, q string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")
    index = bloom_slices.build_index(d.repartition(5))
    return sorted((tuple(r) for r in bloom_slices.search(index, q, k).collect()), key=str), index


def test_search_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(150)] + ["Straße", "ÉCOLE", "日本", "x1"]
    text = lambda n: " ".join(rng.choice(vocab[:rng.choice([5, 40, len(vocab)])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(400)]
    docs += [(None, text(9)), (None, None), (1000, ""), (1001, " .,;-\x00 "), (1002, "W1" * 50), (5, docs[5][1])]
    docs += [(2000 + i, "the very same words w1 w2") for i in range(60)]           # ties and copies
    docs += [(3000, " ".join(vocab) + " w3" * 200_000)]                           # a very long text
    items = [(i, text(rng.randint(1, 12))) for i in range(25)]
    items += [(90, "the very same words"), (91, None), (92, ""), (93, "unseen"), (90, "w1 W1, w1"), (None, "w7")]
    got, _ = found(spark, docs, items)
    assert got == brute_search(docs, items, 20)


def test_bounds_hold_and_exclude(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(f"t{min(int(rng.expovariate(0.01)), 3000)}" for _ in range(60))) for i in range(3000)]
    items = [(i, " ".join(rng.sample(docs[i][1].split(), 8))) for i in range(10)]
    got, index = found(spark, docs, items, 5)
    assert got == brute_search(docs, items, 5)
    it = bloom_slices.make_items(items)
    it.documents, it.length = index.agg({"docs": "sum"}).first()[0], index.agg({"terms": "sum"}).first()[0]
    for t, df in bloom_slices.document_frequencies(index, it.hashes).items():
        it.weights[t] = bloom_slices.weight_of(it.documents, df)
    rescored, best = 0, bloom_slices.Best(10, 5)
    for row in (r.asDict() for r in index.collect()):
        scorer = bloom_slices.BlockScorer(row, it)
        every = [np.arange(row["docs"])] * 10
        assert all((b >= s).all() for b, s in zip(scorer.bounds(), scorer.exact(every)))
        rescored += bloom_slices.search_block(row, it, best)
    assert rescored < 10 * 3000 / 4


def test_search_on_empty_tables(spark):
    assert found(spark, [], [(1, "a b")])[0] == [] and found(spark, [(1, "a b")], [])[0] == []
    assert found(spark, [(1, None)], [(1, "a")])[0] == []
    # one document: a term all documents hold still weighs ln(4/3)
    assert found(spark, [(1, "a")], [(7, "a")])[0] == brute_search([(1, "a")], [(7, "a")], 20)


def test_items_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(f"v{rng.randint(0, 60)}" for _ in range(20))) for i in range(100)]
    items = [(i, f"v{i} v{i + 1} v{i + 2}") for i in range(40)]
    monkeypatch.setattr(bloom_slices, "QUERY_BYTES", 100)
    assert found(spark, docs, items)[0] == brute_search(docs, items, 20)


# ------------------------------------------------------------------ alignment
def test_galloping_alignment_equals_enumeration():
    rng = random.Random(4)
    for _ in range(300):
        lists, base, first = ([], []), 0, ([0], [0])
        for _ in range(rng.randint(1, 12)):            # stretches, one after the other
            n = rng.randint(1, 40)
            for side, most in ((0, n), (1, max(1, n // rng.choice([1, 8])))):
                lists[side].extend(base + v for v in sorted({*rng.sample(range(1, n + 1), rng.randint(1, most)), n}))
                first[side].append(len(lists[side]))
            base += n
        a, b = lists
        rank, common = token_alignment.align(*map(np.array, (a, b, *first)))
        assert rank.tolist() == [sum(v < x for v in b) for x in a] and common.tolist() == [x in b for x in a]
        values = np.array([rng.randint(0, base + 2) for _ in range(20)])
        starts = np.array([rng.randint(0, len(a)) for _ in values])
        assert token_alignment.gallop(np.array(a), values, starts).tolist() == [
            next((i for i in range(s, len(a)) if a[i] >= v), len(a)) for v, s in zip(values, starts)]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    ta, tb = Tokenizer.from_file(BPE), SentencePieceProcessor(model_file=PIECES)
    ta.encode_special_tokens = True
    alphabet, name = token_alignment.byte_alphabet(), {i: t for t, i in ta.get_vocab().items()}
    spell_a = lambda i: bytes(alphabet[c] for c in name[i])
    spell_b = lambda i: (bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i)
                         else tb.id_to_piece(i).replace("▁", " ").encode())
    rows, held = [], Counter()
    for text in texts:
        data, ids_a, ids_b = (" " + (text or "")).encode(), [], []
        if text:
            ids_a, ids_b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
        a, b = [*map(spell_a, ids_a)], [*map(spell_b, ids_b)]
        if b"".join(a) != data or b"".join(b) != data:
            rows.append(None)
            continue
        ea, eb = np.cumsum([*map(len, a)]).tolist(), np.cumsum([*map(len, b)]).tolist()
        groups, i0, j0, links, i, j = [], 0, 0, Counter(), 0, 0
        for c in sorted({*ea} & {*eb}):
            x, y = ea.index(c) + 1, eb.index(c) + 1
            groups.append(",".join(map(str, ids_a[i0:x])) + "|" + ",".join(map(str, ids_b[j0:y])))
            i0, j0 = x, y
        while i < len(ea) and j < len(eb):
            links[ids_a[i], ids_b[j]] += 1
            i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
        held.update(links.keys())
        rows.append((len(ea), len(eb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (*r[:3], sum(r[3].values()), sum(m for p, m in r[3].items() if held[p] == top[p[0]]),
             sum(held[p] * m for p, m in r[3].items()), r[4]) for r in rows]


ODD = [None, "", " ", "  two  spaces ", "a\n\nb\tc", "don't stop", "mark ▁ here", "▁", "x▁ y", "é日本🙂 x y",
       "<s> </s> <|endoftext|> a<unk>", "\x00 \x1c a \x85 b", "tab\t x", "1234567 89", "a" * 3000, "日本語" * 700,
       "word " * 9000, "́e é ﬁ ﷺ", "same text here", "same text here"]


def test_alignment_equals_whole_text_brute_force(spark):
    rng = random.Random(5)
    chars = "abcdeé日 .,\n\t'1🙂▁<>"
    texts = ODD + ["".join(rng.choice(chars[:rng.randint(3, len(chars))]) for _ in range(rng.randint(1, 60)))
                   for _ in range(150)]
    want = brute_alignment(texts)
    rows = [(i if i % 7 else None, t, "z", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int").repartition(4)
    out = token_alignment.align_tokens(docs, BPE, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=str)
    assert sum(w[0] == 0 for w in want) >= 4


def test_cutting_texts_changes_nothing():
    cut, whole = token_alignment.Pair(BPE, PIECES), token_alignment.Pair(BPE, PIECES)
    assert cut.split and len(cut.cut("a b c")) == 3
    whole.split = False
    ids, texts = list(range(len(ODD))), [t or "" for t in ODD]
    a, b = (token_alignment.pack_block(p, ids, texts) for p in (cut, whole))
    assert all(a[k] == b[k] for k in (*token_alignment.NUMBERS, "sha", "pairs", "held"))


def test_alignment_of_an_empty_table_and_small_blocks(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_tokens(empty, BPE, PIECES).count() == 0
    texts = [f"copy of a text {i % 3}" for i in range(50)] + [None]
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in token_alignment.align_tokens(docs, BPE, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


# ------------------------------------------------------------------ WARC
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "page_id long, url string, html string, key string, head string")


def test_warc_round_trip_and_revisits(spark):
    big, other = "<p>é" * 400, "b" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/ü?q=1 2\r\nX: y", big), (9, "http://a/9", big), (4, None, None),
            (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "a" * 999), (8, "u", "a" * 999), (10, "u", other),
            (None, "u", other), (9, "http://a/9", big), (None, "u", "c" * 2000), (None, "u", "c" * 2000),
            (11, "u", "z" * 3_000_000)]
    path = scratch_path(spark, "warc-test")
    warc_bundles.write_archives(pages(spark, rows).repartition(3), path, frame_bytes=4000, archive_bytes=9000)
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in warc_bundles.read_archives(spark, path).collect()),
                 key=str)
    data = lambda t: (t or "").encode()
    heads = {big: 9, other: 10}
    want = []
    for i, _, html in rows:
        head = heads.get(html)
        revisit = head is not None and i != head
        want.append((None if i is None else str(i), "revisit" if revisit else "response", len(data(html)),
                     hashlib.sha1(data(html)).hexdigest(), str(head) if revisit else None,
                     None if revisit else data(html)))
    assert got == sorted(want, key=str)
    urls = {r.record_id: r.url for r in warc_bundles.read_archives(spark, path).collect()}
    assert urls["2"] == "http://a/%C3%BC?q=1%202%0D%0AX:%20y" and urls["4"] is None


def test_archives_are_plain_zstandard_and_seekable(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 300) for i in range(200)]
    path = scratch_path(spark, "warc-test")
    warc_bundles.write_archives(pages(spark, rows).repartition(2), path, frame_bytes=20_000, archive_bytes=150_000)
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert len(files) >= 4                     # archives close at their size
    seen = 0
    for f in files:
        data = bytes(f.content)
        frames = warc_bundles.seek_table(data)
        assert len(frames) > 3 and max(p for *_, p in frames) <= 20_000
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        at = 0
        while at < len(plain):
            headers, block, at = warc_bundles.parse_record(plain, at)
            seen += headers["WARC-Type"] == "response"
    assert seen == 200
    places = warc_bundles.archive_index(spark, path).collect()
    assert len(places) == 200
    for place in random.Random(6).sample(places, 8):
        page = warc_bundles.fetch_record(spark, place)
        i = int(place["record_id"])
        assert (page["record_id"], page["payload"].decode()) == (str(i), rows[i][2])


def test_warc_of_an_empty_table_and_broken_archives(spark):
    path = scratch_path(spark, "warc-test")
    warc_bundles.write_archives(pages(spark, [(1, "u", "x")]).where("false"), path)
    assert warc_bundles.read_archives(spark, path).count() == 0
    archive = warc_bundles.Archive("t", "2000-01-01T00:00:00Z", 100)
    archive.add("1", "response", warc_bundles.page_record("1", None, b"abc", hashlib.sha1(b"abd").hexdigest(), None, False,
                                                          "2000-01-01T00:00:00Z"))
    data = archive.finish()
    with pytest.raises(ValueError, match="seek table"):
        warc_bundles.seek_table(data[:-1])
    frames = warc_bundles.seek_table(data)
    headers, block, _ = warc_bundles.parse_record(warc_bundles.plain_frame(data, frames[1]), 0)
    with pytest.raises(ValueError, match="digest"):
        warc_bundles.page_of(headers, block)
    assert [warc_bundles.key_of(warc_bundles.uri_of(k)) for k in (None, "", "a b%é/\n")] == [None, "", "a b%é/\n"]


def test_stretches_are_aligned_in_bounded_parts(monkeypatch):
    """A block's stretches are encoded and aligned a part at a time, with the same result."""
    words = [f"w{i * 7919}ö{i % 13}" for i in range(2000)] + ["a\x00b", "straße,", ""]
    whole = token_alignment.Pair(BPE, PIECES).facts(words)
    monkeypatch.setattr(token_alignment, "ALIGN_BYTES", 500)
    monkeypatch.setattr(token_alignment, "ENCODE_BYTES", 200)
    pair, sizes = token_alignment.Pair(BPE, PIECES), []
    real = pair.aligned
    pair.aligned = lambda some: sizes.append(sum(map(len, some))) or real(some)
    parts = pair.facts(words)
    assert len(sizes) > 20 and max(sizes) < 600
    assert parts.keys() == whole.keys()
    assert all(list(parts[k]) == list(whole[k]) for k in whole)
    assert all(type(x) is bytes for x in pair.cache.values())
