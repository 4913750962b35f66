"""Near-duplicate documents by circulant MinHash.

Shingle hashes are spread over 2**32 places by a first permutation; one second
permutation, shifted circularly by 0, 1, 2, ... places, gives every signature
coordinate.  Coordinates are grouped into bands; documents that share a band
are candidates, and a link needs the exact Jaccard similarity of the full
shingle sets.

Documents with equal sets are one class from the start.  In a shared band the
members are first compared with a leader, and only members of different
components after that, leaving out pairs that the triangle inequality of the
Jaccard distance excludes, or that differ from a component's centre in too
many places that they do not share.  So a group of n near copies costs a few n
set comparisons, and no link between components is left untested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import among, hash60, may_hold, packed, shared_table, unpacked
from riskframe.llm.components import connected_components
from riskframe.session import temporary_tables

NO_ID = (1 << 63) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class NearDupRules:
    """``words`` per shingle, link from ``percent`` % Jaccard similarity on.
    ``bands`` x ``rows`` coordinates: a pair at 80 % shares no band with
    probability (1 - 0.8**rows)**bands, 3e-6 by default.  ``leaders``,
    ``probes``, ``centre_from`` and ``centre_of`` steer the order and number of
    comparisons (see ``link_classes``), not which links are found."""

    words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    seed: int = 0x9E3779B97F4A7C15
    leaders: int = 4
    probes: int = 8
    centre_from: int = 16
    centre_of: int = 32
    group_bytes: int = 1 << 19
    salt_pairs: int = 2000


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _place(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32-bit integers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(z, np.uint32(shift), out=t)
        np.bitwise_xor(z, t, out=z)
        np.multiply(z, np.uint32(factor), out=z)
    np.right_shift(z, np.uint32(16), out=t)
    return np.bitwise_xor(z, t, out=z)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: the k-word shingle hashes of the texts, one after
    the other, and how many each text has (not yet distinct).

    ``bytes.lower`` changes A-Z only.  A word's hash is a polynomial of its
    bytes modulo 2**64, mixed; a text with fewer than k words has its whole
    sequence as one shingle."""
    buf = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = ~_SPACE[buf]
    begin = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    per_text = np.diff(np.concatenate(([0], np.searchsorted(begin, ends))))
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(solid)
    word = np.cumsum(np.isin(at, begin, assume_unique=True)) - 1
    offset = at - begin[word]
    powers = np.multiply.accumulate(np.full(int(offset.max()) + 1, 0x9E3779B97F4A7C55, dtype=np.uint64))
    first = np.searchsorted(at, begin)
    h = _mix64(np.add.reduceat((buf[at].astype(np.uint64) + np.uint64(1)) * powers[offset], first))
    doc = np.repeat(np.arange(len(texts)), per_text)
    n = len(h)
    grams = h.copy()
    for j in range(1, k):
        grams[:n - j] = _mix64(grams[:n - j] * np.uint64(0x2545F4914F6CDD1D) + h[j:])
    whole = np.zeros(n, dtype=bool)
    if n >= k:
        whole[:n - k + 1] = doc[:n - k + 1] == doc[k - 1:]
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    for d in np.flatnonzero((per_text > 0) & (per_text < k)):
        s, acc = starts[d], np.array([per_text[d]], dtype=np.uint64)
        for j in range(per_text[d]):
            acc = _mix64(acc * np.uint64(0x2545F4914F6CDD1D) + h[s + j])
        grams[s], whole[s] = acc[0], True
    counts = np.bincount(doc[whole], minlength=len(texts))
    return grams[whole], counts


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """Circulant signatures (texts with shingles only), one row per text."""
    sigma = (_mix64(hashes ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(counts[counts > 0])[:-1])).astype(np.int64)
    out = np.empty((len(first), coordinates), dtype=np.uint32)
    z, t = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.subtract(sigma, np.uint32(k), out=z)
        out[:, k] = np.minimum.reduceat(_place(z, t), first)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band; the band number is part of it."""
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(_mix64(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for r in range(rows):
        key = _mix64(key * np.uint64(0x2545F4914F6CDD1D) + part[:, :, r])
    return key.astype(np.int64)


def _groups(texts, limit):
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _fingerprints(rules: NearDupRules, want_bands: bool, want_set: bool, want_text_hash: bool = False):
    """Pandas batches (eid, text[, th]) -> eid, n, fp[, th] and the bands or the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ids = frame["eid"].to_numpy()
            texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in frame["text"]]
            for group in _groups(texts, rules.group_bytes):
                hashes, counts = shingle_hashes([texts[i] for i in group], rules.words)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - c:e]) for e, c in zip(ends, counts)]
                raw = [s.tobytes() for s in sets]
                cols = {"eid": ids[group], "n": [len(s) for s in sets],
                        "fp": [hashlib.md5(b).digest() if b else None for b in raw]}
                if want_text_hash:
                    cols["th"] = frame["th"].to_numpy()[group]
                if want_bands:
                    keys: list = [None] * len(group)
                    if len(hashes):
                        made = band_keys(signatures(hashes, counts, rules.bands * rules.rows, rules.seed),
                                         rules.bands, rules.rows)
                        for i, row in zip(np.flatnonzero(counts > 0), made):
                            keys[i] = row
                    cols["bands"] = keys
                if want_set:
                    cols["items"] = raw
                yield pd.DataFrame(cols)

    schema = "eid long, n long, fp binary" + (", th long" if want_text_hash else "")
    return run, schema + (", bands array<long>" if want_bands else "") + (", items binary" if want_set else "")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets of 64-bit hashes."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                         assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def confirm(pairs: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """``pairs`` (a, b) with ``linked`` and ``gap`` (Jaccard distance), from the
    full sets.

    Pairs of one ``a`` are dealt to several salts, and its set is copied once
    per salt, so a member compared with very many others is not one task."""
    many = pairs.groupBy(F.col("a").alias("h_a")).agg(
        F.ceil(F.count("*") / rules.salt_pairs).cast("int").alias("salts"))
    many = shared_table(many, "pair-salts")
    dealt = (pairs.join(many, F.col("a") == F.col("h_a"))
             .select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))
    left = (sets.join(many, F.col("fp") == F.col("h_a"))
            .select(F.col("fp").alias("l"), F.col("items").alias("l_items"), F.col("n").alias("l_n"),
                    F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("l_salt")))
    right = sets.select(F.col("fp").alias("r"), F.col("items").alias("r_items"), F.col("n").alias("r_n"))
    on = (dealt.join(left, (F.col("a") == F.col("l")) & (F.col("salt") == F.col("l_salt")))
          .join(right, F.col("b") == F.col("r")))
    on = on.withColumn("both", _common("l_items", "r_items")).withColumn("any", F.col("l_n") + F.col("r_n") - F.col("both"))
    return on.select("a", "b", (100 * F.col("both") >= rules.percent * F.col("any")).alias("linked"),
                     (1 - F.col("both") / F.col("any")).alias("gap"))


_BITS = 512


def _centre(group: pd.DataFrame) -> pd.DataFrame:
    """The items that more than half of the sets of one component hold."""
    sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
    items, times = np.unique(np.concatenate(sets), return_counts=True)
    return pd.DataFrame({"c_top": [group["top"].iloc[0]], "centre": [items[2 * times > len(sets)].tobytes()]})


def _marks(at: np.ndarray) -> tuple[np.ndarray, int]:
    """``_BITS`` bits as longs, and how many entries fell on a bit already set."""
    spot = np.zeros(_BITS, dtype=bool)
    spot[at] = True
    return np.packbits(spot, bitorder="little").view(np.int64), len(at) - int(spot.sum())


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each set differs from a centre: what it lacks (by place) and what it
    has besides (by hash)."""
    names = ["o_fp", "o_top", "held", "size", "lost", "lost_over", "more", "more_over"]
    for frame in batches:
        rows = []
        for fp, top, items, centre in zip(frame["fp"], frame["top"], frame["items"], frame["centre"]):
            own, mid = np.frombuffer(items, np.uint64), np.frombuffer(centre, np.uint64)
            held = np.isin(mid, own, assume_unique=True)
            more = own[~np.isin(own, mid, assume_unique=True)]
            rows.append((fp, top, int(held.sum()), len(mid), *_marks(np.flatnonzero(~held) % _BITS),
                         *_marks((more % np.uint64(_BITS)).astype(np.int64))))
        yield pd.DataFrame(rows, columns=names)


def _with_offsets(live: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """``live`` with ``off``: the difference from the centre of the band's
    largest component, NULL where that has few members in every band.  A
    centre is made of ``centre_of`` members at most."""
    inside = live.filter(F.col("comp") == F.col("top"))
    wide = (inside.groupBy("key", "top").agg(F.count("*").alias("c")).filter(F.col("c") >= rules.centre_from)
            .select("top").distinct())
    wide = shared_table(wide, "wide-components")
    some = (inside.join(wide, "top", "left_semi")
            .groupBy("top", F.pmod(F.xxhash64("fp"), F.lit(rules.centre_of)).alias("i")).agg(F.min("fp").alias("fp")))
    centres = shared_table(some.join(sets, "fp").select("top", "items").groupBy("top")
                           .applyInPandas(_centre, "c_top binary, centre binary"), "centres")
    asked = live.join(wide, "top", "left_semi").select("fp", "top").distinct()
    made = (asked.join(sets, "fp").join(centres, F.col("top") == F.col("c_top"))
            .select("fp", "top", "items", "centre")
            .mapInPandas(_offsets, "o_fp binary, o_top binary, held long, size long, lost array<long>, "
                                   "lost_over long, more array<long>, more_over long"))
    made = shared_table(made.select("o_fp", "o_top", F.struct(
        "held", "size", "lost", "lost_over", "more", "more_over").alias("off")), "offsets")
    out = live.join(made, (F.col("fp") == F.col("o_fp")) & (F.col("top") == F.col("o_top")), "left")
    return shared_table(out.drop("o_fp", "o_top"), "open-offsets")


def _can_meet(x, y, xn, yn, rules: NearDupRules):
    """Whether two sets, by their differences from one centre, can reach the
    similarity.  With m the centre's size, |x & y| is
    held_x + held_y - m + |lost_x & lost_y| + |more_x & more_y|, and common bits
    plus the smaller overflow are no less than the last two."""
    most = x["held"] + y["held"] - x["size"]
    for part in ("lost", "more"):
        for i in range(_BITS // 64):
            most = most + F.bit_count(x[part][i].bitwiseAND(y[part][i]))
        most = most + F.least(x[part + "_over"], y[part + "_over"])
    return F.coalesce((100 + rules.percent) * most >= rules.percent * (xn + yn), F.lit(True))


def _may_link(x, y, rules: NearDupRules):
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(x, y) >= rules.percent * F.greatest(x, y)


def link_classes(bands: DataFrame, keys: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """``node, comp`` over set fingerprints, from ``bands`` (key, fp, n) and
    ``keys`` (fp, keys: all its bands).

    ``bands`` holds only keys that two or more classes share.  First every
    member of a band is compared with the band's leader; the leaders of a
    large group agree over a quarter of its bands each, so a member meets
    about ``leaders`` of them.  In bands that still hold several components,
    ``probes`` members of the largest one are compared with those outside it.
    At last every pair across components is compared, but for pairs that
    the leader excludes: Jaccard distance is a metric, so two members whose
    distances to the leader differ by more than the limit do not link; and but
    for pairs that the component's centre excludes (``_can_meet``)."""
    order = [F.struct(F.xxhash64(F.lit(k), "fp").alias("h"), "fp", "n") for k in range(rules.leaders)]
    turn = F.pmod("key", F.lit(rules.leaders))
    first = bands.groupBy("key").agg(*(F.min(o).alias(f"m{k}") for k, o in enumerate(order)))
    chosen = F.coalesce(*(F.when(turn == k, F.col(f"m{k}")) for k in range(rules.leaders)))
    first = first.select("key", chosen.alias("l"))
    star = shared_table(bands.join(first, "key").select("key", "fp", "n", F.col("l.fp").alias("lead"), F.col("l.n").alias("ln")),
                        "band-leaders")
    pairs = star.filter((F.col("fp") != F.col("lead")) & _may_link(F.col("n"), F.col("ln"), rules)) \
        .select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()
    tested = shared_table(confirm(shared_table(pairs, "star-pairs"), sets, rules), "confirmed")
    # distance to the leader: exact where compared, else the least that the sizes allow
    known = tested.select(F.col("a").alias("k_a"), F.col("b").alias("k_b"), "gap")
    least = 1 - F.least("n", "ln") / F.greatest("n", "ln")
    members = shared_table(
        star.join(known, (F.col("lead") == F.col("k_a")) & (F.col("fp") == F.col("k_b")), "left").select(
            "key", "fp", "n", F.when(F.col("fp") == F.col("lead"), 0.0).otherwise(F.coalesce("gap", least)).alias("lo"),
            F.when(F.col("fp") == F.col("lead"), 0.0).otherwise(F.coalesce("gap", F.lit(1.0))).alias("hi")), "members")
    keys = keys.select(F.col("fp").alias("k_fp"), "keys")
    labels = connected_components(tested.filter("linked").select("a", "b"))
    for probes in (rules.probes, None):
        pairs = shared_table(_cross_pairs(members, labels, tested, keys, sets, probes, rules), "pairs")
        if pairs.isEmpty():
            continue
        more = shared_table(confirm(pairs, sets, rules), "confirmed")
        tested = tested.unionByName(more)
        links = more.filter("linked").select("a", "b")
        if not links.isEmpty():
            # a component found before is a star of its labels
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links))
    return labels


def _cross_pairs(members: DataFrame, labels: DataFrame, tested: DataFrame, keys: DataFrame, sets: DataFrame,
                 probes: int | None, rules: NearDupRules) -> DataFrame:
    """Pairs of a band in different components that were not compared: with
    ``probes``, only pairs of some members of the band's largest component;
    without, all, each in the first band that its members share."""
    on = (members.join(labels, members.fp == labels.node, "left")
          .select("key", "fp", "n", "lo", "hi", F.coalesce("comp", "fp").alias("comp")))
    parts = on.groupBy("key", "comp").agg(F.count("*").alias("c"))
    largest = (parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "comp")).alias("top"))
               .filter("parts > 1").select("key", F.col("top.comp").alias("top")))
    live = on.join(shared_table(largest, "open-bands"), "key")
    live = shared_table(live.join(keys, F.col("fp") == F.col("k_fp")).drop("k_fp"), "open-members")
    live = _with_offsets(live, sets, rules) if probes is None else live.withColumn("off", F.lit(None))
    x = live.filter(F.col("comp") != F.col("top")).select(
        "key", F.col("off").alias("xo"), F.col("fp").alias("x"), F.col("n").alias("xn"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"),
        F.col("comp").alias("xc"), F.col("keys").alias("xk"))
    y = live
    if probes is not None:
        best = live.filter(F.col("comp") == F.col("top")).groupBy("key").agg(
            *(F.min(F.struct(F.xxhash64(F.lit(-1 - k), "fp").alias("h"), "fp")).alias(f"p{k}") for k in range(probes)))
        picked = best.select("key", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}.fp") for k in range(probes))))).alias("fp"))
        y = live.join(picked, ["key", "fp"], "left_semi")
    y = y.select("key", F.col("off").alias("yo"), F.col("fp").alias("y"), F.col("n").alias("yn"), F.col("lo").alias("ylo"),
                 F.col("hi").alias("yhi"), F.col("comp").alias("yc"), F.col("top").alias("yt"), F.col("keys").alias("yk"))
    far = F.lit(1 - rules.percent / 100 + 1e-9)
    # outsiders among themselves come once, in order
    once = F.lit(True) if probes else (_can_meet(F.col("xo"), F.col("yo"), F.col("xn"), F.col("yn"), rules)
                                       & (F.array_min(F.array_intersect("xk", "yk")) == F.col("key")))
    pairs = x.join(y, "key").filter(
        (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("yt")) | (F.col("x") < F.col("y")))
        & _may_link(F.col("xn"), F.col("yn"), rules)
        & (F.col("xlo") - F.col("yhi") <= far) & (F.col("ylo") - F.col("xhi") <= far) & once)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def _classified(docs: DataFrame, rules: NearDupRules, id_col: str, text_col: str,
                want_text_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: ``eid`` (its id, ``NO_ID`` for NULL), ``n`` (shingles),
    ``component`` (smallest ``eid`` of its class), ``cls`` (the class itself; NULL
    without words) and with ``want_text_hash`` ``th``, the hash of its text."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("eid"), F.col(text_col).alias("text"),
                       *([hash60(F.coalesce(F.col(text_col), F.lit(""))).alias("th")] if want_text_hash else []))
    with temporary_tables(docs.sparkSession) as keep:
        run, schema = _fingerprints(rules, True, False, want_text_hash)
        sketch = keep(shared_table(base.mapInPandas(run, schema), "sketches"))
        classes = (sketch.filter(F.col("fp").isNotNull()).groupBy("fp")
                   .agg(F.min("eid").alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands")))
        keyed = shared_table(classes.select("fp", "rep", "n", "bands"), "classes")
        rows = keyed.select("fp", "rep", "n", F.explode("bands").alias("key"))
        shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
        bands = shared_table(among(rows, shared_table(shared, "shared-bands"), ["key"]), "bands")
        asked = shared_table(bands.groupBy("fp").agg(F.min("rep").alias("eid"), F.collect_list("key").alias("keys")),
                             "candidates")
        run, schema = _fingerprints(rules, want_bands=False, want_set=True)
        sets = (among(base.select("eid", "text"), asked, ["eid"]).mapInPandas(run, schema)
                .join(asked, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("items").alias("items")))
        labels = link_classes(bands.drop("rep"), asked, shared_table(sets, "sets"), rules)
        linked = (keyed.select("fp", "rep").join(labels, F.col("fp") == F.col("node"), "left")
                  .select("fp", F.coalesce("comp", "fp").alias("comp"), "rep"))
        smallest = linked.groupBy("comp").agg(F.min("rep").alias("component"))
        named = keep(shared_table(linked.join(smallest, "comp").select(
            F.col("fp").alias("c_fp"), "component", F.col("comp").alias("cls")), "components"))
    out = sketch.drop("bands").join(named, F.col("fp") == F.col("c_fp"), "left")
    return out.withColumn("component", F.coalesce("component", "eid")).drop("fp", "c_fp")


def near_duplicates(docs: DataFrame, rules: NearDupRules = NearDupRules(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` per row of ``docs``.

    Texts without words (NULL, empty) have empty sets and link with nothing.
    Repeated rows share a class; a NULL id counts as the largest id and is
    returned as NULL.  Other columns are ignored."""
    out = _classified(docs, rules, id_col, text_col)
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("eid")).alias(id_col), F.col("n").alias("n_shingles"),
                      back(F.col("component")).alias("component_id"), (F.col("eid") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, rules: NearDupRules = NearDupRules(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the
    smallest id (NULL last), then the smallest hash of its text; all columns
    stay.  Documents are told apart by id and text, so a repeated id loses only
    the copy; of rows that repeat the kept id and text, the least stays (columns
    of a type without order: any).  Documents without words all stay."""
    with temporary_tables(docs.sparkSession) as keep:
        rows = _classified(docs, rules, id_col, text_col, want_text_hash=True).filter(F.col("cls").isNotNull())
        rows = shared_table(rows.groupBy("cls", "eid", "th").agg(F.count("*").alias("times")), "class-members")
        first = rows.groupBy(F.col("cls").alias("of")).agg(F.min(F.struct("eid", "th")).alias("kept"))
        marked = rows.join(first, F.col("cls") == F.col("of")).withColumn("stays", F.struct("eid", "th") == F.col("kept"))
        # what goes, and of what repeated rows become one
        marks = keep(shared_table(marked.filter(~F.col("stays") | (F.col("times") > 1)).select("eid", "th", "stays"),
                                  "near-copies"))
    all_rows = packed(docs)
    key = F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(NO_ID))
    th = hash60(F.coalesce(F.col("row").getField(text_col), F.lit("")))
    same = (key == F.col("eid")) & (th == F.col("th"))
    # only what the marks may name meets them
    marked = may_hold(marks, "eid", "th")(key, th)
    maybe = all_rows.filter(marked)
    alone = all_rows.filter(~marked).unionByName(maybe.join(marks, same, "left_anti"))
    repeated = maybe.join(marks.filter("stays"), same).groupBy("eid", "th")
    try:
        one = repeated.agg(F.min("row").alias("row"))
        one.schema
    except AnalysisException:               # a column without an order
        one = repeated.agg(F.first("row").alias("row"))
    return unpacked(alone.unionByName(one.select("row")), docs)


#: DuckDB, for the two-word shingles of the query: every pair that shares a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, ws[i:i + 1] AS g FROM w, unnest(range(1, greatest(len(ws), 1))) AS r(i)
        UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n q ON q.doc_id = a JOIN n t ON t.doc_id = b WHERE 100 * i >= 80 * (q.n + t.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
