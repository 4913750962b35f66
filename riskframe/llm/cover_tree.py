"""Embedding near-dedup by a dual traversal of a cover tree.

The tree's levels are nested and their radii halve from level to level.  Its
upper part is built over a bounded sample; every vector then belongs to its
nearest lowest centre, and to a ring around it whose radius halves too.
Covering radii are measured over all vectors.  Node pairs are followed from the
root: a pair is dropped when its balls are farther apart than the link
distance, counted as a whole when every pair of points inside is linked, and
split otherwise.  What is left at the bottom is compared point by point, in
blocks of bounded size, each vector only with blocks that its own distance to
their centres does not exclude.  A task compares the blocks of two sides (runs of
blocks): a vector travels once per side that holds such a block, not once per block.

Unit vectors have cosine >= c exactly when their distance is at most
sqrt(2 - 2c); the bounds are used with a small margin, the decision itself is
made on the cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import shared_table
from riskframe.llm.components import connected_components

MARGIN = 1e-9
RINGS = 12
#: Blocks of a side at most, and sides aimed at; rows held at once against the tree, rows handed on at once (about).
SPAN, SIDES, ROWS_AT_ONCE, SENT_AT_ONCE = 16, 16, 512, 16_384


@dataclass(frozen=True)
class CoverRules:
    """Link from ``cosine`` on.  ``centres`` bounds the sample under the tree
    (and with it all that reaches the driver), ``block`` the vectors of one
    side of a block comparison."""

    cosine: float = 0.9
    centres: int = 512
    block: int = 2048
    seed: int = 3


def nested_centres(x: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """A cover tree over unit vectors: ``(order, parent, level)``.

    Level i centres are more than 2**(1-i) apart; each point not yet a centre
    at level i is within that radius of one, and becomes its child at the
    first level that separates them.  ``order`` lists points by entry."""
    n = len(x)
    parent, level, order = [-1] * n, [0] * n, [0]
    near, dist = np.zeros(n, dtype=int), np.linalg.norm(x - x[0], axis=1)
    radius, lev = 2.0, 0
    left = np.ones(n, dtype=bool)
    left[0] = False
    while left.any():
        radius, lev = radius / 2, lev + 1
        if radius < 1e-6:
            break
        while True:
            far = np.flatnonzero(left & (dist > radius))
            if not len(far):
                break
            p = far[np.argmax(dist[far])]
            parent[p], level[p] = int(near[p]), lev
            order.append(int(p))
            left[p] = False
            d = np.linalg.norm(x - x[p], axis=1)
            closer = d < dist
            near[closer], dist[closer] = p, d[closer]
    return np.array(order), parent, level


def ring_of(d: np.ndarray) -> np.ndarray:
    """Ring k holds distances in (2**-k, 2**(1-k)]; the last one all below."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log2(np.maximum(d, 1e-300))), 0, RINGS - 1).astype(np.int64)


class Plan:
    """What the traversal decided: for each node (centre, ring) its block, the
    nodes it is wholly linked with and the nodes still to compare."""

    def __init__(self, centres: np.ndarray, parent: list[int], stats: pd.DataFrame, rules: CoverRules):
        self.centres, self.rules = centres, rules
        self.limit = float(np.sqrt(max(0.0, 2 - 2 * rules.cosine)))
        stats = stats.sort_values(["centre", "ring"]).reset_index(drop=True)
        self.centre, self.ring = stats.centre.to_numpy(), stats.ring.to_numpy()
        self.radius = stats.radius.to_numpy()
        self.number = {(c, r): i for i, (c, r) in enumerate(zip(self.centre, self.ring))}
        self.links, self.reps = stats.links.to_numpy(), list(stats.rep)
        self._traverse(parent)
        self._blocks(stats.points.to_numpy())

    def _traverse(self, parent: list[int]) -> None:
        """Dual traversal from the root pair; leaves are the ring nodes."""
        c, m = len(self.centres), len(self.centre)
        kids: list[list[int]] = [[] for _ in range(c)]
        for i in range(c):
            if parent[i] >= 0:
                kids[parent[i]].append(i)
        leaves: list[list[int]] = [[] for _ in range(c)]
        for i, k in enumerate(self.centre):
            leaves[k].append(i)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(self.centres @ self.centres.T, -1, 1)))
        # tree node c + m .. : centre subtrees; 0 .. m-1: ring leaves
        reach = np.zeros(c)
        for i in reversed(range(c)):  # children come after their parents
            own = max((self.radius[x] for x in leaves[i]), default=0.0)
            reach[i] = max([own, *(gap[i, k] + reach[k] for k in kids[i])])
        whole, compare = np.zeros((m, m), dtype=bool), np.zeros((m, m), dtype=bool)
        radius = np.concatenate([self.radius, reach])
        at = np.concatenate([self.centre, np.arange(c)])
        below = [np.empty(0, int)] * m + [np.array(leaves[i] + [m + k for k in kids[i]], dtype=int) for i in range(c)]
        size = np.array([len(b) for b in below])
        a = b = np.array([m]) if c else np.empty(0, int)
        while len(a):
            d, r = gap[at[a], at[b]], radius[a] + radius[b]
            leaf = (a < m) & (b < m)
            all_in = leaf & (d + r <= self.limit - MARGIN)
            whole[a[all_in], b[all_in]] = True
            open_ = ~all_in & (d - r <= self.limit + MARGIN)
            done = open_ & leaf
            compare[a[done], b[done]] = True
            a, b = a[open_ & ~leaf], b[open_ & ~leaf]
            split_a = (a >= m) & ((b < m) | (radius[a] >= radius[b]))
            na, nb = [], []
            for x, y, first in ((a[split_a], b[split_a], True), (b[~split_a], a[~split_a], False)):
                if len(x):
                    kid = np.concatenate([below[i] for i in x])
                    other = np.repeat(y, size[x])
                    na.append(kid if first else other)
                    nb.append(other if first else kid)
            a, b = (np.concatenate(na), np.concatenate(nb)) if na else (np.empty(0, int),) * 2
        self.whole = whole | whole.T
        self.compare = (compare | compare.T) & ~self.whole

    def _blocks(self, points: np.ndarray) -> None:
        """Nodes in tree order packed into blocks; a large node has several."""
        self.first, self.parts, block, room = [], [], -1, 0
        slots = []
        for i, n in enumerate(points):
            if n > self.rules.block:
                k = int(-(-n // self.rules.block))
                self.first.append(block + 1)
                self.parts.append(k)
                slots += [(block + 1 + j, i) for j in range(k)]
                block, room = block + k, 0
            else:
                if n > room:
                    block, room = block + 1, self.rules.block
                room -= n
                self.first.append(block)
                self.parts.append(1)
                slots.append((block, i))
        self.first, self.parts = np.array(self.first), np.array(self.parts)
        self.slot_block = np.array([s[0] for s in slots])
        self.slot_node = np.array([s[1] for s in slots])
        self.n_blocks = block + 1
        self.span = int(np.clip(-(-self.n_blocks // SIDES), 1, SPAN))
        self.n_sides = -(-self.n_blocks // self.span)

    def place(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Node and block of each point."""
        node = np.array([self.number[k] for k in zip(frame["centre"], frame["ring"])], dtype=int)
        salt = np.array([f[0] + 256 * f[1] for f in frame["fp"]], dtype=np.int64)
        return node, self.first[node] + salt % self.parts[node]

    def reached(self, v: np.ndarray, node: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Which of the blocks ``begin`` to ``end`` each vector may have links in."""
        a, b = np.searchsorted(self.slot_block, [begin, end])
        slots, starts = self.slot_node[a:b], np.searchsorted(self.slot_block[a:b], np.arange(begin, end))
        out = np.empty((len(v), end - begin), dtype=bool)
        for s in range(0, len(v), ROWS_AT_ONCE):
            d, _ = _nearest(self.centres, v[s:s + ROWS_AT_ONCE])
            close = d[:, self.centre[slots]] - self.radius[slots] <= self.limit + MARGIN
            close &= self.compare[node[s:s + ROWS_AT_ONCE, None], slots]
            out[s:s + ROWS_AT_ONCE] = np.logical_or.reduceat(close, starts, axis=1)
        return out

    def linked_whole(self, node: np.ndarray, mult: np.ndarray) -> np.ndarray:
        """Links of each point to the points of wholly linked nodes (itself left out)."""
        total = (self.whole @ self.links)[node]
        return total - np.where(self.whole[node, node], mult, 0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(eid, emb) -> eid, fp, vec: NULL fp for vectors that link with nothing."""
    for frame in batches:
        fps, vecs = [], []
        for e in frame["emb"]:
            v = None if e is None else np.array([np.nan if x is None else x for x in e], dtype=np.float64) + 0.0
            ok = v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
            raw = v.tobytes() if ok else None
            fps.append(hashlib.md5(raw).digest() if ok else None)
            vecs.append(raw)
        yield pd.DataFrame({"eid": frame["eid"].to_numpy(), "fp": fps, "vec": vecs})


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float64).reshape(len(col), -1)


def _nearest(centres: np.ndarray, v: np.ndarray):
    cos = _unit(v) @ centres.T
    best = cos.argmax(axis=1)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.clip(cos, -1, 1)))
    return d, best


def _parts(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for s in range(0, len(frame), rows):
            yield frame.iloc[s:s + rows].reset_index(drop=True)


def _join_components(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Star edges with the components of a block's link matrix."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask, a, b = mask[np.ix_(rows, cols)], a[rows], b[cols]
    label_a = np.arange(len(a))
    while True:
        label_b = np.where(mask, label_a[:, None], len(a)).min(axis=0, initial=len(a))
        new_a = np.minimum(label_a, np.where(mask, label_b[None, :], len(a)).min(axis=1, initial=len(a)))
        if (new_a == label_a).all():
            break
        label_a = new_a
    return [*zip(a.tolist(), a[label_a].tolist()), *zip(b.tolist(), a[label_b].tolist())] if len(a) else []


def _compare(plan: Plan):
    """The blocks of two sides: exact links per point, and edges that span their components."""
    cosine, span = plan.rules.cosine, plan.span

    def side(group: pd.DataFrame, of: int, other: int):
        """The vectors of a side, their norms, nodes, counts, the places of each block's points, and
        which blocks of the other side they reach."""
        v, block = _matrix(group["vec"]), group["block"].to_numpy()
        node = group["node"].to_numpy()
        reach = plan.reached(v, node, other * span, min((other + 1) * span, plan.n_blocks))
        rows = {k: np.flatnonzero(block == k) for k in range(of * span, min((of + 1) * span, plan.n_blocks))}
        return v, np.sqrt((v * v).sum(axis=1)), node, group["mult"].to_numpy(), rows, reach

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g, h = int(group["g"].iloc[0]), int(group["h"].iloc[0])
        of = group["block"].to_numpy() // span
        left, right = group[of == g], group[of == h]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["fp", "links", "to"])
        a = side(left, g, h)
        b = a if g == h else side(right, h, g)
        fps = list(left["fp"]) + (list(right["fp"]) if g != h else [])
        shift = len(left) if g != h else 0
        links, up = np.zeros(len(fps), np.int64), list(range(len(fps)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        (va, na, nodes_a, ma, blocks_a, reach_a), (vb, nb, nodes_b, mb, blocks_b, reach_b) = a, b
        for i in blocks_a:
            for j in blocks_b:
                if g == h and j < i:
                    continue
                x = blocks_a[i][reach_a[blocks_a[i], j - h * span]]
                y = blocks_b[j][reach_b[blocks_b[j], i - g * span]]
                if not len(x) or not len(y):
                    continue
                ia, ib, wide = nodes_a[x], nodes_b[y], vb[y]
                mask = np.empty((len(x), len(y)), dtype=bool)
                for s in range(0, len(x), 256):
                    at = x[s:s + 256]
                    mask[s:s + 256] = (va[at] @ wide.T) / (na[at, None] * nb[y]) >= cosine
                if plan.whole[np.ix_(np.unique(ia), np.unique(ib))].any():
                    mask &= ~plan.whole[ia[:, None], ib]
                if i == j:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                links[x] += mask @ mb[y]
                if i != j:
                    links[shift + y] += mask.T @ ma[x]
                for p, q in _join_components(mask, x, shift + y):
                    p, q = top(p), top(q)
                    up[max(p, q)] = min(p, q)
        found = np.flatnonzero(links)
        return pd.DataFrame({"fp": [fps[i] for i in found], "links": links[found],
                             "to": [fps[t] if (t := top(i)) != i else None for i in found.tolist()]})

    return run


def near_duplicates(vectors: DataFrame, rules: CoverRules = CoverRules(), id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``<id>, n_links, component_id, kept`` per row of ``vectors``.

    Vectors that are NULL, zero or hold NULL or non-finite components link
    with nothing.  Equal vectors are one point with a multiplicity; repeated
    rows count as further vectors.  A NULL id counts as the largest id and is
    returned as NULL.  All vectors have one length."""
    no_id = (1 << 63) - 1
    base = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("eid"),
                          F.col(vector_col).cast("array<double>").alias("emb"))
    rows = shared_table(base.mapInPandas(_vectors, "eid long, fp binary, vec binary"), "vectors")
    points = shared_table(rows.filter(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.min("eid").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec")), "points")
    sample = points.orderBy(F.xxhash64(F.lit(rules.seed), "fp"), "fp").limit(rules.centres).select("vec").toPandas()
    if not len(sample):
        return rows.select(F.when(F.col("eid") != no_id, F.col("eid")).alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.when(F.col("eid") != no_id, F.col("eid")).alias("component_id"), F.lit(True).alias("kept"))
    x = _unit(_matrix(sample["vec"]))
    order, parent, _ = nested_centres(x)
    place = {p: i for i, p in enumerate(order)}
    centres, parents = x[order], [place[parent[p]] if parent[p] >= 0 else -1 for p in order]

    def assign(batches):
        for frame in _parts(batches, ROWS_AT_ONCE):
            d, best = _nearest(centres, _matrix(frame["vec"]))
            own = d[np.arange(len(best)), best]
            yield pd.DataFrame({"fp": frame["fp"], "rep": frame["rep"], "mult": frame["mult"], "vec": frame["vec"],
                                "centre": best, "ring": ring_of(own), "dist": own})

    placed = shared_table(points.mapInPandas(
        assign, "fp binary, rep long, mult long, vec binary, centre long, ring long, dist double"), "placed")
    stats = placed.groupBy("centre", "ring").agg(
        F.count("*").alias("points"), F.sum("mult").alias("links"), (F.max("dist") + F.lit(MARGIN)).alias("radius"),
        F.min("fp").alias("rep")).toPandas()
    plan = Plan(centres, parents, stats, rules)

    def deal(batches):
        """A row per point and side pair that may hold more links of it."""
        starts = np.arange(0, plan.n_blocks, plan.span)
        for frame in _parts(batches, max(1, min(ROWS_AT_ONCE, SENT_AT_ONCE // plan.n_sides))):
            node, block = plan.place(frame)
            sides = np.logical_or.reduceat(plan.reached(_matrix(frame["vec"]), node, 0, plan.n_blocks), starts, axis=1)
            who, to = np.nonzero(sides)
            own = block[who] // plan.span
            yield pd.DataFrame({"g": np.minimum(own, to), "h": np.maximum(own, to), "block": block[who], "node": node[who],
                                "fp": frame["fp"].to_numpy()[who], "mult": frame["mult"].to_numpy()[who],
                                "vec": frame["vec"].to_numpy()[who]})

    def wholly(batches):
        """Each point's links to the points of wholly linked nodes."""
        some, first = plan.whole.any(axis=1), plan.whole.argmax(axis=1)
        for frame in batches:
            node = np.array([plan.number[k] for k in zip(frame["centre"], frame["ring"])], dtype=int)
            out = pd.DataFrame({"fp": frame["fp"], "links": plan.linked_whole(node, frame["mult"].to_numpy()),
                                "to": [plan.reps[first[n]] if some[n] else None for n in node]})
            yield out[out["links"] > 0]

    dealt = placed.mapInPandas(deal, "g long, h long, block long, node long, fp binary, mult long, vec binary")
    found = shared_table(dealt.groupBy("g", "h").applyInPandas(
        _compare(plan), "fp binary, links long, to binary"), "found")
    whole = placed.select("fp", "mult", "centre", "ring").mapInPandas(wholly, "fp binary, links long, to binary")
    counts = found.unionByName(whole).groupBy("fp").agg(F.sum("links").alias("links"))
    a, b = np.nonzero(np.triu(plan.whole, 1))
    seams = vectors.sparkSession.createDataFrame(
        [(plan.reps[i], plan.reps[j]) for i, j in zip(a, b)], "a binary, b binary")
    edges = found.unionByName(whole).filter(F.col("to").isNotNull()).select(F.col("fp").alias("a"), F.col("to").alias("b"))
    labels = connected_components(edges.unionByName(seams))
    known = (points.select("fp", "rep", "mult").join(counts.withColumnRenamed("fp", "c_fp"), F.col("fp") == F.col("c_fp"), "left")
             .join(labels, F.col("fp") == F.col("node"), "left")
             .select("fp", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("comp", "fp").alias("comp")))
    known = shared_table(known, "linked")
    least = known.groupBy("comp").agg(F.min("rep").alias("component"))
    named = shared_table(known.join(least, "comp").select(F.col("fp").alias("n_fp"), "n_links", "component"), "named")
    out = rows.select("eid", "fp").join(named, F.col("fp") == F.col("n_fp"), "left")
    comp = F.coalesce("component", "eid")
    back = lambda c: F.when(c != no_id, c)
    return out.select(back(F.col("eid")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      back(comp).alias("component_id"), (F.col("eid") == comp).alias("kept"))


#: DuckDB: every pair, and reachability over the links.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
