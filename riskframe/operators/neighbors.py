"""Exact k nearest neighbours inside one set of vectors, and SMOTE (M9) on them.

The k-NN join is pruned by the metric and never compares all pairs:

1. equal vectors become one row with their count (a hot vector is one row);
2. a k-d tree over a bounded sample cuts the vectors into cells, each with the
   box that holds its vectors, and cells into blocks by hash, so that no block
   outgrows ``BLOCK_ROWS`` whatever the skew; neighbouring cells make a side;
3. each side is searched on its own: the k-th distance found there bounds the
   true one from above;
4. a vector visits only those other sides that have a box within that distance,
   once per side, and there only the blocks of such boxes.  Visitors of one side
   are dealt to groups of bounded size;
5. the lists of all visits are merged.

What travels to tasks or to the driver is bounded by parameters: the tree, its
boxes and block counts.  Tables between the steps are written once.

Distances are compared by their square rounded to ``DIGITS`` decimals, equal
ones by the smaller representative, so that ties have one outcome.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.features import class_rank
from riskframe.session import materialize, temporary_tables

#: Tasks get these functions with the job: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells at most and sampled vectors per cell; rows of a block and visitors of a group (about).
CELLS, SAMPLED, BLOCK_ROWS, VISITORS = 1024, 64, 1024, 16_384
#: Cells of a side at most, and sides aimed at.
SPAN, SIDES = 8, 16
#: Visits that a task holds before it hands them on (about): they outnumber its rows by the blocks visited.
VISITS_AT_ONCE = 16_384
DIGITS = 9


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``rep, mult, vec``: one row per distinct vector, named by its smallest key."""
    return df.groupBy(F.col(vector).alias("vec")).agg(F.min(key).alias("rep"), F.count("*").alias("mult")) \
        .select("rep", "mult", "vec")


# ------------------------------------------------------------------ numpy helpers (run in tasks)
def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances rows(x) x rows(y), summed feature by feature."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def nearest_lists(d2: np.ndarray, reps: np.ndarray, mults: np.ndarray, k: int, own=None):
    """Per row of ``d2`` the ``k`` nearest columns by (rounded square, rep): lists
    of squares, representatives and counts; ``own`` names the row's own column."""
    d2 = np.round(d2, DIGITS)
    if own is not None:
        d2[np.arange(len(d2)), own] = np.inf
    order = np.argsort(reps, kind="stable")
    d2, reps, mults = d2[:, order], reps[order], mults[order]
    n = d2.shape[1]
    if n > 4 * k:           # all columns up to the k-th square, then a stable sort of those few
        bar = np.partition(d2, k - 1, axis=1)[:, k - 1]
        picks = [(lambda c: c[np.argsort(row[c], kind="stable")][:k])(np.flatnonzero(row <= b))
                 for row, b in zip(d2, bar)]
    else:
        picks = list(np.argsort(d2, axis=1, kind="stable")[:, :k])
    picks = [p[np.isfinite(row[p])] for row, p in zip(d2, picks)]
    return ([row[p].tolist() for row, p in zip(d2, picks)], [reps[p].tolist() for p in picks],
            [mults[p].tolist() for p in picks])


def nearest(x: np.ndarray, y: np.ndarray, reps: np.ndarray, mults: np.ndarray, k: int, own: bool = False):
    """``nearest_lists`` of the rows of ``x`` among those of ``y`` (``own``: both are
    the same rows, and none is its own neighbour).

    One matrix product tells which columns can be among the ``k`` nearest, with
    a margin above its rounding error; only their squares are summed exactly."""
    order = np.argsort(reps, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    y, reps, mults = y[order], reps[order], mults[order]
    lists: tuple = ([], [], [])
    y2 = (y ** 2).sum(axis=1)
    for at in range(0, len(x), 1024):
        part, mine = x[at:at + 1024], place[at:at + 1024]
        x2 = (part ** 2).sum(axis=1)
        near = x2[:, None] + y2[None, :] - 2 * (part @ y.T)
        if not np.isfinite(near).all():         # overflow: by the plain way
            got = nearest_lists(squares(part, y), reps, mults, k, own=mine if own else None)
            for held, more in zip(lists, got):
                held += more
            continue
        if own:
            near[np.arange(len(part)), mine] = np.inf
        bar = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(part), np.inf)
        slack = 2 * 10.0 ** -DIGITS + 1e-15 * (x.shape[1] + 4) * (x2 + y2.max(initial=0.0))
        row, col = np.nonzero((near <= (bar + slack)[:, None]) & (near < np.inf))
        d2 = np.zeros(len(row))
        for j in range(x.shape[1]):
            d2 += (part[row, j] - y[col, j]) ** 2
        d2 = np.round(d2, DIGITS)
        ranked = np.lexsort((col, d2, row))     # columns ascend by representative
        starts = np.searchsorted(row, np.arange(len(part) + 1))
        for a, b in zip(starts[:-1], starts[1:]):
            pick = ranked[a:min(b, a + k)]
            for held, values in zip(lists, (d2[pick], reps[col[pick]], mults[col[pick]])):
                held.append(values.tolist())
    return lists


def first_of(a: list, b: list, k: int) -> list:
    """The ``k`` first of two lists of ``(d2, rep, mult)``."""
    return sorted(a + b)[:k] if a and b else a or b


class Tree:
    """A k-d tree over a sample: leaves are numbered so that neighbours stand together."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.left, self.right, self.leaves = [], [], [], [], 0
        self._split(sample, leaves)

    def _split(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for held, value in ((self.dim, -1), (self.cut, 0.0), (self.left, self.leaves), (self.right, -1)):
            held.append(value)
        with np.errstate(all="ignore"):
            spread = np.nan_to_num(x.std(axis=0)) if len(x) and leaves > 1 else np.zeros(1)
        j = int(spread.argmax())
        if not spread[j] > 0:
            self.leaves += 1
            return node
        values = np.sort(x[:, j])
        cut = values[max(0, len(values) * (leaves // 2) // leaves - 1)]
        if not cut < values[-1]:
            cut = values[np.searchsorted(values, values[-1]) - 1]
        goes = x[:, j] <= cut
        self.dim[node], self.cut[node] = j, float(cut)
        self.left[node] = self._split(x[goes], leaves // 2)
        self.right[node] = self._split(x[~goes], leaves - leaves // 2)
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        dim, cut, left, right = (np.array(v) for v in (self.dim, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while len(live := np.flatnonzero(dim[at] >= 0)):
            node = at[live]
            at[live] = np.where(x[live, dim[node]] <= cut[node], left[node], right[node])
        return left[at]


def box_squares(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances rows(x) x boxes (0 inside)."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        out += np.maximum(0.0, np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j])) ** 2
    return out


def bar_of(nd, k: int) -> float:
    """What a box may be away (squared) from a vector with the squares ``nd``: beyond
    the k-th by the rounding of squares."""
    return float(nd[k - 1]) * (1 + 1e-9) + 3 * 10.0 ** -DIGITS if len(nd) >= k else np.inf


@dataclass
class Layout:
    """Cells around pivots, their borders (upper ends of rings; the last is the
    cell's radius) and hash parts per (cell, ring).  With ``boxes`` (least and most
    per cell and feature) cells have one ring each and only their boxes count."""
    pivots: np.ndarray
    borders: list
    parts: dict
    boxes: tuple | None = None

    def reach(self, to_pivots: np.ndarray, cell: int, radius: float) -> list[tuple[int, int]]:
        """The (cell, ring) pairs that may hold a vector within ``radius``."""
        slack = 1e-6 * (1.0 + radius)
        near = (to_pivots - to_pivots[cell]) / 2 <= radius + slack
        out = []
        for c in np.flatnonzero(near):
            b, d = self.borders[c], to_pivots[c]
            if not len(b) or d - b[-1] > radius + slack:
                continue
            lo = np.searchsorted(b, d - radius - slack)
            hi = min(np.searchsorted(b, d + radius + slack), len(b) - 1)
            out += [(int(c), r) for r in range(lo, hi + 1)]
        return out


def visits_of(f: pd.DataFrame, layout: Layout, k: int):
    """``rep, vec, cell, ring, part`` of every block that the rows of ``f`` must
    visit beside their own, in frames of about ``VISITS_AT_ONCE`` rows."""
    def frame(at, where):
        got = f.iloc[at][["rep", "vec"]].reset_index(drop=True)
        return got.assign(**{name: np.array([w[j] for w in where], dtype="int32")
                             for j, name in enumerate(("cell", "ring", "part"))})

    x = matrix(f["vec"])
    near = None
    if layout.boxes is None:
        to_pivots = np.sqrt(squares(x, layout.pivots))
    at, where = [], []
    for i, (c, r, p, nd) in enumerate(zip(f["cell"], f["ring"], f["part"], f["nd"])):
        if layout.boxes is None:
            reached = layout.reach(to_pivots[i], c, float(np.sqrt(nd[k - 1])) if len(nd) >= k else np.inf)
        else:
            if i % 512 == 0:
                near = box_squares(x[i:i + 512], *layout.boxes)
            reached = [(int(cell), 0) for cell in np.flatnonzero(near[i % 512] <= bar_of(nd, k))]
        for cell, ring in reached:
            here = [(cell, ring, s) for s in range(layout.parts.get((cell, ring), 0)) if (cell, ring, s) != (c, r, p)]
            where += here
            at += [i] * len(here)
        if len(where) >= VISITS_AT_ONCE:
            yield frame(at, where)
            at, where = [], []
    if where:
        yield frame(at, where)


def _sample(vectors: DataFrame, n: int, want: int, seed: int) -> np.ndarray:
    """A bounded sample by hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 40))
    cut = int((1 << 40) * min(1.0, 2.0 * want / n))
    rows = vectors.select("vec", u.alias("u")).where(F.col("u") < cut).orderBy("u").limit(want).select("vec").toArrow()
    rows = rows if len(rows) else vectors.select("vec").limit(1).toArrow()
    return np.array(rows.column("vec").to_pylist(), dtype=float)


def nearest_neighbours(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``rep, mult, vec, near``: for every row of ``distinct_vectors`` the ``k``
    nearest other vectors, nearest first, as an array of ``(d2, rep, mult)``
    (fewer if there are fewer).  Exact.  Vectors must have one length and no
    NULL or non-finite component; an empty table stays empty."""
    keytype = dict(vectors.dtypes)["rep"]
    near_type = f"array<struct<d2:double,rep:{keytype},mult:bigint>>"
    n = vectors.count()
    if n == 0:
        return vectors.withColumn("near", F.lit(None).cast(near_type))
    leaves = int(min(CELLS, max(1, n // BLOCK_ROWS)))
    tree = Tree(_sample(vectors, n, leaves * SAMPLED, seed), leaves)

    def to_cells(frames):
        for f in frames:
            yield f.assign(cell=tree.leaf(matrix(f["vec"])).astype("int32"))

    base = f"rep {keytype}, mult long, vec array<double>"
    cells = materialize(vectors.mapInPandas(to_cells, f"{base}, cell int"), "knn-cells")
    width = cells.select(F.size("vec").alias("w")).first()["w"]
    ends = [f(F.col("vec")[j]).alias(f"{name}{j}") for j in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()}
    boxes = tuple(np.array([[stats[c][f"{name}{j}"] if c in stats else np.inf for j in range(width)]
                            for c in range(tree.leaves)]).reshape(tree.leaves, width) for name in ("lo", "hi"))
    layout = Layout(None, [], {(c, 0): -(-r["n"] // BLOCK_ROWS) for c, r in stats.items()}, boxes)
    parts = np.array([layout.parts.get((c, 0), 1) for c in range(tree.leaves)])
    span = int(np.clip(tree.leaves // SIDES, 1, SPAN))

    def to_parts(frames):
        for f in frames:
            yield f.assign(part=(f["u"].to_numpy() % parts[f["cell"]]).astype("int32"), ring=np.int32(0),
                           side=(f["cell"] // span).astype("int32")).drop(columns="u")

    blocks = cells.withColumn("u", F.pmod(F.xxhash64(F.lit(seed + 1), "vec"), F.lit(1 << 40))) \
        .mapInPandas(to_parts, f"{base}, cell int, ring int, part int, side int")
    lists = f"nd array<double>, nr array<{keytype}>, nm array<bigint>"

    def search(x, at_least, cell, part, host, skip_own):
        """Per row of ``x`` its nearest among the blocks of ``host`` (columns cell, part, x, rep, mult) that are
        within reach; with ``skip_own`` the rows of ``x`` are those of ``host``, and their own block comes first."""
        held: list[list] = [[] for _ in range(len(x))]
        bars = np.array(at_least, dtype=float)
        near = box_squares(x, *(b[cells_here] for b in boxes)) if len(cells_here := np.unique(host["cell"])) else None
        where = {(c, p): np.flatnonzero((host["cell"] == c) & (host["part"] == p))
                 for c, p in sorted(set(zip(host["cell"].tolist(), host["part"].tolist())))}

        def add(rows, at, own):
            got = nearest(x[rows], host["x"][at], host["rep"][at], host["mult"][at], k, own=own)
            for i, *found in zip(rows.tolist(), *got):
                held[i] = first_of(held[i], list(zip(*found)), k)
                bars[i] = min(bars[i], bar_of([h[0] for h in held[i]], k))

        if skip_own:
            for at in where.values():
                add(at, at, True)
        for (c, p), at in where.items():
            open_ = near[:, np.searchsorted(cells_here, c)] <= bars
            if skip_own:
                open_ &= (cell != c) | (part != p)
            rows = np.flatnonzero(open_)
            if len(rows):
                add(rows, at, False)
        return [[list(v) for v in zip(*h)] or [[], [], []] for h in held]

    def columns(f, prefix=""):
        get = lambda name: f[prefix + name].to_numpy()
        return {"cell": get("cell"), "part": get("part"), "x": matrix(f[prefix + "vec"]), "rep": get("rep"), "mult": get("mult")}

    def own_side(f: pd.DataFrame) -> pd.DataFrame:
        host = columns(f)
        got = search(host["x"], np.full(len(f), np.inf), host["cell"], host["part"], host, True)
        return f.assign(**{name: [g[j] for g in got] for j, name in enumerate(("nd", "nr", "nm"))})

    found = f"{base}, cell int, ring int, part int, side int, {lists}"
    first = materialize(blocks.groupBy("side").applyInPandas(own_side, found), "knn-own")

    def to_visits(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            own = dict(zip(f["rep"], zip(f["side"], f["nd"])))
            for v in visits_of(f, layout, k):
                v = v.assign(side=(v["cell"] // span).astype("int32")).drop_duplicates(["rep", "side"])
                v = v[v["side"].to_numpy() != np.array([own[r][0] for r in v["rep"]])]
                yield v[["rep", "vec", "side"]].assign(bar=[bar_of(own[r][1], k) for r in v["rep"]])

    # copies need no search beyond themselves: all k neighbours are the vector itself
    asking = first.where(F.col("mult") <= k).select("rep", "vec", "cell", "ring", "part", "side", "nd")
    visits = materialize(asking.mapInPandas(
        to_visits, f"rep {keytype}, vec array<double>, side int, bar double"), "knn-visits")
    counts = [(r["side"], -(-r["count"] // VISITORS)) for r in visits.groupBy("side").count().collect()]
    groups = F.broadcast(vectors.sparkSession.createDataFrame(counts, "side int, groups long"))     # a row per side
    dealt = visits.join(groups, "side").withColumn("g", F.pmod(F.xxhash64("rep"), F.col("groups")))
    # names of its own: both sides come from the same table
    host = ("rep", "mult", "vec", "cell", "part", "side")
    hosts = first.select(*host).join(groups, "side").select(
        *[F.col(c).alias(f"h_{c}") for c in host],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("h_g"))

    def visit(_, guests: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(host):
            return pd.DataFrame({"rep": [], "nd": [], "nr": [], "nm": []})
        got = search(matrix(guests["vec"]), guests["bar"].to_numpy(), None, None, columns(host, "h_"), False)
        return pd.DataFrame({"rep": guests["rep"].to_numpy(), **{
            name: [g[j] for g in got] for j, name in enumerate(("nd", "nr", "nm"))}})

    second = dealt.groupBy("side", "g").cogroup(hosts.groupBy("h_side", "h_g")).applyInPandas(
        visit, f"rep {keytype}, {lists}")
    zipped = F.arrays_zip(F.col("nd").alias("d2"), F.col("nr").alias("rep"), F.col("nm").alias("mult"))
    every = first.select("rep", "nd", "nr", "nm").unionByName(second)
    merged = every.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list(
        F.transform(zipped, lambda s: F.struct(s["d2"].alias("d2"), s["rep"].alias("rep"), s["mult"].alias("mult")))
    ))), 1, k).alias("near"))
    return first.select("rep", "mult", "vec").join(merged, "rep")


# ------------------------------------------------------------------ SMOTE
@dataclass
class Balanced:
    """The balanced table, and why it was left as it is (None: it was not)."""
    table: DataFrame
    skipped: str | None
    synthetic: int


def _unit(text, first: int):
    """A number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(text, first, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def smote(df: DataFrame, key: str, label: str, features, ratio: float = 0.2, k: int = 5, min_positives: int = 5,
          seed: int = 42, index: str = "replica") -> Balanced:
    """M9: raise the positives to ``ratio`` of the negatives by rows between a
    positive and one of its ``k`` nearest positives.

    Left as it is (with the reason) if there are fewer than ``min_positives``
    positives, if a feature holds a NULL or NaN, or if the positives reach the
    target.  The missing rows are dealt evenly to the positives in the order of
    ``md5(seed:key)``; row ``replica`` (1, 2, ...) of a positive takes a
    neighbour and a share from the digest of seed, key and replica.  Copies of a
    vector are its nearest neighbours.  Output: ``key, label, replica`` (0 for
    the rows of ``df``) and the features as doubles; other columns are dropped.
    A synthetic row carries the key of the positive it starts from; keys must be
    unique and not NULL."""
    features = list(features)
    double = [F.col(c).cast("double").alias(c) for c in features]
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    r = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
               F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad")).first()
    target = int(r["neg"] * ratio)
    whole = df.select(key, label, F.lit(0).cast("long").alias(index), *double)
    reason = ("too few positives" if r["pos"] < min_positives else "missing values" if r["bad"]
              else "balanced already" if target <= r["pos"] else None)
    if reason:
        return Balanced(whole, reason, 0)
    missing, near = target - r["pos"], int(min(k, r["pos"] - 1))
    vec = F.array(*[F.col(c).cast("double") for c in features])
    positives = df.where(F.col(label) == 1).select(F.col(key).alias("key"), F.col(label).alias("label"), vec.alias("vec"))
    vectors = materialize(distinct_vectors(positives, "key", "vec"), "smote-vectors")
    with temporary_tables(df.sparkSession) as keep:
        lists = keep(materialize(nearest_neighbours(vectors, near, seed), "smote-neighbours"))
    # the neighbours in order: copies of the vector, then the others with their copies
    times = lambda v, m: F.array_repeat(v, F.least(m, F.lit(near)).cast("int"))
    order = F.concat(times(F.col("rep"), F.col("mult") - 1),
                     F.flatten(F.transform("near", lambda x: times(x["rep"], x["mult"]))))
    each, more = divmod(missing, r["pos"])
    ranked = class_rank(positives.select("key", "label", "vec"), "label", "key", seed)
    copies = F.lit(each) + (F.col("__rank") <= more).cast("int")
    made = ranked.withColumn("n", copies).where("n > 0").select(
        "key", "label", "vec", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("replica"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("key").cast("string"), F.col("replica").cast("string")))
    made = made.withColumn("h", digest).withColumn("pick", F.floor(_unit(F.col("h"), 1) * near).cast("int")) \
        .withColumn("u", _unit(F.col("h"), 9))
    chosen = made.join(lists.select("vec", order.alias("order")), "vec").withColumn("to", F.get("order", F.col("pick")))
    ends = vectors.select(F.col("rep").alias("to"), F.col("vec").alias("end"))
    new = chosen.join(ends, "to").withColumn("x", F.zip_with("vec", "end", lambda a, b: a + F.col("u") * (b - a)))
    rows = new.select(F.col("key").alias(key), F.col("label").alias(label), F.col("replica").alias(index),
                      *[F.col("x")[i].alias(c) for i, c in enumerate(features)])
    return Balanced(whole.unionByName(rows), None, missing)
