"""Attribution.

L12 computes path-dependent TreeSHAP values for an MLlib GBT model.  The
forest comes from the model's saved node table (``data/`` parquet:
``treeID, nodeData{id, prediction, rawCount, leftChild, rightChild,
split}``) -- its size is bounded by the model (trees x nodes), not by the
data -- and travels to the tasks inside the ``mapInPandas`` closure.  Each
task explains its own rows; output is long ``(key, feature, contribution)``.
For a GBT the explained quantity is the margin sum_t w_t * tree_t(x);
probability = 1 / (1 + exp(-2 * margin)).  Contributions + base value =
margin for every row.

What a leaf gives a row depends on the row only through which of the leaf's
features it satisfies.  So the Shapley weights of a leaf are computed once for
every such pattern (``leaf_tables``), and a row looks its pattern up.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks get these functions with the job: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    null_left: np.ndarray | None = None     # where NaN goes; None: right

    def expected(self) -> float:
        leaves = self.left < 0
        return float(np.sum(self.value[leaves] * self.cover[leaves]) / self.cover[0])

    def predict(self, x) -> float:
        j = 0
        while self.left[j] >= 0:
            j = self.left[j] if x[self.feature[j]] <= self.threshold[j] else self.right[j]
        return float(self.value[j])


def forest_from_model(gbt_model, spark, path: str) -> tuple[list[Tree], list[float]]:
    """Read the forest of a fitted GBT model through its saved node table."""
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
        "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feat"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("thr")).toPandas()
    trees = []
    for _, g in nodes.groupby("treeID", sort=True):
        g = g.sort_values("id")
        idx = {int(i): k for k, i in enumerate(g["id"])}
        remap = np.vectorize(lambda c: idx.get(int(c), -1))
        lc = g["leftChild"].to_numpy()
        rc = g["rightChild"].to_numpy()
        trees.append(Tree(left=np.where(lc >= 0, remap(lc), -1), right=np.where(rc >= 0, remap(rc), -1),
                          feature=g["feat"].fillna(-1).to_numpy().astype(int),
                          threshold=g["thr"].fillna(0.0).to_numpy().astype(float),
                          value=g["prediction"].to_numpy().astype(float),
                          cover=np.maximum(g["rawCount"].to_numpy().astype(float), 1e-12)))
    return trees, [float(w) for w in gbt_model.treeWeights]


# ---------------------------------------------------------------- TreeSHAP
def _extend(path, pz, po, pi):
    depth = len(path)
    path.append([pi, pz, po, 1.0 if depth == 0 else 0.0])
    for i in range(depth - 1, -1, -1):
        path[i + 1][3] += po * path[i][3] * (i + 1) / (depth + 1)
        path[i][3] = pz * path[i][3] * (depth - i) / (depth + 1)


def _unwind(path, i):
    last = len(path) - 1
    o, z = path[i][2], path[i][1]
    nxt = path[last][3]
    for j in range(last - 1, -1, -1):
        if o != 0:
            tmp = path[j][3]
            path[j][3] = nxt * (last + 1) / ((j + 1) * o)
            nxt = tmp - path[j][3] * z * (last - j) / (last + 1)
        else:
            path[j][3] = path[j][3] * (last + 1) / (z * (last - j))
    for j in range(i, last):
        path[j][0], path[j][1], path[j][2] = path[j + 1][0], path[j + 1][1], path[j + 1][2]
    path.pop()


def _unwound_sum(path, i):
    last = len(path) - 1
    o, z = path[i][2], path[i][1]
    nxt = path[last][3]
    total = 0.0
    for j in range(last - 1, -1, -1):
        if o != 0:
            tmp = nxt * (last + 1) / ((j + 1) * o)
            total += tmp
            nxt = path[j][3] - tmp * z * (last - j) / (last + 1)
        else:
            total += path[j][3] / z / ((last - j) / (last + 1))
    return total


def tree_shap(tree: Tree, x, phi, scale: float = 1.0) -> None:
    """Add ``scale`` x the path-dependent Shapley values of ``tree`` at ``x``
    to ``phi`` (Lundberg et al., polynomial-time TreeSHAP)."""
    def rec(j, path, pz, po, pi):
        path = [list(e) for e in path]
        _extend(path, pz, po, pi)
        if tree.left[j] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                phi[path[i][0]] += scale * w * (path[i][2] - path[i][1]) * tree.value[j]
            return
        f = tree.feature[j]
        hot, cold = ((tree.left[j], tree.right[j]) if x[f] <= tree.threshold[j]
                     else (tree.right[j], tree.left[j]))
        iz = io = 1.0
        for k in range(1, len(path)):
            if path[k][0] == f:
                iz, io = path[k][1], path[k][2]
                _unwind(path, k)
                break
        c = tree.cover[j]
        rec(hot, path, iz * tree.cover[hot] / c, io, f)
        rec(cold, path, iz * tree.cover[cold] / c, 0.0, f)
    rec(0, [], 1.0, 1.0, -1)


# ---------------------------------------------------------------- TreeSHAP, vectorized
# The recursion visits every node for every row; only the 0/1 "one
# fractions" (and the path weights derived from them) depend on the row.
# So one walk of the tree explains a whole batch: the per-row quantities are
# numpy vectors, the structural ones (feature, zero fraction) are scalars.
def _extend_v(path, pz, po, pi, n):
    depth = len(path)
    path.append([pi, pz, po, np.full(n, 1.0 if depth == 0 else 0.0)])
    for i in range(depth - 1, -1, -1):
        path[i + 1][3] = path[i + 1][3] + po * path[i][3] * ((i + 1) / (depth + 1))
        path[i][3] = pz * path[i][3] * ((depth - i) / (depth + 1))


def _unwind_v(path, i):
    last = len(path) - 1
    o, z = path[i][2], path[i][1]
    nz = o != 0
    o_safe = np.where(nz, o, 1.0)
    nxt = path[last][3]
    for j in range(last - 1, -1, -1):
        tmp = path[j][3]
        a = nxt * (last + 1) / ((j + 1) * o_safe)
        b = tmp * (last + 1) / (z * (last - j))
        nxt = np.where(nz, tmp - a * z * ((last - j) / (last + 1)), nxt)
        path[j][3] = np.where(nz, a, b)
    for j in range(i, last):
        path[j][0], path[j][1], path[j][2] = path[j + 1][0], path[j + 1][1], path[j + 1][2]
    path.pop()


def _unwound_sum_v(path, i):
    last = len(path) - 1
    o, z = path[i][2], path[i][1]
    nz = o != 0
    o_safe = np.where(nz, o, 1.0)
    nxt = path[last][3]
    total = np.zeros_like(nxt)
    for j in range(last - 1, -1, -1):
        tmp = nxt * (last + 1) / ((j + 1) * o_safe)
        total = total + np.where(nz, tmp, path[j][3] / z / ((last - j) / (last + 1)))
        nxt = np.where(nz, path[j][3] - tmp * z * ((last - j) / (last + 1)), nxt)
    return total


def tree_shap_batch(tree: Tree, X: np.ndarray, phi: np.ndarray, scale: float = 1.0) -> None:
    """Vectorized ``tree_shap`` over the rows of ``X`` (n x features);
    adds into ``phi`` (n x features)."""
    n = X.shape[0]

    def rec(j, path, pz, po, pi):
        path = [list(e) for e in path]
        _extend_v(path, pz, po, pi, n)
        if tree.left[j] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum_v(path, i)
                phi[:, path[i][0]] += scale * tree.value[j] * w * (path[i][2] - path[i][1])
            return
        f = tree.feature[j]
        go_left = X[:, f] <= tree.threshold[j]
        iz, io = 1.0, np.ones(n)
        for k in range(1, len(path)):
            if path[k][0] == f:
                iz, io = path[k][1], path[k][2]
                _unwind_v(path, k)
                break
        c = tree.cover[j]
        le, ri = tree.left[j], tree.right[j]
        rec(le, path, iz * tree.cover[le] / c, io * go_left, f)
        rec(ri, path, iz * tree.cover[ri] / c, io * ~go_left, f)

    rec(0, [], 1.0, np.ones(n), -1)


# ---------------------------------------------------------------- TreeSHAP, by leaf
@dataclass
class LeafTable:
    """One leaf: its features in order of first use, per feature the edges
    ``(node, goes left)`` of the path, and contributions by pattern (bit ``k``:
    the row satisfies all edges of feature ``k``), patterns x features."""
    features: list
    edges: list
    shares: np.ndarray


def _paths(tree: Tree):
    """Per leaf ``(leaf, {feature: (edges, zero fraction)})``."""
    stack = [(0, {})]
    while stack:
        j, path = stack.pop()
        if tree.left[j] < 0:
            yield j, path
            continue
        f = int(tree.feature[j])
        for child, goes_left in ((tree.left[j], True), (tree.right[j], False)):
            edges, zero = path.get(f, ((), 1.0))
            stack.append((int(child), {**path, f: ((*edges, (j, goes_left)), zero * tree.cover[child] / tree.cover[j])}))


def _shares(zero: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contributions of leaves with the same number ``d`` of features: ``zero``
    is leaves x d, the result leaves x 2**d patterns x d."""
    n, d = zero.shape
    one = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)       # patterns x d
    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty((n, 1 << d, d))
    for i in range(d):
        # by number of known features: the sum over all sets of the others
        sums = np.zeros((n, 1 << d, d))
        sums[:, :, 0] = 1.0
        for j in (x for x in range(d) if x != i):
            known = sums[:, :, :-1] * one[None, :, j, None]
            sums = sums * zero[:, None, j, None]
            sums[:, :, 1:] += known
        out[:, :, i] = value[:, None] * (one[None, :, i] - zero[:, i, None]) * (sums @ weight)
    return out


def leaf_tables(tree: Tree, scale: float = 1.0) -> list[LeafTable]:
    """The tables of all leaves that stand below a split."""
    by_size: dict[int, list] = {}
    for leaf, path in _paths(tree):
        if path:
            by_size.setdefault(len(path), []).append((leaf, path))
    out = []
    for leaves in by_size.values():
        zero = np.array([[z for _, z in path.values()] for _, path in leaves])
        shares = _shares(zero, scale * np.array([tree.value[leaf] for leaf, _ in leaves]))
        out += [LeafTable(list(path), [e for e, _ in path.values()], s) for (_, path), s in zip(leaves, shares)]
    return out


def add_contributions(tree: Tree, tables: list[LeafTable], X: np.ndarray, phi: np.ndarray) -> None:
    """Add a tree's contributions to ``phi`` (features x rows) for the rows of
    ``X`` (features x rows, NaN for NULL)."""
    left = {}
    for j in np.flatnonzero(tree.left >= 0):
        x = X[tree.feature[j]]
        goes = x <= tree.threshold[j]
        left[j] = goes | np.isnan(x) if tree.null_left is not None and tree.null_left[j] else goes
    # bytes: the patterns of a leaf of up to eight features fit one
    went = {(j, side): (goes if side else ~goes).view(np.uint8) for j, goes in left.items() for side in (True, False)}
    for t in tables:
        kind = np.uint8 if len(t.edges) <= 8 else np.int64
        pattern = np.zeros(X.shape[1], kind)
        for k, edges in enumerate(t.edges):
            ok = went[edges[0]]
            for e in edges[1:]:
                ok = ok & went[e]
            pattern |= ok.astype(kind, copy=False) << kind(k)
        at = pattern.astype(np.intp)
        for k, f in enumerate(t.features):
            phi[f] += t.shares[:, k].take(at)


#: Numbers in the leaf tables that a task keeps from one batch to the next: 32 MB.
TABLE_CELLS = 4_000_000


def kept_tables(trees, weights):
    """A function that gives the tables of a tree by its number, made once each as
    long as those kept have room: they grow with 2**depth."""
    kept: dict = {}
    room = TABLE_CELLS

    def of(i: int) -> list[LeafTable]:
        nonlocal room
        if i in kept:
            return kept[i]
        tables = [LeafTable(t.features, t.edges, np.asfortranarray(t.shares)) for t in leaf_tables(trees[i], weights[i])]
        cells = sum(t.shares.size for t in tables)
        if cells <= room:
            kept[i], room = tables, room - cells
        return tables

    return of


def matrix(arrays: pa.Array, width: int) -> np.ndarray:
    """The arrays of ``width`` numbers of a column as rows x ``width`` (NULL: NaN)."""
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(arrays), width)


def base_value(trees, weights) -> float:
    return float(sum(w * t.expected() for t, w in zip(trees, weights)))


def attribution_rows(df: DataFrame, key: str, feature_cols, trees, weights,
                     sentinel: float | None = -1.0e6, keep=()) -> DataFrame:
    """``(key, *keep, contributions)`` for every row of ``df``; the array holds
    one ``(feature, contribution)`` per feature, so what is ranked or summed
    per row needs no shuffle.  ``df`` holds the model's input columns (the
    same NULL -> sentinel fill as at training is applied here)."""
    names = list(feature_cols)
    src = df.select(F.col(key).alias("__key"), *keep,
                    F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(sentinel))
                              if sentinel is not None else F.col(c).cast("double")
                              for c in names]).alias("__x"))
    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (key, *keep))

    def explain(batches):
        tables = kept_tables(trees, weights)
        for batch in batches:
            X = np.ascontiguousarray(matrix(batch.column("__x"), len(names)).T)
            phi = np.zeros(X.shape)
            for i, t in enumerate(trees):
                add_contributions(t, tables(i), X, phi)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("__key", *keep)] + [pa.ListArray.from_arrays(ends, phi.T.ravel())],
                names=[key, *keep, "phi"])

    labels = F.array(*[F.lit(c) for c in names])
    return src.mapInArrow(explain, types + "phi array<double>").select(
        key, *keep, F.zip_with(labels, "phi", lambda f, v: F.struct(f.alias("feature"), v.alias("contribution")))
        .alias("contributions"))


def attribution(df: DataFrame, key: str, feature_cols, trees, weights,
                sentinel: float | None = -1.0e6) -> DataFrame:
    """L12 in long form: ``(key, feature, contribution)``."""
    return long_form(attribution_rows(df, key, feature_cols, trees, weights, sentinel), key)


def long_form(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.inline("contributions"))


# ---------------------------------------------------------------- L13-L15
def _by_size(contributions: str):
    """The contributions by descending size, ties by feature name."""
    return F.sort_array(F.transform(contributions, lambda x: F.struct(
        (-F.abs(x["contribution"])).alias("size"), x["feature"].alias("feature"),
        x["contribution"].alias("contribution"))))


def top_factor_names(contributions: str, k: int = 5):
    """The features of the ``k`` largest |contribution| of a row, in order."""
    return F.transform(F.slice(_by_size(contributions), 1, k), lambda x: x["feature"])


def top_factors(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` largest |contribution| per row (ties: feature name),
    with direction, from ``(key, contributions)``; no shuffle."""
    top = rows.select(key, F.posexplode(F.slice(_by_size("contributions"), 1, k)).alias("at", "x"))
    return top.select(key, "x.feature", "x.contribution", (F.col("at") + 1).alias("rank"),
                      F.when(F.col("x.contribution") > 0, F.lit("increases risk"))
                      .otherwise(F.lit("decreases risk")).alias("direction"))


def global_attribution(contrib: DataFrame, k: int | None = 5) -> DataFrame:
    """Mean |contribution| per feature (all rows), largest first."""
    g = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    g = g.orderBy(F.col("mean_abs").desc(), F.col("feature"))
    return g.limit(k) if k else g


def waterfall(rows: DataFrame, key: str, base) -> DataFrame:
    """Per row, contributions ordered by |value| (desc) with the running
    total from the base value to the margin, from ``(key, contributions)``;
    no shuffle."""
    b = base if not isinstance(base, (int, float)) else F.lit(float(base))
    steps = F.aggregate(
        _by_size("contributions"),
        F.struct(F.lit(0.0).alias("total"), F.array().cast(
            "array<struct<feature:string,contribution:double,total:double>>").alias("steps")),
        lambda a, x: F.struct((a["total"] + x["contribution"]).alias("total"), F.array_append(a["steps"], F.struct(
            x["feature"].alias("feature"), x["contribution"].alias("contribution"),
            (a["total"] + x["contribution"]).alias("total"))).alias("steps")),
        lambda a: a["steps"])
    return rows.select(key, F.posexplode(steps).alias("at", "x")).select(
        key, "x.feature", "x.contribution", (F.col("at") + 1).alias("step"), (b + F.col("x.total")).alias("cumulative"))
