"""Attribution: vectorized TreeSHAP = reference recursion; additivity on a
trained MLlib model."""

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import explain as X
from riskframe.operators import model as L
from riskframe.session import scratch_path


def test_vectorized_equals_scalar():
    rng = np.random.default_rng(7)
    left = np.array([1, 3, 5, -1, -1, -1, -1]); right = np.array([2, 4, 6, -1, -1, -1, -1])
    tree = X.Tree(left, right, np.array([0, 1, 1, -1, -1, -1, -1]), np.array([0.0, 0.5, -0.5, 0, 0, 0, 0]),
                  rng.normal(size=7), np.array([10.0, 6, 4, 2, 4, 3, 1]))
    Xs = rng.normal(size=(50, 2))
    a = np.zeros((50, 2))
    X.tree_shap_batch(tree, Xs, a)
    for i in range(50):
        b = np.zeros(2)
        X.tree_shap(tree, Xs[i], b)
        assert np.allclose(a[i], b, atol=1e-12)
        assert abs(b.sum() + tree.expected() - tree.predict(Xs[i])) < 1e-12


def random_tree(rng, depth, features):
    """A full tree with repeated features on its paths; NaN goes as drawn."""
    n = 2 ** (depth + 1) - 1
    inner = 2 ** depth - 1
    node = np.arange(n)
    left = np.where(node < inner, 2 * node + 1, -1)
    right = np.where(node < inner, 2 * node + 2, -1)
    cover = rng.integers(1, 9, n).astype(float)
    for j in range(inner - 1, -1, -1):
        cover[j] = cover[left[j]] + cover[right[j]]
    return X.Tree(left, right, np.where(node < inner, rng.integers(0, features, n), -1), rng.normal(size=n),
                  rng.normal(size=n), cover, rng.integers(0, 2, n).astype(bool))


def test_leaf_tables_equal_the_walk():
    rng = np.random.default_rng(8)
    for depth in (0, 1, 3, 6):
        tree, Xs = random_tree(rng, depth, 5), rng.normal(size=(200, 5))
        want, got = np.zeros((200, 5)), np.zeros((5, 200))
        X.tree_shap_batch(tree, Xs, want, 0.7)
        X.add_contributions(tree, X.leaf_tables(tree, 0.7), np.ascontiguousarray(Xs.T), got)
        assert np.abs(got.T - want).max() < 1e-9


def test_leaf_tables_with_missing_values_equal_all_subsets():
    """Against the definition: every set of known features, unknown ones by cover."""
    from itertools import combinations
    from math import factorial
    rng = np.random.default_rng(9)
    tree, Xs = random_tree(rng, 4, 4), rng.normal(size=(30, 4))
    Xs[rng.random(Xs.shape) < 0.3] = np.nan

    def value(x, known, j=0):
        if tree.left[j] < 0:
            return tree.value[j]
        f, sides = tree.feature[j], (tree.left[j], tree.right[j])
        if f in known:
            goes = tree.null_left[j] if np.isnan(x[f]) else x[f] <= tree.threshold[j]
            return value(x, known, sides[0] if goes else sides[1])
        return sum(tree.cover[c] / tree.cover[j] * value(x, known, c) for c in sides)

    got = np.zeros((4, 30))
    X.add_contributions(tree, X.leaf_tables(tree), np.ascontiguousarray(Xs.T), got)
    for i, x in enumerate(Xs):
        for f in range(4):
            others = [o for o in range(4) if o != f]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (value(x, {*s, f}) - value(x, set(s)))
                       for k in range(4) for s in combinations(others, k))
            assert abs(got[f, i] - want) < 1e-9


def test_gbt_attribution_is_additive(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=n)) > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int")
    feats = ["a", "b", "c"]
    model = L.train_gbt(df, feats, "y", None, max_iter=5, max_depth=3)
    trees, weights = X.forest_from_model(model.stages[-1], spark, scratch_path(spark, "t_forest"))
    base = X.base_value(trees, weights)
    contrib = X.attribution(df, "k", feats, trees, weights)
    tot = contrib.groupBy("k").agg(F.sum("contribution").alias("t"))
    s = L.score(df, model, feats, keep=["k"]).join(tot, "k")
    err = s.select(F.max(F.abs(F.col("margin") - F.col("t") - F.lit(base))).alias("e")).first().e
    assert err < 1e-9


def test_ranked_contributions_need_no_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, [("a", 0.5), ("b", -2.0), ("c", 0.5)]), (2, [("a", 0.0), ("b", 0.0), ("c", 1.0)])],
        "k long, contributions array<struct<feature:string,contribution:double>>")
    top, walk = X.top_factors(rows, "k", 2), X.waterfall(rows, "k", 1.0)
    for df in (top, walk):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.feature, r["rank"], r.direction) for r in top.orderBy("k", "rank").collect()] == [
        (1, "b", 1, "decreases risk"), (1, "a", 2, "increases risk"),
        (2, "c", 1, "increases risk"), (2, "a", 2, "decreases risk")]
    assert [(r.feature, r.cumulative) for r in walk.where("k = 1").orderBy("step").collect()] == [
        ("b", -1.0), ("a", -0.5), ("c", 0.0)]
    assert X.long_form(rows, "k").count() == 6


def test_leaf_tables_are_made_once_within_their_room(monkeypatch):
    """Tables are kept from batch to batch up to a bound, and give the same sums."""
    made, real = [], X.leaf_tables
    monkeypatch.setattr(X, "leaf_tables", lambda t, w: made.append(1) or real(t, w))
    tree = X.Tree(np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 1, -1, -1, -1]),
                  np.array([0.5, 0.2, 0, 0, 0]), np.array([0, 0, 3.0, 1.0, 2.0]), np.array([10.0, 6, 4, 2, 4]))
    x = np.random.default_rng(1).random((2, 50))
    for room, times in ((10_000, 2), (0, 6)):
        monkeypatch.setattr(X, "TABLE_CELLS", room)
        of, phi = X.kept_tables([tree, tree], [1.0, 0.5]), np.zeros((2, 50))
        made.clear()
        for _ in range(3):
            for i in range(2):
                X.add_contributions(tree, of(i), x, phi)
        assert len(made) == times
        for r in range(50):
            want = np.zeros(2)
            X.tree_shap(tree, x[:, r], want, 4.5)
            assert np.allclose(phi[:, r], want, atol=1e-12)
