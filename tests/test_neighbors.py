"""k nearest neighbours and SMOTE (M9) against brute force; the three gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbors as N


def frame(spark, vectors, keys=None):
    keys = keys if keys is not None else range(len(vectors))
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(keys, vectors)],
                                 "key long, vec array<double>")


def brute(vectors, k):
    """rep -> (mult, [(d2, rep, mult)]) over distinct vectors."""
    reps = {}
    for i, v in enumerate(vectors):
        reps.setdefault(tuple(map(float, v)), []).append(i)
    rows = [(min(ix), len(ix), np.array(v)) for v, ix in reps.items()]
    out = {}
    for rep, mult, v in rows:
        near = sorted((round(float(((v - w) ** 2).sum()), N.DIGITS), r, m) for r, m, w in rows if r != rep)
        out[rep] = (mult, near[:k])
    return out


@pytest.mark.parametrize("block", [7, 60, 100_000])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "VISITORS", 50)
    rng = np.random.default_rng(block)
    clusters = rng.normal(size=(8, 4)) * 10
    vectors = np.concatenate([
        np.round(clusters[rng.integers(0, 8, 200)] + rng.normal(size=(200, 4)), 3),
        rng.integers(0, 2, (150, 4)).astype(float),              # few distinct vectors: copies and ties
        np.tile([[3.0, 1.0, 4.0, 1.0]], (120, 1)),               # a third are one vector
        [[1e6, 0, 0, 0], [-1e6, 0, 0, 0], [0.0, -0.0, 0.0, 0.0]]])
    vectors = vectors + 0.0
    got = N.nearest_neighbours(N.distinct_vectors(frame(spark, vectors).repartition(5), "key", "vec"), 5).collect()
    want = brute(vectors, 5)
    assert {r["rep"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        mult, near = want[r["rep"]]
        assert r["mult"] == mult
        if mult <= 5:                                            # otherwise the copies are the neighbours
            assert [(x["rep"], x["mult"]) for x in r["near"]] == [(a, b) for _, a, b in near]


def test_fewer_rows_than_neighbours_and_empty(spark):
    d = N.distinct_vectors(frame(spark, [[0.0], [1.0], [5.0]]), "key", "vec")
    got = {r["rep"]: [x["rep"] for x in r["near"]] for r in N.nearest_neighbours(d, 5).collect()}
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert N.nearest_neighbours(d.where("rep < 0"), 5).count() == 0


def test_visits_grow_slower_than_the_square(spark, monkeypatch):
    """Rows sent to other blocks, per row, must not grow with the table."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 200)
    sent = {}
    seen = []
    real = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: (lambda t: (seen.append(t.count()) if name == "knn-visits"
                                                                       else None, t)[1])(real(df, name)))
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        vectors = rng.normal(size=(n // 100, 3))[rng.integers(0, n // 100, n)] * 50 + rng.normal(size=(n, 3))
        N.nearest_neighbours(N.distinct_vectors(frame(spark, vectors), "key", "vec"), 5).count()
        sent[n] = seen[-1]
    assert sent[8000] < 8 * max(sent[2000], 2000)                 # the square would be 16 times


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, a double, b double, note string")


def rows_of(pos, neg, rng):
    return [(i, 1, float(rng.normal()), float(rng.integers(0, 2)), "x") for i in range(pos)] + \
        [(1000 + i, 0, float(rng.normal()), 0.0, "x") for i in range(neg)]


def test_smote_counts_lines_and_determinism(spark):
    rows = rows_of(30, 400, np.random.default_rng(1))
    got = N.smote(table(spark, rows), "id", "y", ["a", "b"], 0.2, 5)
    assert got.skipped is None and got.synthetic == 50
    assert got.table.columns == ["id", "y", "replica", "a", "b"]
    out = got.table.collect()
    assert len(out) == 480 and sum(r.y for r in out) == 80
    assert sorted((r.id, r.y, r.a, r.b) for r in out if r.replica == 0) == sorted(r[:4] for r in rows)
    base = {r[0]: np.array(r[2:4]) for r in rows if r[1] == 1}
    near = brute([base[i] for i in range(30)], 5)
    for r in (r for r in out if r.replica > 0):
        x, a = np.array([r.a, r.b]), base[r.id]
        ends = [base[j] for _, j, _ in near[min(i for i in base if (base[i] == a).all())][1]] + [a]
        # on the line from its start to one of the neighbours
        assert any(np.linalg.norm(x - a) + np.linalg.norm(x - e) - np.linalg.norm(a - e) < 1e-9 for e in ends)
    counts = {}
    for r in out:
        if r.replica:
            counts[r.id] = counts.get(r.id, 0) + 1
    assert sorted(counts.values()) == [1] * 10 + [2] * 20
    again = N.smote(table(spark, rows[::-1]).repartition(7), "id", "y", ["a", "b"], 0.2, 5).table.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_smote_gates(spark):
    rng = np.random.default_rng(2)
    few = N.smote(table(spark, rows_of(4, 400, rng)), "id", "y", ["a", "b"])
    full = N.smote(table(spark, rows_of(80, 400, rng)), "id", "y", ["a", "b"])
    rows = rows_of(30, 400, rng)
    gap = N.smote(table(spark, rows[:-1] + [(5000, 0, None, 1.0, "x")]), "id", "y", ["a", "b"])
    nan = N.smote(table(spark, rows[:-1] + [(5000, 0, float("nan"), 1.0, "x")]), "id", "y", ["a", "b"])
    assert [(g.skipped, g.synthetic) for g in (few, full, gap, nan)] == [
        ("too few positives", 0), ("balanced already", 0), ("missing values", 0), ("missing values", 0)]
    assert few.table.count() == 404 and gap.table.where(F.col("replica") == 0).count() == 430
    empty = N.smote(table(spark, rows).where("false"), "id", "y", ["a", "b"])
    assert empty.skipped == "too few positives" and empty.table.count() == 0


def test_smote_when_copies_hold_most_positives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1, 1.0, 1.0, "x") for i in range(20)] + [(20 + i, 1, float(i), 0.0, "x") for i in range(5)] \
        + [(1000 + i, 0, float(rng.normal()), 0.0, "x") for i in range(500)]
    got = N.smote(table(spark, rows), "id", "y", ["a", "b"])
    made = got.table.where("replica > 0").collect()
    assert got.synthetic == 75 == len(made)
    assert all((r.a, r.b) == (1.0, 1.0) for r in made if r.id < 20)


def test_visits_are_handed_on_in_bounded_frames(monkeypatch):
    """One batch of rows that visit all blocks is not held whole."""
    import pandas as pd
    monkeypatch.setattr(N, "VISITS_AT_ONCE", 100)
    pivots = np.arange(30.0)[:, None]
    layout = N.Layout(pivots, [np.array([0.5])] * 30, {(c, 0): 2 for c in range(30)})
    f = pd.DataFrame({"rep": range(200), "vec": [[float(i % 30)] for i in range(200)], "cell": [i % 30 for i in range(200)],
                      "ring": 0, "part": 0, "nd": [[]] * 200})
    frames = list(N.visits_of(f, layout, 5))
    assert max(map(len, frames)) < 100 + 60
    got = pd.concat(frames)
    assert len(got) == 200 * 59 and len(got.drop_duplicates(["rep", "cell", "ring", "part"])) == 200 * 59
    assert not len(got[(got["cell"] == got["rep"] % 30) & (got["part"] == 0)])


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e6])
def test_nearest_by_product_equals_all_squares(scale):
    """Ties, copies, fewer columns than k, and columns far apart in size."""
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.integers(0, 2, (300, 6)).astype(float), rng.normal(size=(200, 6)), np.full((1, 6), 1e6)]) * scale
    x = np.concatenate([y[:700:3], rng.normal(size=(1500, 6)) * scale])
    reps, mults = rng.permutation(len(y)) * 3, rng.integers(1, 9, len(y))
    assert tuple(N.nearest(x, y, reps, mults, 5)) == tuple(N.nearest_lists(N.squares(x, y), reps, mults, 5))
    own = tuple(N.nearest(y, y, reps, mults, 5, own=True))
    # the plain way takes the row's own column before it orders them
    assert own == tuple(N.nearest_lists(N.squares(y, y), reps, mults, 5, own=np.arange(len(y))))
    assert tuple(N.nearest(x, y[:3], reps[:3], mults[:3], 5)) == tuple(N.nearest_lists(N.squares(x, y[:3]), reps[:3], mults[:3], 5))
    big = np.array([[1e200], [-1e200], [0.0], [1.0]])
    assert tuple(N.nearest(big, big, np.arange(4), np.ones(4, int), 2, own=True)) == tuple(
        N.nearest_lists(N.squares(big, big), np.arange(4), np.ones(4, int), 2, own=np.arange(4)))


def test_cells_are_boxes_and_bounds_hold():
    """Every vector lies in the box of its cell, and no box is farther than its nearest vector."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(2000, 5)), rng.integers(0, 2, (500, 5)).astype(float)])
    tree = N.Tree(x[::3], 20)
    cell = tree.leaf(x)
    assert tree.leaves == 20 and set(cell) == set(range(20)) and np.bincount(cell).max() < 4 * len(x) / 20
    low, high = (np.array([f(x[cell == c], axis=0) for c in range(20)]) for f in (np.min, np.max))
    square = N.box_squares(x[:50], low, high)
    assert (square[np.arange(50), cell[:50]] == 0).all()
    least = np.array([[((x[cell == c] - v) ** 2).sum(axis=1).min() for c in range(20)] for v in x[:50]])
    assert (square <= least + 1e-12).all()
    assert N.Tree(np.ones((9, 2)), 4).leaves == 1


def test_vectors_are_sent_once_per_side(spark, monkeypatch):
    """Vectors in no clusters: what is written for visits stays below a row per block, and the
    tables of the search are deleted."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    monkeypatch.setattr(N, "VISITORS", 500)
    sent, real = {}, N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: (lambda t: (sent.update({name: t.count()}), t)[1])(real(df, name)))
    vectors = np.random.default_rng(9).normal(size=(3000, 6))
    got = N.nearest_neighbours(N.distinct_vectors(frame(spark, vectors), "key", "vec"), 5).collect()
    want = brute(vectors, 5)
    assert all([x["rep"] for x in r["near"]] == [b for _, b, _ in want[r["rep"]][1]] for r in got) and len(got) == 3000
    assert sent["knn-visits"] <= 3000 * 18                      # 75 blocks in 19 sides
