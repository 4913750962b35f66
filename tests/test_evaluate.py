"""Evaluation: metrics against MLlib / brute force on inline frames."""

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.operators import evaluate as E


def _scores(spark, n=400, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1)
    if ties:
        p = np.round(p, 2)
    return spark.createDataFrame([(int(i), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))],
                                 "id long, score double, y int"), p, y


def _auc_bruteforce(p, y):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_auroc_matches_bruteforce_and_mllib_with_ties(spark):
    df, p, y = _scores(spark)
    ours = E.auroc(df, "score", "y").first().auroc
    assert abs(ours - _auc_bruteforce(p, y)) < 1e-12
    raw = df.select(array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("raw"),
                    F.col("y").cast("double").alias("y"))
    ml = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(raw)
    assert abs(ours - ml) < 1e-9


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    vals = rng.permutation(500).astype(float)
    w = rng.integers(0, 5, 500)
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "k double, w long")
    got = {r.k: r.cum_w for r in E.prefix_sums(df, "k", ["w"], buckets=7).collect()}
    order = np.argsort(vals)
    cum = np.cumsum(w[order])
    assert all(got[vals[i]] == c for i, c in zip(order, cum))
    desc = {r.k: r.cum_w for r in E.prefix_sums(df, "k", ["w"], descending=True, inclusive=False,
                                                buckets=5).collect()}
    order = np.argsort(-vals)
    excl = np.concatenate([[0], np.cumsum(w[order])[:-1]])
    assert all(desc[vals[i]] == c for i, c in zip(order, excl))


def test_threshold_without_feasible_point_falls_back(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 0), (0.05, 1), (0.04, 1)], "score double, y int")
    r = E.optimal_threshold(df, "score", "y", min_sensitivity=0.95).first()
    # sensitivity 1.0 only for t <= 0.04 -> feasible, first such threshold wins
    assert r.method == "f1" and r.threshold == 0.01
    none = spark.createDataFrame([(0.9, 0), (0.8, 0)], "score double, y int")
    assert E.optimal_threshold(none, "score", "y").first().method == "default"


def test_confusion_matrix_dense_with_empty_cell(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.2, 0)], "score double, y int")
    got = {(r.actual, r.predicted): r["count"] for r in E.confusion_matrix(df, "score", "y").collect()}
    assert got == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_calibration_edge_value_goes_to_lower_bin(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1000001, 1), (0.95, 1)], "score double, y int")
    got = {r.bin: r["count"] for r in E.calibration(df, "score", "y").collect()}
    assert got == {0: 1, 1: 1, 9: 1}


def test_evaluate_row(spark):
    df, p, y = _scores(spark, ties=False)
    m = E.evaluate(df, "score", "y", 0.5).first()
    pred = p >= 0.5
    tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
    fn, tn = int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum())
    assert abs(m.sensitivity - tp / (tp + fn)) < 1e-12
    assert abs(m.specificity - tn / (tn + fp)) < 1e-12
    assert abs(m.brier_score - float(np.mean((p - y) ** 2))) < 1e-12
