"""Cleaning chains: one pass of derived moments equals step by step."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from riskframe.operators import cleaning as C
from riskframe.operators import quality as Q

RANGES = [("x", -1.0, 4.0), ("k", 2.0, 7.0)]
SCHEMA = "id int, x double, k long, same double, none double, g string, h string"


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of the rows are one repeated row
        rows.append((0, 1.5, 3, 0.1, None, "a", None) if i % 3 == 0 else
                    (i, None if rng.random() < .2 else rng.gauss(1, 3), None if rng.random() < .1 else rng.randrange(10),
                     None if rng.random() < .3 else 0.1, None,
                     rng.choice(["a", "b", None]), rng.choice(["u", "v"])))
    return rows


def _by_pandas(rows, steps):
    d = pd.DataFrame(rows, columns=["id", "x", "k", "same", "none", "g", "h"])
    num, cat = ["x", "k", "same", "none"], ["g", "h"]
    d[num] = d[num].astype(float)
    sizes = [len(d)]
    for s in steps:
        if s == "dropna":
            d = d.dropna(how="any")
        elif s == "dedup":
            d = d.drop_duplicates()
        elif s == "clip":
            for c, lo, hi in RANGES:
                d[c] = d[c].clip(lo, hi)
        elif s in ("impute_median", "impute_mean"):
            for c in num:
                # the mean of equal values is that value, however their sum rounds
                mean = np.clip(d[c].mean(), d[c].min(), d[c].max())
                d[c] = d[c].fillna(d[c].median() if s == "impute_median" else mean)
        elif s == "impute_mode":
            for c in [c for c in cat if c in d]:
                top = d[c].dropna().value_counts()
                if len(top):
                    d[c] = d[c].fillna(min(top[top == top.max()].index))
        elif s == "minmax":
            for c in num:
                lo, hi = d[c].min(), d[c].max()
                d[c] = (d[c] - lo) / (hi - lo) if hi > lo else d[c]
        elif s == "zscore":
            for c in num:
                mu, sd = d[c].mean(), d[c].std()
                d[c] = (d[c] - mu) / sd if d[c].nunique() > 1 else d[c]
        elif s == "one_hot":
            for c in [c for c in cat if c in d]:
                for v in sorted(d[c].dropna().unique()):
                    d[f"{c}_{v}"] = (d[c] == v).astype(int)
                d = d.drop(columns=c)
        sizes.append(len(d))
    return d, sizes


def _key(row):
    return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else
                 f"{round(v, 7) + 0.0:.7f}" if isinstance(v, float) else str(int(v)) if isinstance(v, (np.integer, int)) else v
                 for v in row)


CHAINS = [
    ["clip", "impute_median", "zscore", "impute_mode", "one_hot", "dedup"],
    ["impute_mean", "minmax", "zscore"],
    ["minmax", "impute_median", "clip", "zscore", "minmax"],
    ["dedup", "impute_mean", "zscore", "dedup", "minmax"],
    ["zscore", "impute_mean", "clip", "minmax", "one_hot"],
    ["impute_mode", "dedup", "impute_median", "one_hot", "dropna", "zscore"],
]


@pytest.mark.parametrize("steps", CHAINS, ids=lambda s: "-".join(s))
@pytest.mark.parametrize("write", [True, False])
def test_chain_equals_step_by_step(spark, steps, write):
    if "dropna" in steps and not write:
        pytest.skip("one of both is enough")
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out, log = Q.clean(df, steps, exclude=["id"], clip_ranges_=RANGES, materialize=write)
    want, sizes = _by_pandas(rows, steps)
    cols = sorted(want.columns)
    assert sorted(out.columns) == cols
    assert sorted(_key(r) for r in out.select(*cols).collect()) == sorted(_key(r) for r in want[cols].itertuples(index=False))
    assert [r.rows for r in log.orderBy("seq").collect()] == sizes


def test_moments_follow_the_rules(spark):
    rng = random.Random(5)
    values = [None if rng.random() < .3 else rng.gauss(100, .01) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    known = C.measure(df, ["x"])["x"]
    x = np.array([np.nan if v is None else v for v in values])
    known, x = known.filled(100.5), np.where(np.isnan(x), 100.5, x)
    known, x = known.scaled(3.0, 0.5), (x - 3.0) / 0.5
    assert (known.n, known.nulls, known.lo, known.hi) == (500, 0, x.min(), x.max())
    assert known.mean == pytest.approx(x.mean(), rel=1e-12)
    assert known.sd == pytest.approx(x.std(ddof=1), rel=1e-9)
    cut = known.clipped(194.0, 194.05)
    assert (cut.lo, cut.hi) == (np.clip(x, 194.0, 194.05).min(), np.clip(x, 194.0, 194.05).max()) and cut.mean is None


def test_a_chain_writes_where_rows_change(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), SCHEMA)
    wrote, passes = [], []
    real, measured = C.write_once, C.measure
    monkeypatch.setattr(C, "write_once", lambda d, name: (wrote.append(name), real(d, name))[1])
    monkeypatch.setattr(C, "measure", lambda d, cols: (passes.append(sorted(cols)), measured(d, cols))[1])
    Q.clean(df, list(Q.STEPS), exclude=["id"], clip_ranges_=RANGES)
    # every column is empty of NULLs after dropna: no fill needs statistics, the scalings share one pass
    assert [w for w in wrote if w != "clean-levels"] == ["clean-input", "clean-dropna", "clean-dedup"]
    assert passes == [["k", "none", "same", "x"]]
    wrote.clear(), passes.clear()
    Q.clean(df, ["impute_mean", "zscore", "minmax", "impute_mode", "one_hot"], exclude=["id"])
    assert wrote == ["clean-input", "clean-levels", "clean-result"] and len(passes) == 1


@pytest.mark.parametrize("steps", [[], ["dropna"], list(Q.STEPS), ["impute_mean", "zscore"]], ids=str)
def test_empty_table_and_no_steps(spark, steps):
    out, log = Q.clean(spark.createDataFrame([], SCHEMA), steps, exclude=["id"], clip_ranges_=RANGES)
    assert out.count() == 0 and [r.rows for r in log.collect()] == [0] * (len(steps) + 1)
    one, log = Q.clean(spark.createDataFrame(_rows(3), SCHEMA), steps, exclude=["id"], clip_ranges_=RANGES)
    assert log.orderBy("seq").first().rows == 3


def test_clashing_names_and_types(spark):
    df = spark.createDataFrame([(1, 2.5, "p q"), (1, 2.5, "p q"), (None, 1.0, None)],
                               "__n int, `a b` float, rows string")
    out, log = Q.clean(df, ["impute_mean", "zscore", "impute_mode", "dedup"])
    assert out.count() == 2 and dict(out.dtypes) == {"__n": "double", "a b": "double", "rows": "string"}
    assert [r.rows for r in log.orderBy("seq").collect()] == [3, 3, 3, 3, 2]


def test_levels_are_bounded_and_unknown_steps_named(spark):
    df = spark.range(1001).selectExpr("cast(id as string) AS g")
    with pytest.raises(ValueError, match="g: more than 1000 levels"):
        Q.clean(df, ["one_hot"])
    with pytest.raises(ValueError, match="unknown cleaning step 'polish'"):
        Q.clean(df, ["polish"])
