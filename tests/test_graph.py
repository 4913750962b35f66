"""The declared source graph (J4) on the clinical schema, and typed empty sources."""

import gzip

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from riskframe.operators import features as M
from riskframe.plans.analytic import analytic_dataset
from riskframe.plans.graph import (Attributes, Flag, Graph, Source, clinical_graph, compile_graph, driver_graph,
                                   open_sources, wide_from_graph)
from riskframe.sources.readers import optional_source
from riskframe.spec import clinical_spec

LABS = {50862: "albumin", 51222: "hemoglobin", 50912: "creatinine", 51301: "white_blood_cells", 51265: "platelet_count"}
SCORES = {224054: "sensory_perception", 224055: "moisture", 224056: "activity", 224057: "mobility", 224058: "nutrition",
          224059: "friction_shear"}


@pytest.fixture(scope="module")
def clinic(tmp_path_factory):
    """Small generated tables of the clinical schema, one of them gzipped."""
    root, rng, n = tmp_path_factory.mktemp("clinic"), np.random.default_rng(1), 400
    (root / "hosp").mkdir()
    (root / "icu").mkdir()
    start = pd.Timestamp("2150-01-01") + pd.to_timedelta(rng.integers(0, 10 ** 7, n), "s")
    t = {
        "hosp/patients": pd.DataFrame({"subject_id": range(150), "gender": rng.choice(["F", "M"], 150),
                                       "anchor_age": rng.integers(10, 95, 150), "dod": ""}),
        "hosp/admissions": pd.DataFrame({
            "subject_id": rng.integers(0, 160, n), "hadm_id": range(1000, 1000 + n), "admittime": start,
            "dischtime": start + pd.to_timedelta(rng.integers(3600, 2 * 10 ** 6, n), "s"),
            "race": rng.choice(["A", "B", "C"], n), "insurance": rng.choice(["x", "y", None], n),
            "hospital_expire_flag": rng.integers(0, 2, n)}),
        "hosp/diagnoses_icd": pd.DataFrame({
            "subject_id": 1, "hadm_id": rng.integers(1000, 1500, 900),
            "icd_code": rng.choice(["70703", "7070", "0707", "L89152", "L8", "70xx", "4019"], 900),
            "icd_version": rng.choice([9, 10], 900)}),
        "hosp/labevents": pd.DataFrame({
            "subject_id": 1, "hadm_id": rng.choice([None, *range(1000, 1300)], 3000),
            "itemid": rng.choice([*LABS, 1], 3000), "valuenum": np.where(rng.random(3000) < .1, np.nan, rng.random(3000).round(3) * 20)}),
        "icu/chartevents": pd.DataFrame({
            "subject_id": 1, "hadm_id": rng.integers(1000, 1200, 1500), "itemid": rng.choice([*SCORES, 2], 1500),
            "valuenum": rng.integers(1, 5, 1500)}),
        "icu/icustays": pd.DataFrame({"hadm_id": rng.integers(1000, 1500, 120), "stay_id": 1}),
    }
    for name, df in t.items():
        if name == "hosp/labevents":
            with gzip.open(root / f"{name}.csv.gz", "wt") as f:
                df.to_csv(f, index=False)
        else:
            df.to_csv(root / f"{name}.csv", index=False)
    return str(root), t


def expected(t, charts=True, icu=True):
    adm = t["hosp/admissions"]
    out = adm.merge(t["hosp/patients"][["subject_id", "gender", "anchor_age"]], on="subject_id", how="left")
    out = out[out.anchor_age >= 18].rename(columns={"anchor_age": "age"})
    out["los_days"] = (out.dischtime - out.admittime).dt.total_seconds() / 86400
    d = t["hosp/diagnoses_icd"]
    hit = (d.icd_version.eq(9) & d.icd_code.str.match("707[0-9]")) | (d.icd_version.eq(10) & d.icd_code.str.startswith("L89"))
    out["pi_flag"] = out.hadm_id.isin(d[hit].hadm_id).astype(int)
    out["icu_flag"] = out.hadm_id.isin(t["icu/icustays"].hadm_id).astype(int) if icu else 0
    for name, items, prefix, there in (("hosp/labevents", LABS, "", True), ("icu/chartevents", SCORES, "braden_", charts)):
        ev = t[name].dropna(subset=["hadm_id", "valuenum"])
        for item, col in items.items():
            least = ev[ev.itemid == item].groupby(ev.hadm_id.astype(int)).valuenum.min()
            out[prefix + col] = out.hadm_id.map(least).astype(float) if there else np.nan
    return out


def same(got, want):
    got = got.toPandas().sort_values("hadm_id").reset_index(drop=True)
    want = want.sort_values("hadm_id").reset_index(drop=True)[list(got.columns)]
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype == object or b.dtype == object:
            assert a.where(a.notna(), None).tolist() == b.where(b.notna(), None).tolist(), c
        else:
            assert np.allclose(a.astype(float), b.astype(float), equal_nan=True), c
    return got


def test_clinical_graph_equals_pandas(spark, clinic):
    root, t = clinic
    got = same(wide_from_graph(spark, clinical_graph(), root), expected(t))
    assert 250 < len(got) < 400 and got.pi_flag.sum() > 20 and got.columns[-1] == "braden_friction_shear"


def test_absent_optional_sources_are_empty(spark, clinic, tmp_path):
    root, t = clinic
    (tmp_path / "hosp").symlink_to(f"{root}/hosp")
    got = same(wide_from_graph(spark, clinical_graph(), str(tmp_path)), expected(t, charts=False, icu=False))
    assert got.icu_flag.sum() == 0 and got.braden_moisture.isna().all()
    with pytest.raises(FileNotFoundError):
        open_sources(spark, clinical_graph(), str(tmp_path / "icu"))


def test_clinical_wide_table_feeds_the_preparation(spark, clinic):
    prep = M.prepare_data(wide_from_graph(spark, clinical_graph(), clinic[0]), clinical_spec())
    assert prep.table.count() > 250 and "braden_total" in prep.feature_names + prep.imputable + prep.passthru
    assert {r[0] for r in prep.table.select("split").distinct().collect()} == {"train", "test"}


def test_driver_graph_equals_the_flagship(spark):
    a, b = analytic_dataset(spark, SF_SMALL), wide_from_graph(spark, driver_graph(), SF_SMALL)
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in plan          # the cohort reaches the scan
    assert plan.count("lineitem.parquet") <= 2 and plan.count("events.parquet") <= 1


def test_graph_refuses_unknown_and_double_names(spark):
    src = {"a": Source("a.csv", (("k", "int"), ("x", "int")))}
    for parts, what in (((Flag("b", "k", "f"),), "unknown source"), ((Attributes("a", "k", (("y", "z"),)),), "no column"),
                        ((Flag("a", "k", "x"),), "named twice")):
        with pytest.raises(ValueError, match=what):
            compile_graph(Graph(src, "a", ("k", "x"), parts=parts), {})


def test_typed_empty_source_joins_without_a_branch(spark, tmp_path):
    schema = "k long, v double"
    base = spark.createDataFrame([(1,), (2,)], "k long")
    for fmt in ("parquet", "csv"):
        gone = optional_source(spark, str(tmp_path / f"gone.{fmt}"), fmt, schema=schema)
        assert gone.schema.simpleString() == "struct<k:bigint,v:double>"
        out = base.join(gone.groupBy("k").agg(F.min("v").alias("v")), "k", "left")
        assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, None), (2, None)]
    path = str(tmp_path / "there.parquet")
    spark.createDataFrame([(1, "x")], "k int, other string").write.parquet(path)
    assert [tuple(r) for r in optional_source(spark, path, schema=schema).collect()] == [(1, None)]
