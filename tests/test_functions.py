"""Inline-frame checks: the original tool's own checks plus the NULL, tie and
boundary cases listed in the survey."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import rules as R
from riskframe.functions import scalar as S
from riskframe.operators import profile as P
from riskframe.operators import quality as Q
from riskframe.operators import shape as SH
from riskframe.sources import readers
from riskframe.spec import tpch_binding


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_clip_albumin(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 3.5), (3, 100.0), (4, None)], "id int, albumin double")
    out = Q.clip_ranges(df, [("albumin", 0.5, 7.0)]).orderBy("id")
    assert [r.albumin for r in out.collect()] == [0.5, 3.5, 7.0, None]   # NULL stays NULL


def test_imputations(spark):
    df = spark.createDataFrame([(1.0, 10.0, "a"), (2.0, None, "a"), (None, 30.0, None), (4.0, 40.0, "b")],
                               "x double, y double, g string")
    med = Q.impute_median(df, ["x", "y"]).collect()
    assert [r.x for r in med] == [1.0, 2.0, 2.0, 4.0]
    assert [r.y for r in med] == [10.0, 30.0, 30.0, 40.0]
    mean = Q.impute_mean(df, ["x", "y"]).collect()
    assert math.isclose(mean[2].x, 7 / 3) and math.isclose(mean[1].y, 80 / 3)
    mode = Q.impute_mode(df, ["g"]).collect()
    assert [r.g for r in mode] == ["a", "a", "a", "b"]


def test_mode_tie_takes_smallest_and_all_null_untouched(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "g string")
    assert sorted(r.g for r in Q.impute_mode(df, ["g"]).collect()) == ["a", "a", "a", "b", "b"]
    nulls = spark.createDataFrame([(None,), (None,)], "g string")
    assert [r.g for r in Q.impute_mode(nulls, ["g"]).collect()] == [None, None]


def test_one_hot_levels(spark):
    df = spark.createDataFrame([("M", 50), ("F", 60), ("M", 70), (None, 80)], "gender string, age int")
    out = Q.one_hot(df, ["gender"])
    assert set(out.columns) == {"age", "gender_F", "gender_M"}
    assert rows(out.orderBy("age"), "gender_F", "gender_M") == [(0, 1), (1, 0), (0, 1), (0, 0)]


@pytest.mark.parametrize("p,tier", [(0.05, "Low"), (0.25, "Moderate"), (0.75, "High"),
                                    (0.15, "Moderate"), (0.40, "High"), (0.1499, "Low")])
def test_risk_tier(spark, p, tier):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(R.risk_tier("p").alias("t")).first().t == tier


def test_threshold_flag_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (80.0,), (70.0,)], "age double")
    assert [r.f for r in df.select(S.flag("age", ">=", 75).alias("f")).collect()] == [0, 1, 0]


def test_row_sum_all_null(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert [r.t for r in df.select(S.row_sum(["a", "b"]).alias("t")).collect()] == [None, 1.0, 3.0]


def test_validate_ranges_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (7.0,), (7.01,), (None,)], "x double")
    out = Q.validate_ranges(df, [("x", 0.5, 7.0)])
    assert [r.x for r in out.collect()] == [0.5, 7.0, None, None]


def test_consolidate_null_to_other(spark):
    data = [("a",)] * 5 + [("b",)] * 4 + [("c",)] * 3 + [("OTHER",)] * 2 + [(None,)]
    df = spark.createDataFrame(data, "g string")
    out = Q.consolidate_categories(df, "g", 3)
    assert sorted((r.g for r in out.collect()), key=str) == sorted(
        ["a"] * 5 + ["b"] * 4 + ["c"] * 3 + ["Other"] * 3, key=str)


def test_minmax_and_zscore_constant_untouched(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    mm = Q.minmax_scale(df, ["x", "k"]).collect()
    assert [r.x for r in mm] == [0.0, 1.0] and [r.k for r in mm] == [5.0, 5.0]
    z = Q.zscore(df, ["x", "k"]).collect()
    assert [round(r.x, 6) for r in z] == [-0.707107, 0.707107] and [r.k for r in z] == [5.0, 5.0]


def test_iqr_zero_iqr_flags_every_deviation(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (None,)], "x double")
    out = P.iqr_outliers(df, ["x"]).first()
    assert out.lower_bound == 1.0 and out.upper_bound == 1.0 and out.outlier_count == 1


def test_value_counts_and_prevalence_drop_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 0)], "g string, y int")
    assert rows(P.value_counts(df, "g"), "g", "count") == [("a", 2), ("b", 1)]
    assert rows(P.prevalence_by_group(df, "g", "y"), "g", "rate", "count") == [("a", 50.0, 2), ("b", 0.0, 1)]


def test_pivot_code_without_rows_is_null_column(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (1, "A", 3.0), (2, "N", None)], "k long, c string, v double")
    out = SH.eav_pivot_min(df, "k", "c", "v", {"A": "lab_a", "N": "lab_n", "R": "lab_r"})
    assert rows(out, "k", "lab_a", "lab_n", "lab_r") == [(1, 3.0, None, None)]


def test_rules_and_recommendations(spark):
    spec = tpch_binding()
    df = spark.createDataFrame([(1500.0, 1000.0, 10.0, 3.0, 0), (None, None, None, 1.0, 1)],
                               "lab_a double, lab_n double, sub_total double, los_days double, err_flag int")
    df = df.withColumns({"sub_view": F.lit(None).cast("double"), "sub_click": F.lit(None).cast("double")})
    w = [r.w for r in df.select(R.rule_messages(spec.warnings).alias("w")).collect()]
    assert len(w[0]) == 3 and w[1] == []
    recs = [r.r for r in df.select(R.recommendations(spec.recommendations,
                                                     spec.default_recommendation).alias("r")).collect()]
    assert recs[0] == ["lab_a < 20000"]
    assert recs[1] == ["err_flag == 1"]


def test_absent_optional_source(spark, tmp_path):
    assert readers.optional_source(spark, str(tmp_path / "missing.parquet")) is None
    with pytest.raises(FileNotFoundError):
        readers.scan_csv(spark, str(tmp_path / "nothing.csv"))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in readers.nan_to_null(df).collect()] == [None, 1.0]


def test_duration_days_negative_and_null(spark):
    df = spark.createDataFrame([("2020-01-02 00:00:00", "2020-01-01 12:00:00"), ("2020-01-01 00:00:00", None)],
                               "a string, b string").select(
        F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("b").alias("b"))
    assert [r.d for r in df.select(S.duration_days("a", "b").alias("d")).collect()] == [-0.5, None]


def test_tolerant_scan_skips_corrupt_file(spark, tmp_path):
    good = str(tmp_path / "t")
    spark.range(10).write.parquet(good)
    with open(f"{good}/part-zzzz-corrupt.parquet", "wb") as fh:
        fh.write(b"not a parquet file")
    some = readers.tolerant(spark, good)
    assert some.count() == 10
    assert any("corrupt" in r.file for r in readers.skipped_files(some).collect())
    assert spark.conf.get("spark.sql.files.ignoreCorruptFiles") == "false"


def test_json_records_keep_every_line_and_arrays(spark, tmp_path):
    spark.range(1500).selectExpr("id", "id * 0.5 AS x").coalesce(1).write.json(str(tmp_path / "lines"))
    assert readers.read_json_records(spark, str(tmp_path / "lines")).count() == 1500
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": NaN}]')
    assert [r.a for r in readers.read_json_records(spark, str(tmp_path / "array.json")).collect()] == [1.0, None]
    (tmp_path / "one.json").write_text('{\n "a": 1\n}')
    assert readers.read_json_records(spark, str(tmp_path / "one.json")).count() == 1


def test_sources_turn_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(str(tmp_path / "t.parquet"))
    assert readers.read_table(spark, str(tmp_path), "t").agg(F.max("x")).first()[0] == 1.0
    assert readers.optional_source(spark, str(tmp_path / "t.parquet")).agg(F.max("x")).first()[0] == 1.0


def test_integer_columns_are_imputed_as_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "x int")
    assert sorted(r.x for r in Q.impute_mean(df, ["x"]).collect())[2] == pytest.approx(7 / 3)
    two = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert sorted(r.x for r in Q.impute_median(two, ["x"]).collect()) == [1.0, 1.5, 2.0]


def test_checkpoint_folder_is_required_and_kept():
    from types import SimpleNamespace as N

    from riskframe.session import ensure_checkpoint_dir
    made = []
    ctx = lambda have: N(getCheckpointDir=lambda: have, setCheckpointDir=made.append)
    conf = lambda v: N(get=lambda k, d=None: v)
    assert ensure_checkpoint_dir(N(sparkContext=ctx("/shared/a"), conf=conf("/shared/b"))) == "/shared/a" and not made
    assert ensure_checkpoint_dir(N(sparkContext=ctx(None), conf=conf("/shared/b"))) == "/shared/b" and made == ["/shared/b"]
    with pytest.raises(RuntimeError, match="shared checkpoint folder"):
        ensure_checkpoint_dir(N(sparkContext=ctx(None), conf=conf(None)))


def test_column_sets_and_keep_if_present(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 0)], "id long, x double, g string, y int")
    assert Q.numeric_columns(df) == ["id", "x", "y"]
    assert Q.numeric_columns(df, exclude=["id", "y"]) == ["x"]
    assert Q.categorical_columns(df) == ["g"]
    assert Q.present(df, ["x", "absent", "g"]) == ["x", "g"]


def test_typed_csv_keeps_leading_zeros_and_infer_does_not(spark, tmp_path):
    path = str(tmp_path / "dx.csv")
    with open(path, "w") as fh:
        fh.write("hadm_id,icd_code,icd_version\n1,0070,9\n2,L891,10\n")
    typed = readers.scan_csv(spark, path, schema="hadm_id long, icd_code string, icd_version int")
    assert sorted(r.icd_code for r in typed.collect()) == ["0070", "L891"]
    inferred = readers.read_any(spark, path)
    assert dict(inferred.dtypes)["icd_version"] == "int"


def test_temporary_tables_go_but_kept_ones_stay(spark):
    from pyspark.errors import AnalysisException

    from riskframe.session import materialize, temporary_tables
    with temporary_tables(spark) as keep:
        gone = materialize(spark.range(5), "scope-a")
        with temporary_tables(spark) as inner:
            inside = inner(materialize(gone.where("id > 1"), "scope-b"))
            lost = materialize(spark.range(3), "scope-c")
        kept = keep(materialize(inside.where("id > 2"), "scope-d"))
        assert inside.count() == 3
    after = materialize(spark.range(2), "scope-e")
    assert kept.count() == 2 and after.count() == 2
    for table in (gone, inside, lost):
        try:
            spark.read.parquet(table.scratch_table)
            raise AssertionError("still there")
        except AnalysisException:
            pass
