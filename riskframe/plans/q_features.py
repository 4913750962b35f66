"""Registered queries: feature preparation (M1-M8, M10, L2 folds, K5)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import features as M
from riskframe.operators import neighbors as N
from riskframe.plans.analytic import wide_table
from riskframe.plans.oracle_base import RANGES, r, with_wide
from riskframe.plans.registry import query, rounded
from riskframe.session import scratch_path
from riskframe.spec import tpch_binding

SPEC = tpch_binding()
SUBS = ["sub_click", "sub_view", "sub_purchase", "sub_signup"]
NUM_CAND = ["c_acctbal", "los_days", "lab_a", "lab_n", "lab_r"] + SUBS + ["sub_total"]
# routing observed on the driver tables (checked by the feature_routing query)
IMPUTABLE = ["c_acctbal", "los_days", "lab_a", "lab_n", "lab_r"]
PASSTHRU = SUBS + ["sub_total"]
LEVELS = {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "None"],
          "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
          "o_orderstatus": ["F", "O", "P"]}
FLAGS = {"acctbal_over_7500": "c_acctbal >= 7500", "los_over_7": "los_days > 7",
         "los_over_14": "los_days > 14", "lab_a_low": "lab_a < 20000", "lab_n_low": "lab_n < 10000"}
BINARY = (["err_flag"] + list(FLAGS) + [f"{c}_missing" for c in ["lab_a", "lab_n", "lab_r"]]
          + [f"{c}_missing" for c in PASSTHRU])


# ------------------------------------------------------------------ SQL building blocks
def _engineered_ctes() -> list[str]:
    val = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, lo, hi in RANGES)
    v = (f"v AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, segment, flag, "
         f"err_flag, {val} FROM wide)")
    top = ("top AS (SELECT o_orderpriority AS p FROM v WHERE o_orderpriority IS NOT NULL "
           "GROUP BY 1 ORDER BY count(*) DESC, p ASC LIMIT 5)")
    total = ("CASE WHEN coalesce(" + ", ".join(SUBS) + ") IS NOT NULL THEN "
             + " + ".join(f"coalesce({c}, 0)" for c in SUBS) + " END")
    miss = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing"
                     for c in ["lab_a", "lab_n", "lab_r"] + SUBS)
    flags = ", ".join(f"coalesce(CAST({e} AS INTEGER), 0) AS {n}" for n, e in FLAGS.items())
    e = (f"e AS (SELECT * EXCLUDE (o_orderpriority), CASE WHEN o_orderpriority IN (SELECT p FROM top) "
         f"THEN o_orderpriority ELSE 'Other' END AS o_orderpriority, {total} AS sub_total, "
         f"{miss}, {flags} FROM v)")
    e2 = "e2 AS (SELECT *, CASE WHEN sub_total IS NULL THEN 1 ELSE 0 END AS sub_total_missing FROM e)"
    s = ("s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY flag ORDER BY "
         "md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= round(0.2 * count(*) OVER "
         "(PARTITION BY flag)) THEN 'test' ELSE 'train' END AS split FROM e2)")
    med = ("med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMPUTABLE)
           + " FROM s WHERE split = 'train')")
    st = ("st AS (SELECT " + ", ".join(
        f"avg(coalesce({c}, m_{c})) AS mu_{c}, CASE WHEN stddev_pop(coalesce({c}, m_{c})) > 0 "
        f"THEN stddev_pop(coalesce({c}, m_{c})) ELSE 1.0 END AS sd_{c}" for c in IMPUTABLE)
        + " FROM s, med WHERE split = 'train')")
    return [v, top, e, e2, s, med, st]


def _prepared_select(with_split=True) -> str:
    num = [f"{r(f'(coalesce({c}, m_{c}) - mu_{c}) / sd_{c}')} AS {c}" for c in IMPUTABLE]
    cat = [f"CASE WHEN coalesce({c}, 'None') = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"{c}_{v}\""
           for c, lv in LEVELS.items() for v in lv]
    pas = [f"{r(c)} AS {c}" for c in PASSTHRU]
    binr = [f"CAST({c} AS DOUBLE) AS {c}" for c in BINARY]
    w = ("CASE WHEN flag = 1 THEN (SELECT CAST(count(*) FILTER (WHERE flag = 0) AS DOUBLE) / "
         "count(*) FILTER (WHERE flag = 1) FROM s WHERE split = 'train') ELSE 1.0 END")
    if not with_split:
        return "SELECT o_orderkey, flag, " + ", ".join(num + cat + pas + binr) + " FROM s, med, st"
    return ("SELECT o_orderkey, flag, split, " + ", ".join(num + cat + pas + binr)
            + f", {r(w)} AS weight FROM s, med, st")


# ------------------------------------------------------------------ Spark side
def _engineered(spark, base):
    w, num, cat, binary = M.engineer(wide_table(spark, base), SPEC)
    return w, num, cat, binary


@lru_cache(maxsize=4)
def _prepared_cached(spark, base):
    return M.prepare_data(wide_table(spark, base), SPEC)


def prepared(spark, base) -> M.Prepared:
    """Prepared table for ``base`` (checkpointed; reused within a session)."""
    return _prepared_cached(spark, base)


# ------------------------------------------------------------------ M1
@query("feature_routing", with_wide(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_ratio, "
        f"CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 THEN 'impute' "
        f"ELSE 'passthrough' END AS route FROM e" for c in NUM_CAND) + ")",
    *_engineered_ctes()[:3]))
def q_feature_routing(spark, base):
    w, num, _, _ = _engineered(spark, base)
    return rounded(M.feature_routing(w, num, SPEC.routing_max_null))


# ------------------------------------------------------------------ M8
@query("stratified_split", with_wide("""
SELECT o_orderkey, flag,
       CASE WHEN row_number() OVER (PARTITION BY flag ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey)
                 <= round(0.2 * count(*) OVER (PARTITION BY flag)) THEN 'test' ELSE 'train' END AS split
FROM wide"""))
def q_stratified_split(spark, base):
    w = wide_table(spark, base).select("o_orderkey", "flag")
    return M.stratified_split(w, "flag", "o_orderkey", SPEC.test_share, SPEC.seed)


@query("hash_split", with_wide("""
SELECT o_orderkey, CASE WHEN substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) < '33333333'
                   THEN 'test' ELSE 'train' END AS split FROM wide"""))
def q_hash_split(spark, base):
    w = wide_table(spark, base).select("o_orderkey")
    return M.hash_split(w, "o_orderkey", SPEC.test_share, SPEC.seed)


@query("stratified_folds", with_wide("""
SELECT o_orderkey, flag,
       CAST((row_number() OVER (PARTITION BY flag ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM wide"""))
def q_stratified_folds(spark, base):
    w = wide_table(spark, base).select("o_orderkey", "flag")
    return M.stratified_folds(w, "flag", "o_orderkey", 5, SPEC.seed)


# ------------------------------------------------------------------ M10
@query("class_weights", with_wide(f"""
SELECT o_orderkey, flag, {r("CASE WHEN flag = 1 THEN (SELECT CAST(count(*) FILTER (WHERE flag = 0) AS DOUBLE) / count(*) FILTER (WHERE flag = 1) FROM wide) ELSE 1.0 END")} AS weight
FROM wide"""))
def q_class_weights(spark, base):
    w = wide_table(spark, base).select("o_orderkey", "flag")
    return rounded(M.class_weights(w, "flag"))


# ------------------------------------------------------------------ K5 / M2-M5
def _params_sql():
    num = [f"SELECT 'num' AS kind, '{c}' AS feature, {i} AS position, CAST(NULL AS VARCHAR) AS level, "
           f"{r(f'm_{c}')} AS fill, {r(f'mu_{c}')} AS mean, {r(f'sd_{c}')} AS scale FROM med, st"
           for i, c in enumerate(IMPUTABLE)]
    cat = [f"SELECT 'cat', '{c}', {i}, '{v}', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
           for c, lv in LEVELS.items() for i, v in enumerate(lv)]
    pas = [f"SELECT 'passthru', '{c}', {i}, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
           for i, c in enumerate(PASSTHRU)]
    binr = [f"SELECT 'binary', '{c}', {i}, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
            for i, c in enumerate(BINARY)]
    return with_wide(" UNION ALL ".join(num + cat + pas + binr), *_engineered_ctes())


@query("preproc_params", _params_sql())
def q_preproc_params(spark, base):
    return rounded(prepared(spark, base).preprocessor.params_table())


# ------------------------------------------------------------------ M7 (and M2-M6 applied)
@query("prepare_data", with_wide(_prepared_select(), *_engineered_ctes()))
def q_prepare_data(spark, base):
    return rounded(prepared(spark, base).table)


@query("preproc_apply", with_wide(_prepared_select(with_split=False), *_engineered_ctes()))
def q_preproc_apply(spark, base):
    """The fitted preprocessor saved, loaded and applied to every entity."""
    p = prepared(spark, base)
    path = scratch_path(spark, "preprocessor")
    p.preprocessor.save(path)
    w, _, _, _ = _engineered(spark, base)
    w = w.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in p.passthru
                       if f"{c}_missing" not in w.columns})
    return rounded(M.Preprocessor.load(spark, path).transform(w, keep=[SPEC.entity_key, SPEC.label]))


@query("assemble")
def q_assemble(spark, base):
    p = prepared(spark, base)
    v = M.assemble(p.table, p.feature_names)
    return v.select("o_orderkey", "flag", vector_to_array("features").alias("features"))


# ------------------------------------------------------------------ M9
def _smote_sql():
    """Brute force: all pairs of distinct positive vectors, the k least distances."""
    feats = IMPUTABLE + [f"{c}_{v}" for c, lv in LEVELS.items() for v in lv] + BINARY
    q = [f'"{c}"' for c in feats]
    square = " + ".join(f"(a.vec[{i + 1}] - b.vec[{i + 1}]) * (a.vec[{i + 1}] - b.vec[{i + 1}])" for i in range(len(feats)))
    k, digest = SPEC.balance_k, f"md5('{SPEC.seed}:' || CAST(o_orderkey AS VARCHAR)"
    ctes = [
        f"p AS ({_prepared_select()})",
        "t AS (SELECT * FROM p WHERE split = 'train')",
        f"m AS (SELECT o_orderkey, flag, [{', '.join(q)}] AS vec FROM t WHERE flag = 1)",
        "ve AS (SELECT min(o_orderkey) AS rep, count(*) AS mult, vec FROM m GROUP BY vec)",
        f"d AS (SELECT a.rep, b.rep AS nb, b.mult, b.vec, round({square}, 9) AS d2 FROM ve a JOIN ve b ON a.rep <> b.rep)",
        f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY d2, nb) AS r FROM d) WHERE r <= {k})",
        # places 0 .. mult - 2 are copies of the vector, then each neighbour with its copies
        "nx AS (SELECT rep, vec, sum(mult) OVER w - mult AS lo, sum(mult) OVER w AS hi FROM nn WINDOW w AS "
        "(PARTITION BY rep ORDER BY r ROWS UNBOUNDED PRECEDING))",
        "c AS (SELECT count(*) FILTER (WHERE flag = 1) AS pos, count(*) FILTER (WHERE flag = 0) AS neg FROM t)",
        f"need AS (SELECT pos, CAST(floor(neg * {SPEC.balance_ratio}) AS BIGINT) - pos AS n FROM c)",
        f"rk AS (SELECT *, row_number() OVER (ORDER BY {digest}), o_orderkey) AS r FROM m)",
        "made AS (SELECT o_orderkey, flag, vec, unnest(range(1, n // pos + CASE WHEN r <= n % pos THEN 1 ELSE 0 END + 1)) "
        "AS replica FROM rk, need)",
        f"h AS (SELECT *, {digest} || ':' || CAST(replica AS VARCHAR)) AS h FROM made)",
        f"u AS (SELECT h.*, ve.rep, ve.mult, CAST(floor(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967296.0 "
        f"* least({k}, pos - 1)) AS BIGINT) AS pick, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0 AS u "
        "FROM h JOIN ve USING (vec), need)",
        "syn AS (SELECT u.o_orderkey, u.flag, u.replica, u.u, u.vec, CASE WHEN u.pick < u.mult - 1 THEN u.vec ELSE nx.vec END "
        "AS e FROM u LEFT JOIN nx ON nx.rep = u.rep AND u.pick - (u.mult - 1) >= nx.lo AND u.pick - (u.mult - 1) < nx.hi)",
    ]
    return with_wide(
        f"SELECT o_orderkey, flag, CAST(0 AS BIGINT) AS replica, {', '.join(q)} FROM t UNION ALL "
        "SELECT o_orderkey, flag, replica, "
        + ", ".join(f"{r(f'vec[{i + 1}] + u * (e[{i + 1}] - vec[{i + 1}])')} AS {c}" for i, c in enumerate(q)) + " FROM syn",
        *_engineered_ctes(), *ctes)


@query("smote", _smote_sql())
def q_smote(spark, base):
    """The training rows with positives raised to the spec's share of the
    negatives; without the pass-through columns, which hold NULLs."""
    p = prepared(spark, base)
    features = [c for c in p.feature_names if c not in p.passthru]
    train = rounded(p.table.where(F.col("split") == "train"))
    return rounded(N.smote(train, SPEC.entity_key, SPEC.label, features, SPEC.balance_ratio, SPEC.balance_k,
                           seed=SPEC.seed).table)
