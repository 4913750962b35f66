"""EngineSpec: every domain constant the operators need, in one frozen object.

Operators never hard-code column names; they take them from a spec (or as
arguments).  Two specs ship:

* ``tpch_binding()``   - the roles bound to the driver's TPC-H-style tables
                         (used by ``__spark_entry__``, tests and the bench).
* ``clinical_spec()``  - the original clinical schema (admissions, labs,
                         Braden subscores) for users of the original tool.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ThresholdFlag:
    name: str
    column: str
    op: str          # one of < <= > >=
    value: float


@dataclass(frozen=True)
class Rule:
    """A row rule: message emitted when ``column op value`` holds."""
    column: str
    op: str
    value: float
    message: str


def rule(column: str, op: str, value: float, message: str | None = None) -> Rule:
    """A rule whose message, unless the caller words it, states its condition."""
    return Rule(column, op, value, message or f"{column} {op} {value:g}")


@dataclass(frozen=True)
class EngineSpec:
    entity_key: str
    subject_key: str
    label: str
    numeric_features: tuple[str, ...]
    categorical_features: tuple[str, ...]
    binary_features: tuple[str, ...]
    indicator_columns: tuple[str, ...]          # get a <col>_missing flag
    score_parts: tuple[str, ...]                # summed into ``score_total``
    score_total: str
    valid_ranges: tuple[tuple[str, float, float], ...]
    clip_ranges: tuple[tuple[str, float, float], ...]
    threshold_flags: tuple[ThresholdFlag, ...]
    lump_column: str | None = None
    lump_top_n: int = 5
    seed: int = 42
    test_share: float = 0.2
    auroc_target: float = 0.80
    sensitivity_target: float = 0.80
    tier_low: float = 0.15
    tier_moderate: float = 0.40
    routing_max_null: float = 0.50
    balance_ratio: float = 0.20
    balance_k: int = 5
    warnings: tuple[Rule, ...] = ()
    recommendations: tuple[Rule, ...] = ()
    default_recommendation: str = "no rule applies"
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def engineered_binary(self) -> tuple[str, ...]:
        return tuple(t.name for t in self.threshold_flags)


def tpch_binding() -> EngineSpec:
    """Roles of the original pipeline bound to the driver tables.

    admission key -> o_orderkey, patient key -> o_custkey, label -> flag
    (versioned code predicate over lineitem x part), labs -> min
    l_extendedprice per return flag, subscores -> min events.value per
    event type, icu flag -> customer has an 'error' event, age ->
    c_acctbal, gender -> segment (c_mktsegment, HOUSEHOLD as null),
    race -> o_orderpriority, insurance -> o_orderstatus.
    """
    subs = ("sub_click", "sub_view", "sub_purchase", "sub_signup")
    labs = ("lab_a", "lab_n", "lab_r")
    # Fixed values of the binding (ranges, thresholds, rule cut-offs).
    ranges = (("los_days", 0.0, 2000.0),
              ("lab_a", 1000.0, 100000.0),
              ("lab_n", 1000.0, 100000.0),
              ("lab_r", 1000.0, 100000.0),
              ("sub_click", 0.5, 15.0),
              ("sub_view", 0.5, 15.0),
              ("sub_purchase", 0.5, 15.0),
              ("sub_signup", 0.5, 15.0),
              ("c_acctbal", 0.0, 9000.0))
    flags = (ThresholdFlag("acctbal_over_7500", "c_acctbal", ">=", 7500.0),
             ThresholdFlag("los_over_7", "los_days", ">", 7.0),
             ThresholdFlag("los_over_14", "los_days", ">", 14.0),
             ThresholdFlag("lab_a_low", "lab_a", "<", 20000.0),
             ThresholdFlag("lab_n_low", "lab_n", "<", 10000.0))
    warnings = (rule("lab_a", "<", 2000.0),
                rule("lab_n", "<", 1500.0),
                rule("sub_total", "<=", 12.0))
    recs = (rule("lab_a", "<", 20000.0),
            rule("sub_view", "<=", 2.0),
            rule("sub_click", "<=", 2.0),
            rule("los_days", ">", 7.0),
            rule("err_flag", "==", 1.0))
    return EngineSpec(
        entity_key="o_orderkey",
        subject_key="o_custkey",
        label="flag",
        numeric_features=("c_acctbal", "los_days") + labs + subs,
        categorical_features=("segment", "o_orderpriority", "o_orderstatus"),
        binary_features=("err_flag",),
        indicator_columns=labs,
        score_parts=subs,
        score_total="sub_total",
        valid_ranges=ranges,
        clip_ranges=ranges,
        threshold_flags=flags,
        lump_column="o_orderpriority",
        warnings=warnings,
        recommendations=recs,
    )


def clinical_spec() -> EngineSpec:
    """The original clinical schema (wide admission table)."""
    braden = ("braden_sensory_perception", "braden_moisture", "braden_activity",
              "braden_mobility", "braden_nutrition", "braden_friction_shear")
    labs = ("albumin", "hemoglobin", "creatinine", "white_blood_cells", "platelet_count")
    # Fixed values of the original tool: clinical ranges (inclusive), Braden
    # ranges, engineered-flag cut-offs, warning and recommendation cut-offs.
    clinical = (("albumin", 0.5, 7.0), ("hemoglobin", 2.0, 25.0),
                ("creatinine", 0.1, 30.0), ("white_blood_cells", 0.1, 500.0),
                ("platelet_count", 1.0, 2000.0), ("los_days", 0.0, 365.0),
                ("age", 18.0, 120.0))
    braden_ranges = (("braden_sensory_perception", 1.0, 4.0), ("braden_moisture", 1.0, 4.0),
                     ("braden_activity", 1.0, 4.0), ("braden_mobility", 1.0, 4.0),
                     ("braden_nutrition", 1.0, 4.0), ("braden_friction_shear", 1.0, 3.0))
    flags = (ThresholdFlag("age_over_75", "age", ">=", 75.0),
             ThresholdFlag("los_over_7", "los_days", ">", 7.0),
             ThresholdFlag("los_over_14", "los_days", ">", 14.0),
             ThresholdFlag("albumin_low", "albumin", "<", 3.0),
             ThresholdFlag("hemoglobin_low", "hemoglobin", "<", 10.0))
    warnings = (rule("albumin", "<", 2.5),
                rule("hemoglobin", "<", 7.0),
                rule("braden_total", "<=", 12.0))
    recs = (rule("albumin", "<", 3.0),
            rule("braden_mobility", "<=", 2.0),
            rule("braden_moisture", "<=", 2.0),
            rule("los_days", ">", 7.0),
            rule("icu_flag", "==", 1.0))
    return EngineSpec(
        entity_key="hadm_id",
        subject_key="subject_id",
        label="pi_flag",
        numeric_features=("age", "los_days") + labs + braden,
        categorical_features=("gender", "race", "insurance"),
        binary_features=("icu_flag",),
        indicator_columns=labs,
        score_parts=braden,
        score_total="braden_total",
        valid_ranges=clinical + braden_ranges,
        clip_ranges=clinical,
        threshold_flags=flags,
        lump_column="race",
        warnings=warnings,
        recommendations=recs,
    )
