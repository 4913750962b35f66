"""J4 bound by a declaration: a graph of sources compiled to one wide table.

A graph names the sources (path, types, optional or not), the base rows, and
what each other source adds to them: attributes (many-to-one), a flag (distinct
keys, by versioned codes or any rows) or a pivot (least value per code).
``compile_graph`` turns it into one lazy plan:

* every source is read once per use with the columns the graph names, and a
  code filter or cohort bound reaches its scan;
* all pivots and any-row flags of one source and key become one aggregation;
* what joins on the same key shares that key's partitioning: parts on the base
  key are joined first, then those of each other key, with the sources of one
  key joined to each other before they meet the base rows;
* the cohort bound filters the source its column comes from, so that the join
  to it is an inner join.

An absent optional source is an empty typed table: its flag is 0, its columns
are NULL, and nothing downstream branches.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.scalar import duration_days, versioned_code_predicate
from riskframe.sources.readers import nan_to_null, optional_source, read_table, scan_csv


@dataclass(frozen=True)
class Source:
    """A table: where it lies under the root, its columns and their types."""
    path: str
    columns: tuple[tuple[str, str], ...]
    fmt: str = "csv"
    optional: bool = False

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.columns)


@dataclass(frozen=True)
class Attributes:
    """Columns of a table with one row per key, as ``(out, column)``; NULL where
    no row matches.  ``nulls`` are values that count as missing, per column."""
    source: str
    key: str
    columns: tuple[tuple[str, str], ...]
    nulls: tuple[tuple[str, str], ...] = ()
    on: str | None = None           # column of the base rows; default: ``key``


@dataclass(frozen=True)
class Version:
    """Codes of one version: value of the version column, code prefixes, and
    further conditions (column, op, value) on the code's row."""
    value: object
    prefixes: tuple[str, ...]
    where: tuple[tuple[str, str, object], ...] = ()


@dataclass(frozen=True)
class Flag:
    """1 for base rows whose key occurs, else 0.  With ``versions`` only rows
    with such a code count; codes may live in another source, reached by
    ``lookup`` = (source, own column, its key)."""
    source: str
    key: str
    out: str
    version: str | None = None
    code: str | None = None
    versions: tuple[Version, ...] = ()
    lookup: tuple[str, str, str] | None = None
    where: tuple[tuple[str, str, object], ...] = ()     # further conditions (column, op, value)
    on: str | None = None


@dataclass(frozen=True)
class Pivot:
    """The least ``value`` per listed code, one column each (code -> out)."""
    source: str
    key: str
    code: str
    value: str
    codes: tuple[tuple[object, str], ...]
    on: str | None = None


@dataclass(frozen=True)
class Latest:
    """The greatest value of a column per key, to be used in ``Graph.duration``."""
    source: str
    key: str
    column: str
    out: str
    on: str | None = None


@dataclass(frozen=True)
class Graph:
    sources: Mapping[str, Source]
    base: str
    base_columns: tuple[str, ...]
    duration: tuple[str, str, str] | None = None        # (out, start, end)
    parts: tuple = ()
    cohort: tuple[str, float] | None = None             # (column, least value)
    columns: tuple[str, ...] = field(default=())        # output, in order

    def check(self) -> None:
        """Every name a part uses must be declared."""
        for p in self.parts:
            if p.source not in self.sources:
                raise ValueError(f"{p}: unknown source {p.source!r}")
            have, want = set(self.sources[p.source].names), {p.key}
            if isinstance(p, Attributes):
                want |= {c for _, c in p.columns}
            elif isinstance(p, Pivot):
                want |= {p.code, p.value}
            elif isinstance(p, Latest):
                want |= {p.column}
            if not want <= have:
                raise ValueError(f"{p.source}: no column {sorted(want - have)}")
        outs = [o for p in self.parts for o in _outs(p)] + list(self.base_columns)
        if len(outs) != len(set(outs)):
            raise ValueError(f"columns named twice: {sorted({o for o in outs if outs.count(o) > 1})}")


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
       ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _outs(part) -> list[str]:
    if isinstance(part, Attributes):
        return [o for o, _ in part.columns]
    return [o for _, o in part.codes] if isinstance(part, Pivot) else [part.out]


def open_sources(spark: SparkSession, graph: Graph, root: str) -> dict[str, DataFrame]:
    """The graph's tables under ``root``: CSV (also ``.gz``) or parquet, with the
    declared columns and types; absent optional ones are empty.  NaN is NULL,
    but for the source of the cohort column, whose bound must reach the scan."""
    out = {}
    raw = {p.source for p in graph.parts if isinstance(p, Attributes) and graph.cohort
           and graph.cohort[0] in dict(p.columns)}
    for name, s in graph.sources.items():
        path = f"{root.rstrip('/')}/{s.path}"
        if s.optional:
            df = optional_source(spark, path, s.fmt, schema=s.schema)
        elif s.fmt == "csv":
            df = scan_csv(spark, path, infer=False)
        else:
            df = read_table(spark, root, s.path.removesuffix(".parquet"), nan=name in raw)
        out[name] = df.select(*[F.col(c).cast(t).alias(c) for c, t in s.columns])
    return out


def _all(conditions) -> Column:
    """Whether all conditions (column, op, value) hold; NULL counts as no."""
    return reduce(lambda a, b: a & b, [F.coalesce(OPS[op](F.col(c), F.lit(v)), F.lit(False)) for c, op, v in conditions],
                  F.lit(True))


def _coded(flag: Flag, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of a flag's source whose code counts."""
    code = F.col(flag.code)
    tests = [reduce(lambda a, b: a | b, [code.startswith(p) for p in v.prefixes]) & _all(v.where) for v in flag.versions]
    df = tables[flag.source].where(_all(flag.where)).where(F.col(flag.version).isin([v.value for v in flag.versions]))
    if flag.lookup:
        source, own, key = flag.lookup
        needed = dict.fromkeys([flag.code, *[c for v in flag.versions for c, _, _ in v.where]])
        # only rows that some version accepts, so that the looked-up side is small
        codes = tables[source].where(reduce(lambda a, b: a | b, tests)).select(F.col(key).alias("__code_key"), *needed)
        df = df.join(codes, F.col(own) == F.col("__code_key"))
    return df.where(versioned_code_predicate(flag.version, flag.code, [(v.value, t) for v, t in zip(flag.versions, tests)]))


def _gathered(source: DataFrame, key: str, parts: list) -> DataFrame:
    """All pivots, latest values and any-row flags of one source and key: one pass."""
    aggs, needed = [], []
    for p in parts:
        if isinstance(p, Pivot):
            hit = F.col(p.code).isin([c for c, _ in p.codes]) & F.col(p.value).isNotNull()
            aggs += [F.min(F.when(F.col(p.code) == F.lit(c), F.col(p.value))).alias(o) for c, o in p.codes]
        elif isinstance(p, Latest):
            hit = F.col(p.column).isNotNull()
            aggs.append(F.max(p.column).alias(p.out))
        else:
            hit = _all(p.where)
            aggs.append(F.max(F.when(hit, F.lit(1))).alias(p.out))
        needed.append(hit)
    rows = source.where(F.col(key).isNotNull() & reduce(lambda a, b: a | b, needed))
    return rows.groupBy(F.col(key).alias("__key")).agg(*aggs)


def _parts_by_key(graph: Graph, tables: Mapping[str, DataFrame]) -> dict[str, list]:
    """``{base column: [(table with __key, required)]}``: one aggregated or
    attribute table per source and key."""
    out: dict[str, list] = {}
    together: dict[tuple, list] = {}
    for p in graph.parts:
        on = p.on or p.key
        if isinstance(p, Attributes):
            df = tables[p.source]
            cohort = dict(p.columns).get(graph.cohort[0]) if graph.cohort else None
            if cohort:                              # NaN is no number: it is in no cohort
                df = nan_to_null(df.where((F.col(cohort) >= graph.cohort[1]) & ~F.isnan(F.col(cohort).cast("double"))))
            nulls = dict(p.nulls)
            cols = [(F.nullif(F.col(c), F.lit(nulls[o])) if o in nulls else F.col(c)).alias(o) for o, c in p.columns]
            out.setdefault(on, []).append((df.where(F.col(p.key).isNotNull()).select(
                F.col(p.key).alias("__key"), *cols), bool(cohort)))
        elif isinstance(p, Flag) and p.versions:
            keys = _coded(p, tables).where(F.col(p.key).isNotNull()).select(F.col(p.key).alias("__key")).distinct()
            out.setdefault(on, []).append((keys.withColumn(p.out, F.lit(1)), False))
        else:
            together.setdefault((p.source, p.key, on), []).append(p)
    for (source, key, on), parts in together.items():
        out.setdefault(on, []).append((_gathered(tables[source], key, parts), False))
    return out


def compile_graph(graph: Graph, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The wide table: one row per base row (of the cohort), columns in the
    graph's order.  Attribute tables must have one row per key."""
    graph.check()
    wide = tables[graph.base].select(*graph.base_columns)
    by_key = _parts_by_key(graph, tables)
    own = [p.on or p.key for p in graph.parts if not isinstance(p, Attributes)]
    # the key most aggregates share comes first: only the base rows are dealt for them
    for on in sorted(by_key, key=lambda k: (-own.count(k), k)):
        sides = sorted(by_key[on], key=lambda s: not s[1])
        first = sides[0]
        if on not in own or len(sides) > 1 and first[1]:
            # sources of one row per key meet each other before the base rows
            whole = reduce(lambda a, b: a.join(b[0], "__key", "left" if first[1] else "full"), sides[1:], first[0])
            sides = [(whole, first[1])]
        for table, required in sides:
            wide = wide.join(table, F.col(on) == F.col("__key"), "inner" if required else "left").drop("__key")
    flags = [p.out for p in graph.parts if isinstance(p, Flag)]
    made: dict[str, Column] = {f: F.coalesce(F.col(f), F.lit(0)).alias(f) for f in flags}
    if graph.duration:
        out, start, end = graph.duration
        made[out] = duration_days(start, end).alias(out)
    names = graph.columns or (*graph.base_columns, *[o for p in graph.parts for o in _outs(p)])
    return wide.select(*[made.get(c, F.col(c)) for c in names])


# ------------------------------------------------------------------ the two bindings
def driver_graph() -> Graph:
    """The driver tables: the binding of ``plans.analytic`` as a declaration."""
    table = lambda name, cols: Source(f"{name}.parquet", cols, "parquet")
    subs = ("click", "view", "purchase", "signup")
    # Fixed values of the binding: codes and prefixes.
    return Graph(
        sources={
            "orders": table("orders", (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderdate", "timestamp_ntz"),
                                       ("o_orderpriority", "string"), ("o_orderstatus", "string"))),
            "customer": table("customer", (("c_custkey", "bigint"), ("c_mktsegment", "string"), ("c_acctbal", "double"))),
            "lineitem": table("lineitem", (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_returnflag", "string"),
                                           ("l_linestatus", "string"), ("l_extendedprice", "double"),
                                           ("l_shipdate", "timestamp_ntz"))),
            "part": table("part", (("p_partkey", "bigint"), ("p_brand", "string"), ("p_type", "string"))),
            "events": table("events", (("user_id", "bigint"), ("event_type", "string"), ("value", "double"))),
        },
        base="orders",
        base_columns=("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"),
        duration=("los_days", "o_orderdate", "discharge"),
        parts=(
            Attributes("customer", "c_custkey", (("segment", "c_mktsegment"), ("c_acctbal", "c_acctbal")),
                       nulls=(("segment", "HOUSEHOLD"),), on="o_custkey"),
            Latest("lineitem", "l_orderkey", "l_shipdate", "discharge", on="o_orderkey"),
            Pivot("lineitem", "l_orderkey", "l_returnflag", "l_extendedprice",
                  (("A", "lab_a"), ("N", "lab_n"), ("R", "lab_r")), on="o_orderkey"),
            Flag("lineitem", "l_orderkey", "flag", "l_linestatus", "p_brand",
                 (Version("F", tuple(f"Brand#1{i}" for i in range(10)), (("p_type", "==", "PROMO"),)), Version("O", ("Brand#7",))),
                 ("part", "l_partkey", "p_partkey"), (("l_returnflag", "==", "R"),), on="o_orderkey"),
            Pivot("events", "user_id", "event_type", "value", tuple((s, f"sub_{s}") for s in subs), on="o_custkey"),
            Flag("events", "user_id", "err_flag", where=(("event_type", "==", "error"),), on="o_custkey"),
        ),
        cohort=("c_acctbal", 0.0),
        columns=("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "los_days", "segment", "c_acctbal",
                 "flag", "err_flag", "lab_a", "lab_n", "lab_r", *(f"sub_{s}" for s in subs)))


def clinical_graph() -> Graph:
    """The original clinical schema: admissions with patients, diagnoses, labs,
    chart events and ICU stays (the last two optional), adults only."""
    event = (("hadm_id", "bigint"), ("itemid", "int"), ("valuenum", "double"))
    # Fixed values of the original tool: item ids, code prefixes per version, least age.
    labs = ((50862, "albumin"), (51222, "hemoglobin"), (50912, "creatinine"), (51301, "white_blood_cells"),
            (51265, "platelet_count"))
    scores = ((224054, "sensory_perception"), (224055, "moisture"), (224056, "activity"), (224057, "mobility"),
              (224058, "nutrition"), (224059, "friction_shear"))
    versions = (Version(9, tuple(f"707{i}" for i in range(10))), Version(10, ("L89",)))
    adult = 18.0
    scores = tuple((i, f"braden_{n}") for i, n in scores)
    return Graph(
        sources={
            "admissions": Source("hosp/admissions.csv", (
                ("subject_id", "bigint"), ("hadm_id", "bigint"), ("admittime", "timestamp_ntz"),
                ("dischtime", "timestamp_ntz"), ("race", "string"), ("insurance", "string"),
                ("hospital_expire_flag", "int"))),
            "patients": Source("hosp/patients.csv", (("subject_id", "bigint"), ("gender", "string"), ("anchor_age", "int"))),
            "diagnoses": Source("hosp/diagnoses_icd.csv", (("hadm_id", "bigint"), ("icd_code", "string"),
                                                           ("icd_version", "int"))),
            "labs": Source("hosp/labevents.csv", event),
            "charts": Source("icu/chartevents.csv", event, optional=True),
            "icu": Source("icu/icustays.csv", (("hadm_id", "bigint"),), optional=True),
        },
        base="admissions",
        base_columns=("subject_id", "hadm_id", "admittime", "dischtime", "race", "insurance", "hospital_expire_flag"),
        duration=("los_days", "admittime", "dischtime"),
        parts=(
            Attributes("patients", "subject_id", (("gender", "gender"), ("age", "anchor_age"))),
            Flag("diagnoses", "hadm_id", "pi_flag", "icd_version", "icd_code", versions),
            Flag("icu", "hadm_id", "icu_flag"),
            Pivot("labs", "hadm_id", "itemid", "valuenum", labs),
            Pivot("charts", "hadm_id", "itemid", "valuenum", scores),
        ),
        cohort=("age", adult),
        columns=("subject_id", "hadm_id", "race", "insurance", "hospital_expire_flag", "los_days", "gender", "age",
                 "pi_flag", "icu_flag", *(o for _, o in labs), *(o for _, o in scores)))


def wide_from_graph(spark: SparkSession, graph: Graph, root: str) -> DataFrame:
    """Open the graph's sources under ``root`` and compile it."""
    return compile_graph(graph, open_sources(spark, graph, root))
