"""Cleaning chains (C10) with their step log (A18) in few passes.

Steps either change cells by constants fitted to whole columns (fills, clip,
scaling, one-hot) or change the rows (dropna, dedup).  Between two changes of
the rows nothing is written: the frame stays a projection of one written
table, and each numeric column carries the moments that its pending rules leave
behind.  A fill and a scaling map all of them, a clip maps least and greatest
value, so a later step measures only what no rule could carry on.  Modes and
levels of all categorical columns come from one table of counts.

Row counts are observed in the write that ends a stretch, always in tasks
without a shuffle above them: such a task counts once, however often executors
are lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators import quality as Q
from riskframe.operators.quantiles import exact_quantiles
from riskframe.session import materialize as write_once
from riskframe.session import temporary_tables

#: Columns per aggregate, which reads no others.
CHUNK = 30


@dataclass(frozen=True)
class Moments:
    """What is known of a numeric column: ``n`` values, ``nulls``, extremes,
    and mean with squared deviations unless a rule made them unknown."""

    n: int
    nulls: int
    lo: float | None
    hi: float | None
    mean: float | None
    m2: float | None

    @property
    def sd(self) -> float | None:
        """Sample deviation; 0 for a constant column, whatever sums round to."""
        if self.n < 2:
            return None
        return 0.0 if self.lo == self.hi else math.sqrt(max(self.m2, 0.0) / (self.n - 1))

    def filled(self, v: float) -> Moments:
        """After NULLs became ``v`` (two groups' deviations pooled)."""
        if not self.nulls:
            return self
        rows = self.n + self.nulls
        known = self.mean is not None
        return Moments(rows, 0, min(self.lo, v), max(self.hi, v),
                       (self.n * self.mean + self.nulls * v) / rows if known else None,
                       self.m2 + self.n * self.nulls / rows * (v - self.mean) ** 2 if known else None)

    def scaled(self, shift: float, by: float) -> Moments:
        """After ``(x - shift) / by``, ``by`` > 0."""
        known = self.mean is not None
        return replace(self, lo=(self.lo - shift) / by, hi=(self.hi - shift) / by,
                       mean=(self.mean - shift) / by if known else None, m2=self.m2 / by ** 2 if known else None)

    def clipped(self, lo: float, hi: float) -> Moments:
        if self.n == 0 or (lo <= self.lo and self.hi <= hi):
            return self
        return replace(self, lo=min(max(self.lo, lo), hi), hi=min(max(self.hi, lo), hi), mean=None, m2=None)


def measure(df: DataFrame, cols) -> dict[str, Moments]:
    """Moments of ``cols``: one aggregate per ``CHUNK`` columns, one row each."""
    out, cols = {}, list(cols)
    for at in range(0, len(cols), CHUNK):
        some = cols[at:at + CHUNK]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(some):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                     F.avg(x).alias(f"mean{i}"), F.var_samp(x).alias(f"var{i}")]
        r = df.agg(*aggs).first()
        for i, c in enumerate(some):
            n, lo, hi, mean, var = (r[f"{k}{i}"] for k in ("n", "lo", "hi", "mean", "var"))
            if n and math.isfinite(mean):
                mean = min(max(mean, lo), hi)  # sums round: the mean of equal values is that value
            out[c] = Moments(n, r["rows"] - n, lo, hi, mean, (var or 0.0) * max(n - 1, 0))
    return out


class Chain:
    """One run of ``quality.clean``: the frame, what is known of its columns,
    and the log.  With ``write`` off every stage stays lazy."""

    def __init__(self, df: DataFrame, numeric, categorical, ranges, write: bool):
        self.cur, self.num, self.cat = df, list(numeric), list(categorical)
        self.ranges = [(c, lo, hi) for c, lo, hi in ranges if c in df.columns]
        self.write = write
        self.known: dict[str, Moments] = {}
        self.counts: DataFrame | None = None
        self.no_nulls = False
        self.stretch, self.rows = 0, {}
        self.log: list[tuple[str, int, int]] = []
        self.stages: list[tuple[str, DataFrame]] = []
        self.pending = False

    # -------------------------------------------------------------- statistics
    def moments(self, cols, whole: bool) -> dict[str, Moments]:
        """Moments of ``cols``; ``whole`` asks for mean and deviations too."""
        todo = [c for c in cols if c not in self.known
                or (whole and self.known[c].n and self.known[c].mean is None)]
        # whatever is unknown is measured in the same pass
        if todo:
            self.known.update(measure(self.cur, [c for c in self.num if c not in self.known or c in todo]))
        return {c: self.known[c] for c in cols}

    def category_counts(self) -> DataFrame:
        """``(column, value, n)`` of all categorical columns, written once."""
        if self.counts is None:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))
                                        for c in self.cat]))
            counts = self.cur.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(
                F.count(F.lit(1)).alias("n"))
            self.counts = write_once(counts, "clean-levels")
        return self.counts

    # -------------------------------------------------------------- cell steps
    def fill(self, values: dict[str, float | None]) -> None:
        """NULL -> ``values[c]``, all numeric columns (integral ones become double)."""
        new = {}
        for c in self.num:
            kind = self.cur.schema[c].dataType
            to = T.DoubleType() if isinstance(kind, T.IntegralType) else kind
            v = values.get(c)
            if v is None:
                if to != kind:
                    new[c] = F.col(f"`{c}`").cast(to)
                continue
            new[c] = F.coalesce(F.col(f"`{c}`").cast(to), F.lit(v).cast(to))
            if isinstance(to, T.DoubleType):
                self.known[c] = self.known[c].filled(v)
            else:  # the value is rounded to the column's type
                self.known.pop(c, None)
        if new:
            self.cur = self.cur.withColumns(new)

    def impute_median(self) -> None:
        gaps = [] if self.no_nulls else [c for c, m in self.moments(self.num, False).items() if m.nulls and m.n]
        got = exact_quantiles(self.cur, gaps, (0.5,)) if gaps else {}
        self.fill({c: got[c][0] for c in gaps})

    def impute_mean(self) -> None:
        if self.no_nulls:
            return self.fill({})
        gaps = [c for c, m in self.moments(self.num, False).items() if m.nulls and m.n]
        self.fill({c: m.mean for c, m in self.moments(gaps, True).items()})

    def impute_mode(self) -> None:
        here = [c for c in self.cat if c in self.cur.columns]
        if self.no_nulls or not here:
            return
        modes = (self.category_counts().where(F.col("value").isNotNull()).groupBy("column")
                 .agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select("column", "m.value").collect())
        mode = {r["column"]: r["value"] for r in modes}
        self.cur = self.cur.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(mode[c])) for c in here if c in mode})

    def clip(self) -> None:
        self.cur = Q.clip_ranges(self.cur, self.ranges)
        for c, lo, hi in self.ranges:
            if c in self.known:
                self.known[c] = self.known[c].clipped(lo, hi)

    def scale(self, which: str) -> None:
        new = {}
        for c, m in self.moments(self.num, which == "zscore").items():
            x = F.col(f"`{c}`").cast("double")
            shift, by = (m.mean, m.sd) if which == "zscore" else (m.lo, None if m.lo is None else m.hi - m.lo)
            if by is not None and math.isfinite(by) and by > 0:
                new[c] = (x - F.lit(shift)) / F.lit(by)
                self.known[c] = m.scaled(shift, by)
            else:
                new[c] = x
        if new:
            self.cur = self.cur.withColumns(new)

    def one_hot(self, max_levels: int = 1000) -> None:
        here = [c for c in self.cat if c in self.cur.columns]
        if not here:
            return
        some = self.category_counts().where(F.col("value").isNotNull())
        for r in some.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():
            if r["n"] > max_levels:
                raise ValueError(f"{r['column']}: more than {max_levels} levels; one-hot refused")
        levels: dict[str, list] = {c: [] for c in here}
        for r in some.select("column", "value").collect():  # at most max_levels a column
            levels[r["column"]].append(r["value"])
        self.cur = Q.one_hot(self.cur, here, levels={c: sorted(v) for c, v in levels.items()})

    # -------------------------------------------------------------- row steps
    def change(self, step: str) -> None:
        """``dropna`` or ``dedup``: a new stretch, what was known is void."""
        if step == "dropna" and self.no_nulls:
            return
        if not self.write:
            self.cur = Q.dropna_any(self.cur) if step == "dropna" else Q.dedup_rows(self.cur)
        elif step == "dropna":
            before, after = Observation(), Observation()
            one = F.count(F.lit(1)).alias("rows")
            kept = Q.dropna_any(self.cur.observe(before, one)).observe(after, one)
            self.cur = write_once(kept, "clean-dropna")
            self.count(_seen(before, "rows"), _seen(after, "rows"))
        else:
            seen, n = Observation(), "__n"
            while n in self.cur.columns:
                n += "_"
            # a repeated row travels once, with its number: both counts are seen after the shuffle
            once = self.cur.groupBy(*[F.col(f"`{c}`") for c in self.cur.columns]).agg(F.count(F.lit(1)).alias(n))
            once = once.observe(seen, F.sum(n).alias("before"), F.count(F.lit(1)).alias("rows")).drop(n)
            self.cur = write_once(once, "clean-dedup")
            self.count(_seen(seen, "before"), _seen(seen, "rows"))
        self.no_nulls = self.no_nulls or step == "dropna"
        self.known, self.counts, self.pending = {}, None, False

    def count(self, before: int, after: int) -> None:
        self.rows[self.stretch], self.rows[self.stretch + 1] = before, after
        self.stretch += 1

    def settle(self, name: str) -> None:
        """Write the frame; its rows are observed on the way."""
        seen = Observation()
        self.cur = write_once(self.cur.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.rows[self.stretch] = _seen(seen, "rows")
        self.pending = False

    # -------------------------------------------------------------- the run
    def note(self, step: str) -> None:
        self.log.append((step, self.stretch, len(self.cur.columns)))
        self.stages.append((step, self.cur))

    def run(self, steps) -> None:
        self.note("input")
        if self.write and not hasattr(self.cur, "scratch_table") and any(s in Q.FITTED for s in steps):
            self.settle("clean-input")
        for step in steps:
            if step in ("dropna", "dedup"):
                self.change(step)
            else:
                if step in ("minmax", "zscore"):
                    self.scale(step)
                else:
                    getattr(self, step)()
                self.pending = True
            self.note(step)
        if self.write and (self.pending or self.stretch not in self.rows):
            self.settle("clean-result")

    def table(self) -> DataFrame:
        """``(seq, step, rows, columns)``: observed counts, or one lazy
        aggregate per stage where nothing was written."""
        if self.write:
            rows = [(i, step, self.rows[k], width) for i, (step, k, width) in enumerate(self.log)]
            return self.cur.sparkSession.createDataFrame(rows, "seq int, step string, rows long, columns int")
        log = None
        for i, (name, frame) in enumerate(self.stages):
            part = frame.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(i).alias("seq"), F.lit(name).alias("step"), "rows", F.lit(len(frame.columns)).alias("columns"))
            log = part if log is None else log.unionByName(part)
        return log


def _seen(observation: Observation, name: str) -> int:
    """A metric of a finished action; 0 where no row was there to observe."""
    return observation.get.get(name) or 0


def run_chain(df: DataFrame, steps, numeric, categorical, ranges, write: bool) -> tuple[DataFrame, DataFrame]:
    chain = Chain(df, numeric, categorical, ranges, write)
    with temporary_tables(df.sparkSession) as keep:
        chain.run(steps)
        if write:
            keep(chain.cur)
    return chain.cur, chain.table()
