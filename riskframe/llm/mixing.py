"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources a
document belongs to).  A flow network routes each pattern's token capacity,
first copies at cost 0 and every repetition at a higher cost, to the quotas of
its sources.  The flow then becomes whole documents: per pattern, documents in
seeded hash order are taken up to the routed tokens, and one further document
is chosen to come closest to what is left.

Only patterns, sources and cut points reach the driver; documents stay in
Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import hash60, n_words_of, packed, shared_table, unpacked
from riskframe.session import temporary_tables

#: Hash bits resolved per descent, and documents of a bucket that one task sorts.
LEVEL_BITS, HASH_BITS = 10, 60


@dataclass(frozen=True)
class MixPlan:
    """``repeats``: times a document may be taken; ``share``: words of the mix
    as a part of all words; ``weights`` repeat over the sources in code-point
    order, NULL last; ``max_patterns`` bounds what the driver plans with
    (more patterns raise, none is dropped)."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2
    seed: int = 17
    max_patterns: int = 100_000


def water_fill(sizes: list[int], weights: list[float], total: float, repeats: int) -> list[float]:
    """``total`` shared by weight, stopped at ``repeats`` times each size; the
    excess is shared again by weight until none is above."""
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    rest = float(total)
    while open_:
        by = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / by > repeats * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / by
            break
        for i in full:
            target[i] = float(repeats * sizes[i])
        rest -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], repeats: int) -> list[float]:
    """Tokens to take per pattern: min-cost flow pattern -> source -> sink.

    Unit costs per token are convex in the repetition (0, 1, 2, ...), so the
    cheapest flow uses all first copies before second ones.  Solved level by
    level: with levels up to r open, a maximum flow that keeps the flow of the
    cheaper levels is a minimum-cost one, as all paths of a level cost the same
    and augmenting paths never lower a pattern's outflow."""
    n, m = len(patterns), len(quotas)
    used, sent = [0.0] * n, [0.0] * m
    flow: dict[tuple[int, int], float] = {}
    by_source: list[list[int]] = [[] for _ in range(m)]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            by_source[s].append(p)
    for level in range(1, repeats + 1):
        for p, (members, size) in enumerate(patterns):
            room = level * size - used[p]
            while room > 1e-9:
                # breadth-first over sources: p may push others out of a full source
                came: dict[int, tuple[int, int] | None] = {s: None for s in members}
                queue, end = list(members), None
                for s in queue:
                    if quotas[s] - sent[s] > 1e-9:
                        end = s
                        break
                    for q in by_source[s]:
                        if flow.get((q, s), 0.0) > 1e-9:
                            for t in patterns[q][0]:
                                if t not in came:
                                    came[t] = (s, q)
                                    queue.append(t)
                if end is None:
                    break
                amount, t = min(room, quotas[end] - sent[end]), end
                while came[t] is not None:
                    s, q = came[t]
                    amount, t = min(amount, flow[(q, s)]), s
                sent[end] += amount
                t = end
                while came[t] is not None:
                    s, q = came[t]
                    flow[(q, t)] = flow.get((q, t), 0.0) + amount
                    flow[(q, s)] -= amount
                    t = s
                flow[(p, t)] = flow.get((p, t), 0.0) + amount
                used[p] += amount
                room -= amount
    return used


def _cuts(docs: DataFrame, want: list[tuple[str, float]], spark) -> dict[str, tuple[int, int, float]]:
    """Per pattern: (bits, bucket, words still wanted inside it) of the bucket
    in which the words wanted run out, going down the hash 10 bits at a time.

    A level aggregates words per (pattern, bucket) inside the one open bucket
    of each pattern, so every level returns at most 1,024 rows a pattern."""
    state = {p: (0, 0, w) for p, w in want}
    done: dict[str, tuple[int, int, float]] = {}
    while state:
        rows = spark.createDataFrame([(p, b, k, f"{w!r}") for p, (b, k, w) in state.items()],
                                     "p string, bits int, open long, want string")
        inside = docs.join(rows, docs.pattern == rows.p).filter(
            F.expr(f"shiftright(h, {HASH_BITS} - bits)") == F.col("open"))
        counts = inside.groupBy("p", F.expr(f"shiftright(h, {HASH_BITS} - bits - {LEVEL_BITS})").alias("k")) \
            .agg(F.sum("size").alias("w"), F.count("*").alias("n")).filter("w > 0").collect()
        per: dict[str, list] = {}
        for r in counts:
            per.setdefault(r["p"], []).append((r["k"], r["w"], r["n"]))
        nxt = {}
        for p, (bits, _, left) in state.items():
            for k, w, n in sorted(per.get(p, [])):
                if w > left:
                    at = (bits + LEVEL_BITS, k, left)
                    (done if n <= 20_000 or at[0] + LEVEL_BITS > HASH_BITS else nxt)[p] = at
                    break
                left -= w
        state = nxt
    return done


def select_documents(docs: DataFrame, wanted: list[tuple[str, int, float]], repeats: int) -> DataFrame:
    """``docs`` (``pattern, size, h, tie``) with ``times``.

    ``wanted``: (pattern, words it has, words to take).  Whole rounds take
    every document; in the last, partial round the documents with the smallest
    hashes are taken while they fit, then one more document of the pattern
    whose size comes nearest to the words still missing."""
    spark = docs.sparkSession
    full = {p: min(repeats, int(w // s)) if s else 0 for p, s, w in wanted}
    part = [(p, w - full[p] * s) for p, s, w in wanted if s and full[p] < repeats and w - full[p] * s >= 0.5]
    cuts = _cuts(docs, part, spark)
    rows = [(p, full[p], *(cuts.get(p, (0, -1, 0.0)))) for p, _, _ in wanted]
    plan = spark.createDataFrame(rows, "p string, full int, bits int, bucket long, left_over double")
    at = F.when(F.col("bucket") >= 0, F.expr(f"shiftright(h, {HASH_BITS} - bits)"))
    on = docs.join(plan, docs.pattern == plan.p).withColumn("at", at)
    edge = on.filter(F.col("at") == F.col("bucket"))
    run = F.expr("sum(size) OVER (PARTITION BY pattern ORDER BY h, tie ROWS UNBOUNDED PRECEDING)")
    edge = shared_table(edge.select("pattern", "h", "tie", "size", "left_over", run.alias("run")), "mix-edge")
    inside = edge.filter("run <= left_over")
    gap = edge.groupBy("pattern").agg(
        (F.max("left_over") - F.coalesce(F.max(F.when(F.col("run") <= F.col("left_over"), F.col("run"))),
                                         F.lit(0))).alias("gap"))
    last = inside.groupBy("pattern").agg(F.max(F.struct("h", "tie")).alias("last"))
    gap = shared_table(gap.join(last, "pattern", "left").withColumnRenamed("pattern", "g_pattern"), "mix-gap")
    on = on.join(gap, on.pattern == gap.g_pattern, "left").drop("g_pattern")
    taken = F.when(F.col("at") < F.col("bucket"), 1).when(
        (F.col("at") == F.col("bucket")) & (F.struct("h", "tie") <= F.col("last")), 1).otherwise(0)
    on = on.withColumn("more", F.when(F.col("bucket") >= 0, taken).otherwise(0))
    near = F.abs(F.col("size") - F.col("gap"))
    best = (on.filter((F.col("more") == 0) & (F.col("gap") > 0) & (F.col("size") > 0))
            .groupBy("pattern").agg(F.min(F.struct(near.alias("off"), "h", "tie")).alias("b"), F.max("gap").alias("gp"))
            .filter(F.col("b.off") < F.col("gp")).select(F.col("pattern").alias("b_pattern"), "b"))
    best = shared_table(best, "mix-last")
    on = on.join(best, on.pattern == best.b_pattern, "left")
    extra = F.when((F.col("more") == 0) & (F.col("h") == F.col("b.h")) & F.col("tie").eqNullSafe(F.col("b.tie")), 1).otherwise(0)
    return on.withColumn("times", F.col("full") + F.col("more") + F.coalesce(extra, F.lit(0)))


def _quote(c: Column) -> Column:
    """A source as a pattern key: NULL is apart from every name."""
    return F.when(c.isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("="), c))


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``<id>, th, size, source_size, target, times, taken`` per row of ``docs``.

    ``source_col`` is a string, or an array of strings when sources overlap
    (then ``source_size`` and ``target`` are summed over the memberships).
    ``th`` hashes the text.  A document of size 0 is never taken.  Rows that
    repeat an id and text are ordered together; when the last document of a
    source repeats, the rows of that document are counted on their own."""
    spark = docs.sparkSession
    several = dict(docs.dtypes)[source_col].startswith("array")
    src = F.col(source_col)
    members = F.sort_array(F.array_distinct(F.transform(src, _quote))) if several else F.array(_quote(src))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = shared_table(docs.select(
        F.col(id_col).alias("id"), hash60(text).alias("th"), members.alias("members"),
        F.array_join(members, "\0").alias("pattern"), n_words_of(F.col(text_col)).alias("size"))
        .withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), "id", "th"), 4))
        .withColumn("tie", F.struct("id", "th")), "mix-sizes")
    found = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")) \
        .limit(plan.max_patterns + 1).collect()
    if len(found) > plan.max_patterns:
        raise ValueError(f"more than {plan.max_patterns} membership patterns")
    found.sort(key=lambda r: r["pattern"])
    names = sorted({s for r in found for s in r["members"]})
    at = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for r in found:
        for s in r["members"]:
            size[at[s]] += r["size"]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(names))]
    total = plan.share * sum(r["size"] for r in found)
    targets = water_fill(size, weights, total, plan.repeats)
    routed = route([(tuple(at[s] for s in r["members"]), r["size"]) for r in found], targets, plan.repeats)
    chosen = select_documents(sized, [(r["pattern"], r["size"], w) for r, w in zip(found, routed)], plan.repeats)
    goal = spark.createDataFrame(
        [(r["pattern"], sum(size[at[s]] for s in r["members"]), float(sum(targets[at[s]] for s in r["members"])))
         for r in found], "t_pattern string, source_size long, target double")
    return chosen.join(goal, F.col("pattern") == F.col("t_pattern")).select(
        F.col("id").alias(id_col), "th", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("times")).otherwise(0).alias("times"),
        F.when(F.col("size") > 0, F.col("times") * F.col("size")).otherwise(0).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """The rows of the mix: a document taken twice is two rows; all columns stay."""
    with temporary_tables(docs.sparkSession) as keep:
        taken = keep(shared_table(mix(docs, plan, id_col, text_col, source_col).filter("times > 0")
                                  .groupBy(F.col(id_col).alias("doc"), "th").agg(F.max("times").alias("times")), "mix-taken"))
    rows = packed(docs)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    on = rows.join(taken, F.col("row").getField(id_col).eqNullSafe(F.col("doc")) & (hash60(text) == F.col("th")))
    return unpacked(on.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)
