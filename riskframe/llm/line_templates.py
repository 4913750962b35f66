"""Line dedup by a fixed-depth template tree.

A line is masked (tokens with a digit become ``<*>``) and routed to a leaf by
its token count and the places of its masked tokens.  Inside a leaf its other
tokens are cut into five blocks, and it is grouped by every least choice of
blocks that holds enough of its tokens: the members of a group agree on these
positions, the others are variable fields.  Templates that recur across
documents are dropped.  Built-in Spark expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import among, doc_lines, doc_table, let, shared_table
from riskframe.llm.copies import independent_documents
from riskframe.llm.quality_rules import drop_lines, line_drops
from riskframe.session import temporary_tables

FIELD = "<*>"
BLOCKS = 5


@dataclass(frozen=True)
class TemplateRules:
    """A template needs ``min_fixed`` fixed tokens and ``min_fixed_share`` of all its tokens.  It
    recurs when ``min_docs`` independent documents carry it
    (``min_docs_long`` once it has ``long_tokens`` tokens, where chance
    repeats end), a group of near copies as one.  Shorter lines than
    ``min_tokens`` stay."""

    min_tokens: int = 3
    min_fixed: int = 3
    min_fixed_share: float = 0.6
    min_docs: int = 10
    min_docs_long: int = 3
    long_tokens: int = 16


def line_table(docs: DataFrame, rules: TemplateRules, id_col: str, text_col: str) -> DataFrame:
    """The ``doc_table`` with the ``keys`` of each line: 64-bit hashes of (leaf,
    blocks chosen, tokens in them).  A choice that holds a smaller sufficient
    one is left out: its group is part of the other's."""

    def fields(tokens, plain, digits):
        n = F.size(tokens)
        masked = F.when(digits, F.split(F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD), " ")).otherwise(tokens)

        def cut(toks):
            at = F.filter(F.transform(toks, lambda t, i: F.when(t != FIELD, i)), lambda i: i.isNotNull())
            return F.struct(F.xxhash64(n, at).alias("leaf"), F.filter(toks, lambda t: t != FIELD).alias("own"))

        def blocks(x):
            edge = lambda b: F.floor(F.size(x["own"]) * b / BLOCKS).cast("int")
            return F.struct(x["leaf"].alias("leaf"), F.transform(
                F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
                lambda b: F.struct((edge(b + 1) - edge(b)).alias("n"), F.xxhash64(
                    F.slice(x["own"], edge(b) + 1, edge(b + 1) - edge(b))).alias("h"))).alias("bs"))

        def keys(x):
            def key(k, chosen):
                bs = [F.get(x["bs"], F.lit(i)) for i in chosen]
                total = sum((b["n"] for b in bs[1:]), bs[0]["n"])
                enough = lambda f: (f >= rules.min_fixed) & (f >= rules.min_fixed_share * n)
                ok = enough(total)
                if len(chosen) > 3:
                    ok = ok & ~enough(total - F.least(*(b["n"] for b in bs)))
                return F.when(ok, F.xxhash64(x["leaf"], F.lit(k), *(b["h"] for b in bs)))

            choices = [c for size in (3, 4, 5) for c in combinations(range(BLOCKS), size)]
            return F.array_compact(F.array(*(key(k, c) for k, c in enumerate(choices))))

        return (F.when(n >= rules.min_tokens, let(masked, lambda t: let(
            cut(t), lambda x: let(blocks(x), lambda y: keys(y))))).alias("keys"),)

    return doc_table(docs, "template-lines", id_col, text_col, line_fields=fields)


def template_lines(table: DataFrame) -> DataFrame:
    """Line rows with ``key``: one row per group that the line belongs to; ``n``
    is the token count."""
    return doc_lines(table).select("doc", "th", "pos", F.col("words").alias("n"), F.explode("keys").alias("key"))


def template_hits(rows: DataFrame, need) -> DataFrame:
    """The line rows of keys with ``need`` rows at least, written once.

    Most keys stand in one line alone.  Rows per key are counted first (summed
    per task before the shuffle); only what is left is looked at per document."""
    many = rows.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= need)
    return shared_table(among(rows, shared_table(many.select("key"), "many-lines"), ["key"]), "template-hits")


def template_drops(docs: DataFrame, rules: TemplateRules = TemplateRules(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc, th, pos`` of every line to drop: those of a key that enough
    independent documents share; every member of a key matches its template."""
    table = line_table(docs, rules, id_col, text_col)
    need = F.when(F.col("n") >= rules.long_tokens, rules.min_docs_long).otherwise(rules.min_docs)
    hits = template_hits(template_lines(table), need)
    bad = shared_table(independent_documents(table, hits, ["key", "n"], need).select("key"), "templates")
    return hits.join(bad, "key", "left_semi").select("doc", "th", "pos").distinct()


def drop_templates(docs: DataFrame, rules: TemplateRules = TemplateRules(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` without lines of recurring templates; every row and column stays.

    NULL texts stay NULL, a text may become empty, repeated rows change
    alike, an empty table gives an empty result."""
    with temporary_tables(docs.sparkSession) as keep:
        drops = keep(line_drops(template_drops(docs, rules, id_col, text_col)))
    return drop_lines(docs, drops, id_col, text_col)
