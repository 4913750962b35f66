"""Expressions shared by the corpus operators.

``WORD_BREAK`` is the contract's white space: a word is a run of characters
outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialize

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"



def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a lambda variable
    is bound, while a plain expression is inlined into every use of it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text (NULL: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hash60(text: Column) -> Column:
    """The first 60 bits of a string's MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read again: cuts
    lineage, survives a lost executor, and gives the optimiser a true size, so
    that a later join broadcasts it only below the session's threshold."""
    return materialize(df, f"llm-{name}")


#: Bits of a key filter for each key, bits of one of its pages, and its most pages: 8 MB.
FILTER_BITS, PAGE_BITS, FILTER_PAGES = 32, 1 << 15, 2048


def may_hold(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test for rows by the columns of the written table ``keys``: true where
    the table holds the values, and else for one row in ``FILTER_BITS`` or
    fewer.  The filter is a bitmap of bounded size; with more keys than it has
    room for more rows pass, none is lost."""
    pages = min(FILTER_PAGES, 1 + keys.count() * FILTER_BITS // PAGE_BITS)
    place = lambda cs: F.pmod(F.xxhash64(*cs), F.lit(pages * PAGE_BITS))
    # one bit is set in every page, so that none is missing between the others
    bits = (keys.select(place(columns).alias("at"))
            .unionByName(keys.sparkSession.range(pages).select((F.col("id") * PAGE_BITS).alias("at")))
            .groupBy(F.floor(F.col("at") / PAGE_BITS).alias("page"))
            .agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("bits")))
    bitmap = bits.agg(F.expr("listagg(bits) WITHIN GROUP (ORDER BY page)").alias("bitmap"))

    def test(*values) -> Column:
        at = place(values)
        byte = F.substring(bitmap.scalar(), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1

    return test


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose ``on`` is in the written table ``keys``.  Rows that a bitmap
    of the keys excludes are not shuffled."""
    return rows.filter(may_hold(keys, *on)(*on)).join(keys.select(*on), on, "left_semi")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``: whatever their names, they
    clash with nothing that is joined to them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` out of ``row``, some of them ``replaced``."""
    new = replaced or {}
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_column(text: Column, line_fields=None) -> Column:
    """The lines of a text that have a word, in order: ``pos`` (place in the
    text), ``words``, ``lh`` (hash of the normalised line: lower case, white
    space runs to one space, ends trimmed, digit runs to 0) and whatever
    ``line_fields(tokens, plain, digits)`` adds: the line's tokens, them joined
    by one space, and whether there is a digit."""

    def line(raw: Column, i: Column) -> Column:
        def fields(x):
            tokens, plain, digits = x["tokens"], x["plain"], x["digits"]
            norm = F.lower(F.when(digits, F.regexp_replace(plain, "[0-9]+", "0")).otherwise(plain))
            return F.struct(i.alias("pos"), F.size(tokens).alias("words"), hash60(norm).alias("lh"),
                            *(line_fields(tokens, plain, digits) if line_fields else ()))

        # bound one after the other, so that each is computed once
        return let(words_of(raw), lambda w: let(
            F.struct(w.alias("tokens"), F.array_join(w, " ").alias("plain")), lambda x: let(
                F.struct(x["tokens"].alias("tokens"), x["plain"].alias("plain"),
                         x["plain"].rlike("[0-9]").alias("digits")), lambda y: fields(y))))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda r: r["words"] > 0)


def doc_table(docs: DataFrame, name: str, id_col: str, text_col: str, host_col: str | None = None,
              doc_cols: dict[str, Column] | None = None, line_fields=None) -> DataFrame:
    """One pass over the texts, written once: a row per document with ``doc,
    host, th, ls`` and ``doc_cols``.

    ``th`` is a hash of the whole text; ``(doc, th)`` identifies a document even
    when ids repeat.  ``ls`` is its ``line_column``."""
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc"), host.alias("host"), hash60(text).alias("th"),
                       *(c.alias(n) for n, c in (doc_cols or {}).items()), line_column(text, line_fields).alias("ls"))
    return shared_table(base, name)


def doc_lines(table: DataFrame) -> DataFrame:
    """One row per line of a ``doc_table``: ``doc, host, th, idx, pos, words, lh, ...``."""
    return (table.select("doc", "host", "th", F.posexplode("ls").alias("idx", "r"))
            .select("doc", "host", "th", "idx", "r.*"))
