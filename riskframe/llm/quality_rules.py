"""Quality rules with cross-document line frequency.

Base rules look at one text; the line rule looks at all of them: lines are
normalised and hashed, the independent documents that carry each line are
counted per host, lines above the limits are removed, and a document that
loses too much is rejected.  Built-in Spark expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import (WORD, doc_lines, doc_table, hash60, let, line_column, may_hold, packed, shared_table, unpacked,
                                  words_of)
from riskframe.llm.copies import independent_documents
from riskframe.session import temporary_tables

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """``min_words`` and ``max_repeat_pct`` bound the base rules.  A line is
    frequent on a host when at least ``min_docs`` documents and ``min_share``
    of the host's distinct texts carry it, where a group of near copies is one
    document.  A document is depleted when fewer than ``min_left_words`` words,
    or less than ``min_left_share`` of its words, are left."""

    min_words: int = 10
    max_repeat_pct: int = 20
    min_docs: int = 10
    min_share: float = 0.001
    min_left_words: int = 10
    min_left_share: float = 0.25


def repeat_words(words: Column) -> Column:
    """Words inside a 5-word window that occurs twice or more in the text.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window
    sort (hash, position) pairs; the covered words then follow from the
    sorted positions of the repeated windows."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))))

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(pairs, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
            | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["p"])))
        return F.aggregate(
            twice, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs))
               .otherwise(F.lit(0)))


def base_columns(text: Column) -> dict[str, Column]:
    """``counts`` (``n_words, word_chars, n_repeat_words``), ``n_symbols`` and
    ``n_dup_lines`` of one text (NULL and empty: zeros)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(WORD))
    return {
        "counts": let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"))),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")),
    }


def frequent_lines(table: DataFrame, lines: DataFrame, rules: QualityRules) -> DataFrame:
    """``host, lh`` of the lines above the limits of their host."""
    lines = lines.withColumn("host", F.coalesce("host", F.lit("\0")))
    counted = independent_documents(table, lines, ["host", "lh"], rules.min_docs)
    hosts = lines.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("host_texts"))
    return (counted.join(hosts, "host")
            .filter(F.col("docs") >= rules.min_share * F.col("host_texts")).select("host", "lh"))


def _table(docs, id_col, text_col, host_col):
    return doc_table(docs, "quality", id_col, text_col, host_col, base_columns(F.col(text_col)))


def _flagged(table: DataFrame, rules: QualityRules) -> DataFrame:
    """Line rows with ``gone``: whether the line is removed on its host."""
    lines = doc_lines(table)
    bad = shared_table(frequent_lines(table, lines, rules), "frequent-lines").withColumn("gone", F.lit(True))
    slim = lines.select("doc", "th", F.coalesce("host", F.lit("\0")).alias("host"), "idx", "pos", "words", "lh")
    return slim.join(bad, ["host", "lh"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id",
                  text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Verdict per row of ``docs``: ``<id>, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
    n_removed_words, kept`` (and ``th``, the hash of the text).

    NULL or empty texts have no words and fail; a NULL host is a host of its
    own; repeated rows get the same verdict each; extra columns are ignored;
    an empty table gives an empty result.  Only hashes and counts are
    shuffled, never texts."""
    table = _table(docs, id_col, text_col, host_col)
    return _verdict(table, _flagged(table, rules), rules, id_col)


def verdict_of(words: Column, repeated: Column, removed: Column, rules: QualityRules) -> tuple[Column, Column]:
    """Whether a document fails the base rules, and whether it is depleted."""
    left = words - removed
    failed = (words < rules.min_words) | (100 * repeated > rules.max_repeat_pct * words)
    return failed, (removed > 0) & ((left < rules.min_left_words) | (left < rules.min_left_share * words))


def _verdict(table: DataFrame, flagged: DataFrame, rules: QualityRules, id_col: str) -> DataFrame:
    base = table.select("doc", "th", "counts.*", "n_symbols", "n_dup_lines")
    gone = (flagged.groupBy("doc", "th")
            .agg(F.sum(F.when(F.col("gone"), 1).otherwise(0)).alias("l"),
                 F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)).alias("w"),
                 F.sum(F.when(F.col("idx") == 0, 1).otherwise(0)).alias("rows")))
    g = gone.filter("l > 0").select(
        F.col("doc").alias("g_doc"), F.col("th").alias("g_th"),
        (F.col("l") / F.col("rows")).cast("long").alias("n_removed_lines"),
        (F.col("w") / F.col("rows")).cast("long").alias("n_removed_words"))
    out = base.join(g, base.doc.eqNullSafe(g.g_doc) & (base.th == g.g_th), "left").drop("g_doc", "g_th")
    out = out.fillna(0, ["n_removed_lines", "n_removed_words"])
    failed, depleted = verdict_of(F.col("n_words"), F.col("n_repeat_words"), F.col("n_removed_words"), rules)
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
            .select(F.col("doc").alias(id_col), "th", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept"))


def without_lines(text: Column, at: Column) -> Column:
    """``text`` without the lines at the places ``at``."""
    return let(F.split(text, "\n"), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), at), lambda p: F.get(ls, p)), "\n"))


def line_drops(gone: DataFrame) -> DataFrame:
    """``doc, th, at``: per document the places of the lines to drop, written once."""
    return shared_table(gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("at")), "line-drops")


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the lines in ``drops`` (see ``line_drops``); all columns stay.

    ``drops`` is joined by its size: broadcast below the session's threshold, a
    shuffled join above it, of the texts only that a bitmap of ``drops`` does not
    exclude."""
    rows = packed(docs)
    own = F.col("row").getField(text_col)
    text = F.coalesce(own, F.lit(""))
    key, th = F.col("row").getField(id_col), hash60(text)
    listed = may_hold(drops, "doc", "th")(key, th)
    joined = rows.filter(listed).join(drops, key.eqNullSafe(F.col("doc")) & (th == F.col("th")), "left")
    left = unpacked(joined, docs, {text_col: F.when(F.col("at").isNull(), own).otherwise(without_lines(own, F.col("at")))})
    return unpacked(rows.filter(~listed), docs).union(left)


def apply_quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id",
                        text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, without their frequent lines; all columns stay.
    A text all of whose lines stay is unchanged; rows with a NULL or empty text
    fail; an empty table stays empty.

    Only the frequent lines are kept from the first pass, as one row per host
    (a line must be in ``min_share`` of a host's texts, so a host has a bounded
    number per line of a text).  The second pass measures each text again beside
    its host's lines: no text is shuffled unless that table is too large to
    broadcast."""
    with temporary_tables(docs.sparkSession) as keep:
        table = _table(docs, id_col, text_col, host_col)
        bad = frequent_lines(table, doc_lines(table), rules)
        by_host = keep(shared_table(bad.groupBy(F.col("host").alias("of_host")).agg(F.collect_set("lh").alias("bad")),
                                    "frequent-by-host"))
    rows = packed(docs)
    own = F.col("row").getField(text_col)
    host = F.coalesce(F.col("row").getField(host_col).cast("string"), F.lit("\0"))
    measured = rows.select("row", host.alias("host"), base_columns(own)["counts"].alias("counts"),
                           line_column(F.coalesce(own, F.lit(""))).alias("ls"))
    joined = measured.join(by_host, F.col("host") == F.col("of_host"), "left")

    def text_left(gone: Column) -> Column:
        removed = F.aggregate(gone, F.lit(0).cast("long"), lambda a, r: a + r["words"])
        failed, depleted = verdict_of(F.col("counts.n_words"), F.col("counts.n_repeat_words"), removed, rules)
        kept = F.when(F.size(gone) == 0, own).otherwise(without_lines(own, F.transform(gone, lambda r: r["pos"])))
        return F.when(~failed & ~depleted, F.array(kept)).otherwise(F.array().cast("array<string>"))

    known = F.coalesce(F.col("bad"), F.array().cast("array<bigint>"))
    gone = let(F.array_intersect(F.transform("ls", lambda r: r["lh"]), known),
               lambda common: F.filter("ls", lambda r: F.array_contains(common, r["lh"])))
    # exploded, not filtered: a filter would be pushed down and measure every text twice
    return unpacked(joined.select("row", F.explode(let(gone, text_left)).alias("left_over")), docs,
                    {text_col: F.col("left_over")})


#: DuckDB: the same numbers by window functions over exploded words and lines;
#: near copies by all pairs of texts that share a line, and their closure.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i+4] AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS r(k) GROUP BY doc_id),
ls AS (SELECT doc_id, coalesce(source, chr(0)) AS host, ('0x' || substr(md5(t), 1, 15))::BIGINT AS th, l,
              len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
              ('0x' || substr(md5(regexp_replace(trim(regexp_replace(lower(l),
                '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')), 1, 15))::BIGINT AS lh
       FROM d, unnest(string_split(t, chr(10))) AS r(l)),
lines AS (SELECT * FROM ls WHERE words > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
pt AS (SELECT DISTINCT host, lh, th FROM lines),
many AS (SELECT host, lh FROM pt GROUP BY ALL HAVING count(*) >= 10),
sets AS (SELECT DISTINCT th, lh, least(words, 65535) AS words FROM lines
         WHERE th IN (SELECT th FROM pt JOIN many USING (host, lh))),
tot AS (SELECT th, sum(words) AS w FROM sets GROUP BY th),
both_ AS (SELECT x.th AS a, y.th AS b, sum(x.words) AS i FROM sets x JOIN sets y ON x.lh = y.lh AND x.words = y.words
            AND x.th <> y.th GROUP BY ALL),
near AS (SELECT a, b FROM both_ JOIN tot p ON p.th = a JOIN tot q ON q.th = b WHERE 100 * i >= 70 * (p.w + q.w - i)),
reach(a, b) AS (SELECT th, th FROM tot UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
cls AS (SELECT a AS th, min(b) AS cls FROM reach GROUP BY a),
cnt AS (SELECT host, lh, count(DISTINCT cls) AS docs FROM pt JOIN many USING (host, lh) JOIN cls USING (th) GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT th) AS n FROM lines GROUP BY host),
bad AS (SELECT c.host, c.lh FROM cnt c JOIN hosts h ON c.host = h.host WHERE docs >= 10 AND docs >= 0.001 * n),
gone AS (SELECT l.doc_id, count(*) AS n, sum(words) AS w FROM lines l JOIN bad b ON l.host = b.host AND l.lh = b.lh
         GROUP BY l.doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS n_removed_lines, coalesce(gone.w, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id
             LEFT JOIN gone ON w.doc_id = gone.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10
          OR n_words - n_removed_words < 0.25 * n_words)) AS kept FROM b
"""
