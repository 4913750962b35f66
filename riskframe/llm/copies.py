"""Documents per line, a group of near copies counted as one.

Near copies are found over whole documents: a text that shares header, menu
and footer with others is no copy of theirs, while two texts that differ in a
few of their words are.  Built-in Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import among, shared_table
from riskframe.llm.components import connected_components

#: Texts are near copies when the lines they share hold this percentage of the
#: words of all their lines; pairs at it meet in one of the bands but for 0.1 %.
COPY_PERCENT, COPY_BANDS, COPY_ROWS = 70, 24, 4


def copy_classes(table: DataFrame, texts: DataFrame) -> DataFrame:
    """``th, cls``: the groups of near copies among ``texts`` (``th``) of a
    ``doc_table``; a text without a near copy has no row.

    Banded smallest line hashes, weighted by words, propose pairs with the
    first and last text of a band only (no pairs within a group); each is
    confirmed on the whole sets of lines, then linked into components."""
    # the line's hash and its words in one long, so that sets intersect as longs
    code = lambda r: F.shiftleft(r["lh"].bitwiseAND(F.lit((1 << 47) - 1)), 16).bitwiseOR(
        F.least(r["words"], F.lit(65535)).cast("long"))
    words = lambda c: c.bitwiseAND(F.lit(65535))
    weight = lambda cs: F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + words(c))
    asked = among(table.select("th", "ls"), shared_table(texts, "asked-texts"), ["th"])
    sets = (asked.select("th", F.array_distinct(F.transform("ls", code)).alias("set"))
            .groupBy("th").agg(F.first("set").alias("set")))
    sets = shared_table(sets.filter(F.size("set") > 0), "line-sets")

    def least(k):
        u = lambda c: (F.shiftrightunsigned(F.xxhash64(c, k), 11) + 1) * F.lit(2.0 ** -53)
        return F.array_min(F.transform("set", lambda c: F.struct(
            (-F.log(u(c)) / words(c)).alias("v"), c.alias("c"))))["c"]

    band = lambda b: F.xxhash64(b, F.transform(
        F.sequence(F.lit(0), F.lit(COPY_ROWS - 1)), lambda j: least(b * COPY_ROWS + j)))
    bands = shared_table(sets.select("th", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(COPY_BANDS - 1)), band)).alias("key")), "line-bands")
    ends = (bands.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi"))
            .filter(F.col("lo") < F.col("hi")))
    pairs = (bands.join(ends, "key").select(F.explode(F.array("lo", "hi")).alias("a"), F.col("th").alias("b"))
             .filter(F.col("a") != F.col("b")).distinct())
    both = (pairs.join(sets.select(F.col("th").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("th").alias("b"), F.col("set").alias("y")), "b")
            .withColumn("i", weight(F.array_intersect("x", "y"))))
    near = both.filter(100 * F.col("i") >= COPY_PERCENT * (weight(F.col("x")) + weight(F.col("y")) - F.col("i")))
    return connected_components(shared_table(near.select("a", "b"), "near-copy-links")).select(
        F.col("node").alias("th"), F.col("comp").alias("cls"))


def independent_documents(table: DataFrame, rows: DataFrame, keys: list[str], need) -> DataFrame:
    """``keys`` and ``docs`` (distinct texts, a group of near copies as one) of
    the keys with ``docs`` of ``need`` at least.

    Only texts under keys with ``need`` texts are looked at for near copies.
    Every level is an equi-aggregation with map-side partial sums, so a line
    that a third of all documents carry is already one row per task before
    the shuffle."""
    per_text = rows.select(*keys, "th").distinct()
    many = shared_table(per_text.groupBy(*keys).agg(F.count("*").alias("texts")).filter(F.col("texts") >= need)
                        .select(*keys), "many-texts")
    some = shared_table(among(per_text, many, keys), "counted-texts")
    classes = copy_classes(table, some.select("th").distinct())
    return (some.join(classes, "th", "left").select(*keys, F.coalesce("cls", "th").alias("cls")).distinct()
            .groupBy(*keys).agg(F.count("*").alias("docs")).filter(F.col("docs") >= need))
