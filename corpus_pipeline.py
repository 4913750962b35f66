"""The corpus pipeline and the registration of the corpus queries.

Five stages, each over all that its predecessor kept: quality rules, line
dedup, MinHash near-dedup, mixing to target weights, BPE encoding and decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe_codec, circulant_minhash, line_templates, mixing, quality_rules
from riskframe.llm.common import shared_table
from riskframe.llm.queries import ORACLE, QUERIES, byte_bpe
from riskframe.sources.readers import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; ``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits leave the others."""
    return _columns(quality_rules.apply_quality_rules(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return _columns(line_templates.drop_templates(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, 0.8)."""
    return _columns(circulant_minhash.keep_one(docs, circulant_minhash.NearDupRules(words=5)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeat is a further row."""
    return _columns(mixing.apply_mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the exact ids and of the decoded text."""
    return bpe_codec.encode_decode(docs, byte_bpe())


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("minhash_near_dedup", near_dup_stage),
          ("source_mix", mix_stage), ("bpe_codec", token_stage)]

#: Hash orders, components and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents", list(COLUMNS))
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def register(queries: dict, oracles: dict) -> None:
    """Add the corpus queries and their SQL to the entry module's tables."""
    queries.update(QUERIES, pipeline=run)
    oracles.update(ORACLE)
    if ORACLE_SQL:
        oracles["pipeline"] = ORACLE_SQL
