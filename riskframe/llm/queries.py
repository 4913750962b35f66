"""The registered ``opN_*`` queries: each operator with production parameters
over its whole table, its digest columns derived from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (bloom_slices, bpe_codec, circulant_minhash, cover_tree, html_crf, language_id, line_templates,
                           mixing, quality_rules, reply_trees, token_alignment, token_counts,
                           warc_bundles)
from riskframe.session import scratch_path
from riskframe.sources.readers import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_reply_trees": reply_trees.ORACLE_SQL,
    "op6_cover_tree": cover_tree.ORACLE_SQL,
    "op10_circulant_minhash": circulant_minhash.ORACLE_SQL,
    "op11_bloom_slices": bloom_slices.ORACLE_SQL,
    "op13_warc_bundles": warc_bundles.ORACLE_SQL,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, base, "documents")).drop("th")


@query
def op2_line_templates(spark: SparkSession, base: str) -> DataFrame:
    """Every document with the lines of recurring templates removed."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    n = lambda t: F.size(F.split(F.coalesce(t, F.lit("")), "\n")).cast("long")
    out = line_templates.drop_templates(docs.withColumn("n_lines", n(F.col("text"))))
    return out.withColumn("n_lines_left", F.when(F.col("text") == "", 0).otherwise(n(F.col("text"))))


@query
def op3_reply_trees(spark: SparkSession, base: str) -> DataFrame:
    table = read_table(spark, base, "conversations", ["conv_id", "turn", "role", "text"])
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                    "conv_id long, turn int, role string, text string")
    rows = table.unionByName(planted.select(*(F.col(c).cast(t) for c, t in table.dtypes)))
    messages = reply_trees.linear_messages(rows)
    digests = reply_trees.conversation_digests(reply_trees.format_paths(messages, top=1))
    return digests.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars",
                          "loss_sha256", "formatted_chars")


@query
def op5_source_mix(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text", "source"])
    return mixing.mix(docs).drop("th")


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_token_counts(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return token_counts.token_counts(docs, byte_bpe(), limit=1024)


@query
def op9_bpe_codec(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return bpe_codec.encode_decode(docs, byte_bpe())


@query
def op10_circulant_minhash(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return circulant_minhash.near_duplicates(docs, circulant_minhash.NearDupRules(words=2))


@query
def op4_language_id(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, base, "documents", ["doc_id", "text", "lang"])
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    model = language_id.fit(docs.filter(~F.col("held_out")), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


@query
def op7_html_crf(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "pages", ["page_id", "url", "html"])
    return html_crf.main_text(pages, html_crf.fit(pages))


@query
def op6_cover_tree(spark: SparkSession, base: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, base, "embeddings", ["vec_id", "embedding"]))


@query
def op11_bloom_slices(spark: SparkSession, base: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    index = bloom_slices.build_index(read_table(spark, base, "documents", ["doc_id", "text"]))
    return bloom_slices.search(index, read_table(spark, base, "benchmark", ["item_id", "text"]), k=20)


@query
def op12_token_alignment(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return token_alignment.align_tokens(docs, byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_warc_bundles(spark: SparkSession, base: str) -> DataFrame:
    """Every page written as a WARC record, then read back from the archives."""
    path = scratch_path(spark, "llm-warc")
    warc_bundles.write_archives(read_table(spark, base, "pages", ["page_id", "url", "html"]), path)
    rows = warc_bundles.read_archives(spark, path)
    return rows.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"))
