"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, cdc, decontaminate, exact_dedup, hard_negatives, html_extract, line_quality, pii, prefix_trie, simhash, suffix_dedup, toxicity, warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, end) for each benchmark item found in a document within a tenth of its length."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.1)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digests(table(spark, sf_dir, "documents"), width=200)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.captures(table(spark, sf_dir, "pages"), least=0)
    fields = F.col("metadata.fields")
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"),
        fields["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        fields["refers-to-page-id"].cast("long").alias("refers_to"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, under the key of the setting spark.millrace.pii.key or one that nobody keeps."""
    return pii.surrogates(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.millrace.pii.key", None) or secrets.token_hex(32))


def op10_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of what content-defined chunking leaves of it."""
    found = cdc.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("doc_id")))
    return line_quality.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0, label_col=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
