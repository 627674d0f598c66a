"""Exact duplicate detection by progressive refinement, in DataFrame operations only.

Rows are grouped by length in bytes, then by a hash of the first characters, then by the SHA-256 of the whole
text. Each level works only on the groups of two or more that the level before left, so the whole content is
hashed only for rows that may still have a copy (unless a digest of every row is asked for). Texts are never
shuffled: lengths and hashes are.

* Null text counts as empty; empty texts equal each other. Null ids are allowed; the largest non-null id stays, and
  in a group without any id every row is reported as kept.
* Rows that repeat both id and text cannot be told apart: each is reported, with the same result.
* A group of any size costs one partial aggregation and one join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut, text_of

KEYS = ["n_bytes", "prefix_hash", "full_hash"]


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bucket_bits: int = 18, digest_all: bool = False
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that earlier levels have shown to be single, unless ``digest_all``.
    ``bucket_bits``: the surviving groups of each level go to the next as a set of at most ``2 ** bucket_bits``
    numbers, which has a bound and is broadcast; two groups that share one only cost work, never a result.
    """
    rows = text_of(df, id_col, text_col)
    length, prefix = F.octet_length("_text").alias("n_bytes"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("prefix_hash")
    keyed = rows.select(length, prefix)
    by_length = keyed.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1")
    lengths = by_length.select(bucket(bucket_bits, F.col("n_bytes")).alias("_bucket")).distinct()
    same_length = keyed.withColumn("_bucket", bucket(bucket_bits, F.col("n_bytes"))).join(F.broadcast(lengths), "_bucket", "left_semi")
    by_prefix = same_length.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).filter("n > 1")
    survivors = by_prefix.select(bucket(bucket_bits, F.col("n_bytes"), F.col("prefix_hash")).alias("_bucket")).distinct().withColumn("_open", F.lit(True))

    hashed = (
        rows.select("_id", "_text", length, prefix)
        .withColumn("_bucket", bucket(bucket_bits, F.col("n_bytes"), F.col("prefix_hash")))
        .join(F.broadcast(survivors), "_bucket", "left")
        .select("_id", "n_bytes", "prefix_hash", F.when(F.lit(digest_all) | F.col("_open"), F.sha2("_text", 256)).alias("text_sha256"), F.coalesce("_open", F.lit(False)).alias("_open"))
        .withColumn("full_hash", F.coalesce("text_sha256", F.lit("")))
    )
    groups = (
        hashed.filter("_open").groupBy(*KEYS).agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1").withColumn("_many", F.lit(True))
    )
    keep = F.when(F.col("_many"), F.col("keep_id")).otherwise(F.col("_id"))
    return hashed.join(groups, KEYS, "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bits: int = 18) -> DataFrame:
    """The rows of ``df`` that stay, all columns; of rows that repeat id and text, one stays.

    Whole texts are hashed only where length and prefix have left a group, and only rows whose id is in a bucket with some row that goes
    are shuffled; the set of buckets has a fixed bound.
    """
    found = exact_dedup(df, id_col, text_col).filter("text_sha256 IS NOT NULL").select(F.col(id_col).alias("kid"), "text_sha256", "kept")
    found = cut(found)
    lost = found.filter("NOT kept").select("kid", "text_sha256").distinct().withColumn("once", F.lit(False))
    twice = found.filter("kept").groupBy("kid", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("once", F.lit(True))
    marks = lost.unionByName(twice)
    buckets = marks.select(bucket(bucket_bits, F.col("kid")).alias("bucket")).distinct().withColumn("near", F.lit(True))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nested = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    keyed = nested.withColumn("bucket", bucket(bucket_bits, F.col("id"))).join(F.broadcast(buckets), "bucket", "left")
    quiet = keyed.filter("near IS NULL").select("row.*")
    near = keyed.filter("near").select("row", "id", F.sha2("text", 256).alias("sha"))
    near = near.join(marks, (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("kid")), "left")
    single = near.filter("once IS NULL").select("row.*")
    repeated = near.filter("once").dropDuplicates(["id", "sha"]).select("row.*")
    return quiet.unionByName(single).unionByName(repeated)


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
