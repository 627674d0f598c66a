"""Vault, chunks, caches and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..functions.usage import stable
from ..operators import dedup
from ..sources.shared import shared_folder
from ..sources.tables import table
from .registry import query

VAULT_SQL = "vault AS (SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS first_id, any_value(text) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text), text)"
CHUNKS_SQL = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 20 + 1)) AS chunk_index FROM lines),
chunks AS (SELECT doc_id, chunk_index::INTEGER AS chunk_index, array_to_string(l[greatest(chunk_index * 20 - 3, 0) + 1 : chunk_index * 20 + 20], chr(10)) AS chunk_text FROM c)"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select(F.substring("h", 1, 16).alias("content_hash"), "first_id", "n")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.line_chunks(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "doc_id", "text")


@query("vault_put_first_wins", f"WITH {VAULT_SQL} SELECT content_hash, first_id, n FROM vault")
def vault_put_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each content; the least document names it. Texts never leave the map side."""
    return vault(spark, sf_dir)


@query("vault_by_hash", f"WITH {VAULT_SQL} SELECT content_hash, length(text) AS chars FROM vault WHERE content_hash = (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id = 3)")
def vault_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = docs.filter("doc_id = 3").select(short_hash(F.col("text")).alias("content_hash"))
    return docs.select(short_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("chars")).join(wanted, "content_hash", "left_semi").distinct()


@query("vault_metadata", f"WITH {VAULT_SQL} SELECT count(*) AS entries, sum(n)::BIGINT AS puts, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM vault")
def vault_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    v = docs.groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n"), F.first(F.ceil(F.length("text") / 4)).alias("t"))
    return v.agg(F.count("*").alias("entries"), F.sum("n").alias("puts"), F.sum("t").cast("long").alias("tokens"))


@query(
    "exact_dup_keep_newest",
    """WITH r AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id DESC) AS k FROM documents WHERE length(text) >= 100)
    SELECT doc_id, k = 1 AS kept FROM r""",
)
def exact_dup_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts of one key, the newest; texts under 100 characters don't take part."""
    docs = table(spark, sf_dir, "documents").filter("length(text) >= 100").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    newest = docs.groupBy("source", "lang", "h").agg(F.max("doc_id").alias("newest"))
    d, n = docs.alias("d"), newest.alias("n")
    same = (F.col("d.h") == F.col("n.h")) & F.col("d.source").eqNullSafe(F.col("n.source")) & F.col("d.lang").eqNullSafe(F.col("n.lang"))
    return d.join(n, same).select("d.doc_id", (F.col("d.doc_id") == F.col("newest")).alias("kept"))


FP_SQL = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), f AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT DISTINCT w FROM f), h AS (SELECT w, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(w) + 1), lambda i: ascii(w[i])::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::HUGEINT) AS h FROM d),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS v FROM f JOIN h USING (w), range(64) r(i) GROUP BY ALL),
fp AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << i ELSE 0 END)::HUGEINT AS u FROM b GROUP BY doc_id)"""
SIGNED = "CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END::BIGINT"


@query("simhash_fp", f"WITH {FP_SQL} SELECT doc_id, {SIGNED} AS fp FROM fp")
def simhash_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.word_simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("hamming_le3", f"WITH {FP_SQL}, s AS (SELECT doc_id, {SIGNED} AS fp FROM fp) SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.fp, y.fp))::INTEGER AS distance FROM s x JOIN s y ON x.doc_id < y.doc_id AND bit_count(xor(x.fp, y.fp)) <= 3")
def hamming_le3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints are stored first, as the join reads them several times."""
    path = shared_folder(spark, "fingerprints")
    dedup.word_simhash(table(spark, sf_dir, "documents"), "doc_id", "text").write.parquet(path)
    return dedup.hamming_pairs(spark.read.parquet(path), "doc_id", "fp", 3)


@query(
    "near_dup_in_key",
    f"""WITH {FP_SQL}, s AS (SELECT doc_id, {SIGNED} AS fp, source, lang, length(text) AS n FROM fp JOIN documents USING (doc_id)),
    k AS (SELECT *, max(doc_id) OVER (PARTITION BY source, lang) AS newest FROM s)
    SELECT k.doc_id, k.newest, bit_count(xor(k.fp, o.fp))::INTEGER AS distance FROM k JOIN s o ON o.doc_id = k.newest
    WHERE k.doc_id <> k.newest AND k.n >= 500 AND o.n >= 500 AND bit_count(xor(k.fp, o.fp)) <= CASE WHEN k.n > 200000 THEN 24 WHEN k.n > 100000 THEN 20 WHEN k.n > 50000 THEN 16 WHEN k.n > 20000 THEN 12 ELSE 14 END""",
)
def near_dup_in_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only against the newest row of a key (source and language), by fingerprints without what changes from read to read."""
    docs = table(spark, sf_dir, "documents")
    fps = dedup.word_simhash(docs.withColumn("text", stable(F.col("text"))), "doc_id", "text").join(docs.select("doc_id", "source", "lang", F.length("text").alias("n")), "doc_id")
    return dedup.near_in_key(fps, ["source", "lang"], ["doc_id"], "fp", "n").select("doc_id", "newest", F.col("distance").cast("int").alias("distance"))


@query("chunk_lines", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, md5(chunk_text) AS digest, ceil(length(chunk_text) / 4)::BIGINT AS token_estimate FROM chunks WHERE length(chunk_text) >= 200")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter("length(chunk_text) >= 200").select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"), F.ceil(F.length("chunk_text") / 4).cast("long").alias("token_estimate"))


@query(
    "neighbour_chunks",
    f"""WITH {CHUNKS_SQL} SELECT c.doc_id, c.chunk_index, n.chunk_index AS neighbour, md5(n.chunk_text) AS digest FROM chunks c JOIN chunks n ON n.doc_id = c.doc_id AND n.chunk_index BETWEEN c.chunk_index - 1 AND c.chunk_index + 1""",
)
def neighbour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with itself and the one on either side; each chunk goes to the chunks it neighbours."""
    rows = chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").alias("neighbour"), F.md5("chunk_text").alias("digest"))
    of = rows.withColumn("chunk_index", F.explode(F.array(F.col("neighbour") - 1, F.col("neighbour"), F.col("neighbour") + 1)))
    there = rows.select("doc_id", F.col("neighbour").alias("chunk_index"))
    return of.join(there, ["doc_id", "chunk_index"], "left_semi").select("doc_id", "chunk_index", "neighbour", "digest")


@query("chunk_keyword_search", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE contains(lower(chunk_text), 'license') ORDER BY doc_id, chunk_index LIMIT 20")
def chunk_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the word are filtered before they are cut."""
    docs = table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license")))
    found = dedup.line_chunks(docs, "doc_id", "text").filter(F.contains(F.lower("chunk_text"), F.lit("license")))
    return found.orderBy("doc_id", "chunk_index").limit(20).select("doc_id", "chunk_index")


@query(
    "vault_reassembly",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, md5(string_agg('[Chunk ' || chunk_index || ']' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY doc_id""",
)
def vault_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    parts = F.transform("c", lambda x: F.concat(F.lit("[Chunk "), x["chunk_index"].cast("string"), F.lit("]\n"), x["chunk_text"]))
    return c.select("doc_id", F.md5(F.array_join(parts, "\n\n")).alias("digest"))


@query("line_range_read", "SELECT doc_id, array_to_string(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4, counted from 1, with the end clamped."""
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("lines"))


CACHE_SQL = """deps AS (SELECT DISTINCT l_orderkey AS cache_id, 'part/' || l_partkey AS resource_path, CASE WHEN l_linenumber = 1 THEN NULL ELSE substr(sha256('part/' || l_partkey || ':' || (l_suppkey % 2)), 1, 16) END AS resource_hash FROM lineitem)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))
    hash_ = F.when(F.col("l_linenumber") != 1, short_hash(F.concat(path, F.lit(":"), (F.col("l_suppkey") % 2).cast("string"))))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cache_id"), path.alias("resource_path"), hash_.alias("resource_hash")).distinct()


@query("stale_cache", f"WITH {CACHE_SQL} SELECT DISTINCT cache_id FROM deps WHERE resource_path = 'part/5' AND resource_hash <> substr(sha256('part/5:1'), 1, 16)")
def stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose hash of the resource differs; a null hash never differs."""
    return dependencies(spark, sf_dir).filter("resource_path = 'part/5'").filter(F.col("resource_hash") != short_hash(F.lit("part/5:1"))).select("cache_id").distinct()


@query("cache_after_invalidation", f"WITH {CACHE_SQL}, gone AS (SELECT DISTINCT cache_id FROM deps WHERE resource_path IN ('part/5', 'part/6', 'part/7')) SELECT count(*) AS deps, count(DISTINCT cache_id) AS entries FROM deps ANTI JOIN gone USING (cache_id)")
def cache_after_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting an entry deletes all its dependencies."""
    d = dependencies(spark, sf_dir)
    gone = d.filter(F.col("resource_path").isin("part/5", "part/6", "part/7")).select("cache_id").distinct()
    return d.join(gone, "cache_id", "left_anti").agg(F.count("*").alias("deps"), F.countDistinct("cache_id").alias("entries"))


@query(
    "cache_put",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS state_hash FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY state_hash ORDER BY o_orderkey) AS n FROM r) SELECT o_orderkey, state_hash FROM k WHERE n = 1 OR state_hash IS NULL""",
)
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each state stays; entries without a state never conflict."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("state_hash"))
    return dedup.keep_first(rows, ["state_hash"], ["o_orderkey"])


@query(
    "latest_by_id",
    """WITH v AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus = 'F' AND o_orderkey % 7 = 0 AS tombstone FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM v)
    SELECT id, version FROM r WHERE k = 1 AND NOT tombstone""",
)
def latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log read as a table: the last version of each id, unless it is a tombstone."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.expr("o_orderstatus = 'F' AND o_orderkey % 7 = 0").alias("tombstone"))
    last = log.groupBy("id").agg(F.max_by("tombstone", "version").alias("tombstone"), F.max("version").alias("version"))
    return last.filter("NOT tombstone").select("id", "version")


@query(
    "registry_invalidation",
    """WITH r AS (SELECT doc_id, lower(source || '/' || (doc_id % 17) || '.js') AS path FROM documents)
    SELECT doc_id, path FROM r WHERE NOT (path = 'src3/5.js' OR split_part(path, '/', 2) = '5.js')""",
)
def registry_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after a change of a path: those of the path itself or of its base name go."""
    path = F.lower(F.concat("source", F.lit("/"), (F.col("doc_id") % 17).cast("string"), F.lit(".js")))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.filter((F.col("path") != "src3/5.js") & (F.substring_index("path", "/", -1) != "5.js"))
