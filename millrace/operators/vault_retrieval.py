"""A table of requests to the vault answered in one plan, each by the first tier that has something.

Tiers: 0 the chunks of the vault asked for, 1 its raw text, 2 lines of a file around a line hint, 3 the best chunks for the query and its
context with their neighbours, 4 texts the search itself holds where chunks are gone, 5 chunks for the query alone under a lower
threshold; 6: nothing found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once
from .resolver import likely

# What counts as a line hint and as a path.
LINE_HINT = r"(?i)\bline[:\s]+(\d+)\b"
FILE_PATH = r"\b((?:src/|\./)?[\w/\\.\-]+\.\w{1,6})\b"
RULE = "\n" + "=" * 50 + "\n"


@dataclass(frozen=True)
class Tiers:
    before: int = 15
    after: int = 25
    first_k: int = 5
    first_least: float = 0.5
    second_k: int = 3
    second_least: float = 0.3
    dense_weight: float = 0.3
    neighbour_chars: int = 200
    inline_chars: int = 500
    context_chars: int = 200


def line_slice(path: Column, lines: Column, target: Column, how: Tiers = Tiers()) -> Column:
    """The numbered lines around ``target`` (from 1) under a header; null beyond the file."""
    start = F.greatest(target - 1 - how.before, F.lit(0))
    end = F.least(F.size(lines) - 1, target - 1 + how.after)
    numbered = F.transform(F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((start + i + 1).cast("string"), F.greatest(F.lit(4), F.length((start + i + 1).cast("string"))), F.lit(" ")), F.lit(" | "), x))
    header = F.concat(F.lit("[File slice: "), path, F.lit(" lines "), (start + 1).cast("string"), F.lit("–"), (end + 1).cast("string"), F.lit("]\n\n"))
    return F.when((target >= 1) & (target <= F.size(lines)), F.concat(header, F.array_join(numbered, "\n")))


def expanded(query: Column, context: Column, how: Tiers = Tiers()) -> Column:
    """The query followed by the start of its context, unless it has that already."""
    context, query = F.substring(F.coalesce(context, F.lit("")), 1, how.context_chars), F.coalesce(query, F.lit(""))
    return F.when((context != "") & ~F.contains(query, context), F.trim(F.concat(query, F.lit(" "), context))).otherwise(query)


def hybrid(queries: DataFrame, search: Callable[[DataFrame], DataFrame], dense: DataFrame | None, k: Column, least: Column, weight: float) -> DataFrame:
    """(query_id, id, score, k): the best chunks of each query (query_id, text) by the weighted sum of both scores, each divided by the query's largest.

    ``search`` gives (query_id, id, score); ``dense`` has (request_id, id, sim) and counts for each query_id.request_id. ``k`` and ``least``, the least sim
    that counts, are columns over query_id.
    """
    both = search(queries).select("query_id", "id", F.col("score").alias("sparse"))
    if dense is None:
        both = both.withColumn("sim", F.lit(0.0))
    else:
        near = queries.select("query_id", F.col("query_id.request_id").alias("request_id")).join(dense, "request_id").filter(F.col("sim") >= least).select("query_id", "id", "sim")
        both = both.join(near, ["query_id", "id"], "full").na.fill(0.0, ["sim", "sparse"])
    of = Window.partitionBy("query_id")
    part = lambda c: F.when(F.max(c).over(of) > 0, F.col(c) / F.max(c).over(of)).otherwise(0.0)
    scored = both.withColumn("score", weight * part("sim") + (1 - weight) * part("sparse"))
    return scored.withColumn("k", F.row_number().over(of.orderBy(F.desc(F.round("score", 9)), "id"))).filter(F.col("k") <= k).select("query_id", "id", "score", "k")


def _answers(hits: DataFrame, chunks: DataFrame, inline: DataFrame | None, how: Tiers) -> DataFrame:
    """(request_id, first, held, second): the texts of tiers 3, 4 and 5 of each request from its hits, null where there is nothing. Hits are read once."""
    at = chunks.select(F.col("chunk_id").alias("id"), "vault_id", "chunk_index", F.col("text").isNotNull().alias("_there"))
    hits = hits.join(at, "id", "left").repartition(F.col("query_id.request_id"))
    # the second step counts only where the first has found no chunk that is there
    found = F.max((F.col("query_id.step") == 1) & F.coalesce(F.col("_there") & F.col("vault_id").isNotNull(), F.lit(False)))
    hits = hits.withColumn("_found", found.over(Window.partitionBy("query_id.request_id"))).filter("query_id.step = 1 OR NOT _found").drop("_there", "_found")
    held = inline.select("id", F.substring("text", 1, how.inline_chars).alias("held")) if inline is not None else chunks.select(F.col("chunk_id").alias("id"), F.lit("").alias("held")).limit(0)
    around = F.explode(F.when((F.col("query_id.step") == 1) & F.col("vault_id").isNotNull(), F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))).alias("d")
    rows = hits.join(held, "id", "left").select("*", around).withColumn("chunk_index", F.col("chunk_index") + F.col("d"))
    at = ["vault_id", "chunk_index"]
    rows = rows.join(likely(chunks.select(*at, "text"), at, rows), at, "left").withColumn("request_id", F.col("query_id.request_id")).withColumn("text", F.when(F.col("d") == 0, F.col("text")).otherwise(F.substring("text", 1, how.neighbour_chars)))
    rows = rows.repartition("request_id")  # texts move once for all that follows
    near = F.when((F.col("d") != 0) & F.col("text").isNotNull(), F.struct("d", "text"))
    one = rows.groupBy("request_id", "query_id", "k", "score").agg(F.max(F.when(F.col("d") == 0, F.col("text"))).alias("text"), F.max(F.when(F.col("d") == 0, F.col("chunk_index"))).alias("at"), F.max("held").alias("held"), F.sort_array(F.collect_list(near)).alias("near"))
    score = F.concat(F.lit(" (score: "), F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit("%)]\n"))
    whole = F.concat(F.lit("[Chunk "), F.col("at").cast("string"), score, F.col("text"), F.when(F.size("near") > 0, F.concat(F.lit("\n\n[Surrounding Context]\n"), F.array_join("near.text", "\n...\n"))).otherwise(""))
    snippet = F.when(F.col("held") != "", F.concat(F.lit("[Chunk "), F.col("k").cast("string"), score, F.col("held")))
    one = one.select("request_id", F.col("query_id.step").alias("step"), "k", whole.alias("whole"), snippet.alias("snippet"))

    def joined(step: int, c: str) -> Column:
        pieces = F.sort_array(F.collect_list(F.when((F.col("step") == step) & F.col(c).isNotNull(), F.struct("k", c))))
        return F.when(F.size(pieces) > 0, F.array_join(pieces[c], RULE))

    return one.groupBy("request_id").agg(joined(1, "whole").alias("first"), joined(1, "snippet").alias("held"), joined(2, "whole").alias("second"))


def retrieve(
    requests: DataFrame, chunks: DataFrame, raw: DataFrame, files: DataFrame, search: Callable[[DataFrame], DataFrame], inline: DataFrame | None = None, dense: DataFrame | None = None, how: Tiers = Tiers()
) -> DataFrame:
    """(request_id, tier, vault_id, text) for each of ``requests`` (request_id, vault_id, query, context).

    ``chunks``: vault_id, chunk_id, chunk_index, text. ``raw``: vault_id, text. ``files``: path, text. ``search``: see ``hybrid``; it knows chunks by chunk_id.
    ``inline``: id, text of what the search holds. A request whose vault isn't there goes on to the next tiers. Empty texts answer nothing.
    """
    wanted = requests.select("vault_id").filter("vault_id IS NOT NULL").distinct()
    # inner joins with distinct keys: a semi join would be moved below what likely() leaves out
    whole = likely(chunks, ["vault_id"], wanted).join(wanted, "vault_id").groupBy("vault_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    whole = whole.select("vault_id", F.array_join(F.transform("c", lambda x: F.concat(F.lit("[Chunk "), x["chunk_index"].cast("string"), F.lit("]\n"), x["text"])), "\n\n").alias("whole"))
    stored = likely(raw, ["vault_id"], wanted).join(wanted, "vault_id").groupBy("vault_id").agg(F.max("text").alias("raw"))
    query = F.coalesce("query", F.lit(""))
    hints = once(requests, _line=F.regexp_extract(query, LINE_HINT, 1).try_cast("int"), _path=F.regexp_replace(F.regexp_extract(query, FILE_PATH, 1), r"\\", "/"))
    hints = hints.filter("_line IS NOT NULL AND _path <> ''")
    texts = likely(files.select(F.col("path").alias("_path"), "text"), ["_path"], hints).select("_path", F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n").alias("_lines"))
    slices = hints.join(texts, "_path").select("request_id", line_slice(F.col("_path"), F.col("_lines"), F.col("_line"), how).alias("slice")).groupBy("request_id").agg(F.max("slice").alias("slice"))
    known = requests.join(whole, "vault_id", "left").join(stored, "vault_id", "left").join(slices, "request_id", "left")
    vault = lambda c: F.when(F.length(c) > 0, F.concat(F.lit("[Vault "), F.col("vault_id"), F.lit("]\n\n"), F.col(c)))
    direct = F.coalesce(F.when(vault("whole").isNotNull(), F.struct(F.lit(0).alias("tier"), vault("whole").alias("text"))), F.when(vault("raw").isNotNull(), F.struct(F.lit(1).alias("tier"), vault("raw").alias("text"))), F.when(F.col("slice").isNotNull(), F.struct(F.lit(2).alias("tier"), F.col("slice").alias("text"))))
    answered = once(known, _a=direct).select("request_id", "vault_id", "query", "context", "_a")

    steps = F.array(F.struct(F.lit(1).alias("step"), expanded(F.col("query"), F.col("context"), how).alias("text")), F.struct(F.lit(2).alias("step"), F.coalesce("query", F.lit("")).alias("text")))
    asked = answered.filter("_a IS NULL").select("request_id", F.inline(steps)).filter("text <> ''").select(F.struct("request_id", "step").alias("query_id"), "text")
    first = F.col("query_id.step") == 1
    hits = hybrid(asked, search, dense, F.when(first, how.first_k).otherwise(how.second_k), F.when(first, how.first_least).otherwise(how.second_least), how.dense_weight)
    out = answered.join(_answers(hits, chunks, inline, how), "request_id", "left")
    tier = F.coalesce("_a.tier", F.when(F.col("first").isNotNull(), 3).when(F.col("held").isNotNull(), 4).when(F.col("second").isNotNull(), 5).otherwise(6))
    found = F.coalesce("first", "held", "second")
    low = F.col("first").isNull() & F.col("held").isNull()
    header = F.when(F.col("vault_id").isNotNull(), F.concat(F.lit("[Vault "), F.col("vault_id"), F.when(low, " — low-threshold fallback]\n\n").otherwise(" — retrieved via semantic search]\n\n"))).otherwise(
        F.when(low, "[Low-threshold search results]\n\n").otherwise("[Semantic search results]\n\n")
    )
    return out.select("request_id", tier.alias("tier"), "vault_id", F.coalesce("_a.text", F.concat(header, found)).alias("text"))
