"""A table of queries for names resolved against four indexes: symbols, literals, environment variables and routes.

What a query looks like decides which index is asked first, in which form, and which others follow unless there is an exact hit. Names that
contain a query are found by an equi-join of the whole query with the pieces of the distinct names that have the length and first letter of
some query, so names and queries that share a beginning don't all meet. Pieces and entries that no query can meet are left out before a shuffle. Of equal names only the best entries go on where an index gives its best alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import query_kind
from .graph import candidate_score
from .once import once

# Best hits that an index gives (symbols: of guesses only), and the score under which a search by meaning should follow.
BEST, FULL_SCORE, LEAST_CONFIDENCE = 10, 1.15, 0.4
METHOD_ROUTE, ENV_ACCESS = r"(?i)^(?:GET|POST|PUT|PATCH|DELETE|ANY)\s+(/\S*)", r"^process\.env\.([A-Z_][A-Z0-9_]*)$"


def lookups(text: Column, kind: Column) -> Column:
    """An array of struct(step, type, search): the indexes to ask in order, each in the form it stores."""
    path, key = F.regexp_extract(text, METHOD_ROUTE, 1), F.regexp_extract(text, ENV_ACCESS, 1)
    one = lambda step, type_, search: F.struct(F.lit(step).alias("step"), F.lit(type_).alias("type"), search.alias("search"))
    route = F.when(path != "", path).when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), F.regexp_replace(text, "^/+", "")))
    return (
        F.when(kind == "route", F.array(one(0, "route", route)))
        .when(key != "", F.array(one(0, "env_var", key), one(1, "symbol", key), one(2, "literal", key)))
        .when(kind == "env_var", F.array(one(0, "env_var", text), one(1, "symbol", text)))
        .when(kind == "symbol", F.array(one(0, "symbol", text), one(1, "literal", text)))
        .otherwise(F.array(one(0, "literal", text), one(1, "symbol", text)))
    )


def likely(df: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``keys`` may be among those of ``of``, and few others: looked up in a broadcast table of 2^24 bits, so that a join needn't shuffle the rest."""
    h = F.xxhash64(*keys)
    word = F.shiftright(h, 6).bitwiseAND(F.lit((1 << 18) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    words = of.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = df.select("*", word.alias("_word"), bit.alias("_bit")).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return found.select(*df.columns)


def _pieces(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(type, name, _low): the pieces of lowered ``names`` (type, name) with a length and first letter that a search of ``wanted`` (type, _low) has, a row for each place."""
    shapes = wanted.select("type", F.substring("_low", 1, 1).alias("_first"), F.length("_low").alias("_n")).distinct()
    least = shapes.groupBy("type").agg(F.min("_n").alias("_least"))
    low = once(names, _name=F.lower("name")).join(F.broadcast(least), "type").filter(F.length("_name") >= F.col("_least"))
    places = low.select("type", "name", "_name", F.explode(F.sequence(F.lit(1), F.length("_name") - F.col("_least") + 1)).alias("_at"))
    shaped = places.withColumn("_first", F.substr("_name", "_at", F.lit(1))).join(F.broadcast(shapes), ["type", "_first"]).filter(F.col("_at") + F.col("_n") - 1 <= F.length("_name"))
    return shaped.select("type", "name", F.substr("_name", "_at", "_n").alias("_low"))


def _order(exact: Column) -> list[Column]:
    """The order of an index's hits; among entries of one type and name it is the same for every query."""
    return [
        F.when(F.col("type") == "symbol", (~F.coalesce("is_exported", F.lit(False))).cast("int")).when(F.col("type") != "route", (~exact).cast("int")).otherwise(0),
        F.when(F.col("type") == "symbol", -F.coalesce("complexity", F.lit(0))).when(F.col("type") == "literal", F.length("name")).otherwise(0),
        "file", "line", "name", "node_kind",
    ]


def candidates(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, kind, type, name, node_kind, file, line, score, at): every candidate of ``queries`` (query_id, text), ``at`` in the order of the indexes.

    ``entries``: type, name, node_kind, file, line, is_exported, complexity. Quotes around a query go; empty queries and names have no candidates.
    """
    clean = F.trim(F.regexp_replace("text", "^[\"'`]|[\"'`]$", ""))
    asked = once(queries, _q=clean).filter("_q <> ''").select("query_id", "_q", query_kind(F.col("_q")).alias("kind"))
    asked = asked.select("query_id", "_q", "kind", F.explode(lookups(F.col("_q"), F.col("kind"))).alias("l")).select("query_id", "_q", "kind", "l.*").withColumn("_low", F.lower("search"))
    wanted = asked.select("type", "search", "_low").distinct()
    named = entries.filter("name <> ''")
    pieces = likely(_pieces(named.select("type", "name").distinct(), wanted), ["type", "_low"], wanted)
    matched = wanted.join(pieces, ["type", "_low"]).select("type", "search", "name").distinct()

    per = Window.partitionBy("query_id", "step")
    hits = asked.join(matched, ["type", "search"]).withColumn("_exact", F.col("name") == F.col("search")).repartition("query_id")
    # an exact name in the first index is always among its hits, so what follows it needs no entries
    ended = F.max((F.col("step") == 0) & F.col("_exact")).over(Window.partitionBy("query_id"))
    hits = hits.withColumns({"_any": F.max("_exact").over(per), "_ended": ended}).filter("type <> 'symbol' OR _exact OR NOT _any").filter("step = 0 OR NOT _ended").drop("_ended")
    whole = (F.col("type") == "route") | ((F.col("type") == "symbol") & F.col("_any"))
    same_name = F.row_number().over(Window.partitionBy("type", "name").orderBy(*_order(F.lit(True))))
    found = hits.join(likely(named, ["type", "name"], hits).withColumn("_of", same_name), ["type", "name"]).filter((F.col("_of") <= BEST) | whole)
    found = found.repartition("query_id").withColumn("_n", F.row_number().over(per.orderBy(*_order(F.col("_exact"))))).filter((F.col("_n") <= BEST) | whole)

    # an index that follows is left out where an earlier one has a name that is the query, in any case of letters
    hit = F.lower("name").isin(F.lower("_q"), F.col("_low"))
    of = Window.partitionBy("query_id")
    step = lambda k, c: F.coalesce(F.max(F.when(F.col("step") == k, c)).over(of), F.lit(False))
    first, second = step(0, hit), step(1, hit)
    primary = F.coalesce(F.max(F.when(F.col("step") == 0, True)).over(of), F.lit(False))
    found = found.withColumns({"_first": first, "_second": second, "_found": primary}).filter("step = 0 OR NOT _first").filter("step < 2 OR NOT (_found AND _second)")

    main = F.first(F.when(F.col("step") == 0, F.col("_low")), ignorenulls=True)
    scoring = asked.groupBy("query_id").agg(main.alias("_main"))
    preferred = (F.col("type") == F.col("kind")) | ((F.col("kind") == "env_var") & (F.col("type") == "symbol"))
    fuzzy = (F.col("type") == "symbol") & ~F.col("_exact")
    score = candidate_score(F.col("name"), F.col("_main"), preferred, F.coalesce("is_exported", F.lit(False)), F.coalesce("complexity", F.lit(0)).cast("double"), fuzzy)
    at = F.col("step") * 1_000_000_000 + F.col("_n")
    scored = found.join(scoring, "query_id").select("query_id", "kind", "type", "name", F.when(F.col("type") == "symbol", F.coalesce("node_kind", "type")).otherwise(F.col("type")).alias("node_kind"), "file", "line", score.alias("score"), at.alias("at"))
    same = Window.partitionBy("query_id", "name", "file", "line", "node_kind").orderBy("at")
    return scored.withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k")


def resolve(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, kind, rank, type, name, file, line, score, confidence, needs_fallback): the candidates best first; a query without any has one row of rank 0."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "at")
    ranked = candidates(queries, entries).withColumn("rank", F.row_number().over(best)).withColumn("top", F.max("score").over(Window.partitionBy("query_id")))
    clean = F.trim(F.regexp_replace("text", "^[\"'`]|[\"'`]$", ""))
    out = queries.select("query_id", F.when(clean == "", "empty").otherwise(query_kind(clean)).alias("kind")).join(ranked.drop("kind"), "query_id", "left")
    confidence = F.when(F.col("top").isNotNull(), F.least(F.col("top") / FULL_SCORE, F.lit(1.0))).otherwise(0.0)
    return out.select("query_id", "kind", F.coalesce("rank", F.lit(0)).alias("rank"), "type", "name", "file", "line", "score", confidence.alias("confidence"), (confidence < LEAST_CONFIDENCE).alias("needs_fallback"))
