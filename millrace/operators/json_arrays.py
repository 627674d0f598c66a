"""Large JSON results cut to the items that say something, as expressions over variants: every text is handled in its own row, nothing is shuffled.

The variant type orders the fields of an object by name, and writes 1.0 as 1; texts that are put together again come out so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .once import once

# States that count as fine, levels that count as bad, keys whose value is an error, and words of errors in plain strings.
OK_STATUS = ["ok", "success", "succeeded", "pass", "passed", "active", "done", "completed", "complete", "fulfilled", "healthy", "ready", "running"]
ERROR_LEVELS = ["error", "err", "fatal", "critical", "warn", "warning"]
ERROR_KEYS = ["error", "err", "exception", "stack", "stacktrace", "failure", "failureMessage"]
ERROR_TEXT = r"(?i)\b(error|fail(ed|ure)?|exception|fatal|timeout|denied|refused)\b"
NOTE_KEY = "_note"


@dataclass(frozen=True)
class Sampling:
    """Which texts are cut, and what stays of them."""

    min_items: int = 30
    min_chars: int = 8000
    max_keep: int = 50
    head: int = 3
    tail: int = 2
    query_top: int = 10
    sigma: float = 2.0
    min_ratio: float = 0.3
    min_saved: int = 2000


def _get(item: Column, *names: str) -> Column:
    """The first of the fields ``names`` that is there and isn't null."""
    found = [F.try_variant_get(item, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(f), f) for f in found])


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("NONE"))


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")


def _string(value: Column) -> Column:
    """The value of a string, null for all else."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _is(item: Column, name: str, value: bool) -> Column:
    field = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(_kind(field) == "BOOLEAN", F.try_variant_get(field, "$", "boolean") == value).otherwise(False)


def _has_error(item: Column, name: str) -> Column:
    """There is a value other than null, false and the empty string."""
    value = _get(item, name)
    return value.isNotNull() & ~_is(item, name, False) & (F.coalesce(_string(value), F.lit("x")) != "")


def is_error(item: Column) -> Column:
    """A string with a word of errors, or an object in a bad state."""
    status = F.lower(_string(_get(item, "status", "state", "result", "outcome")))
    level = F.lower(_string(_get(item, "level", "severity")))
    code = _get(item, "exitCode", "exit_code")
    bad = F.coalesce(~status.isin(OK_STATUS), F.lit(False)) | F.coalesce(level.isin(ERROR_LEVELS), F.lit(False))
    for name in ERROR_KEYS:
        bad = bad | _has_error(item, name)
    bad = bad | _is(item, "success", False) | _is(item, "ok", False) | _is(item, "passed", False) | _is(item, "failed", True)
    bad = bad | F.when(_is_number(code), F.try_variant_get(code, "$", "double") != 0).otherwise(False)
    kind = _kind(item)
    return F.when(kind == "STRING", F.coalesce(_string(item).rlike(ERROR_TEXT), F.lit(False))).when(kind.startswith("OBJECT"), bad).otherwise(False)


def query_hits(item: Column, terms: Column) -> Column:
    """How many of ``terms`` the item's text contains."""
    text = F.lower(F.coalesce(_string(item), F.to_json(item)))
    return F.size(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(text, t)))


def dominant_array(text: Column, min_items: int = 30) -> Column:
    """struct(path, items): the text's own array (path null), or the longest, written out, of an object's arrays of ``min_items`` and more; null if none."""
    value = F.try_parse_json(text)
    own = F.try_variant_get(value, "$", "array<variant>")
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("path"), F.try_variant_get(e["value"], "$", "array<variant>").alias("items"), F.length(F.to_json(e["value"])).alias("size")))
    arrays = F.filter(fields, lambda f: F.size(f["items"]) >= min_items)
    best = F.reduce(arrays, F.element_at(arrays, 1), lambda b, a: F.when(a["size"] > b["size"], a).otherwise(b))
    chosen = F.when(own.isNotNull(), F.struct(F.lit(None).cast("string").alias("path"), own.alias("items"))).when(F.size(arrays) > 0, F.struct(best["path"].alias("path"), best["items"].alias("items")))
    return F.when(F.size(chosen["items"]) >= min_items, chosen)


def _spreads(facts: Column, sigma: float) -> Column:
    """struct(field, low, high) of every number field that half the items have and that varies: values outside are outliers."""
    names = F.array_distinct(F.flatten(F.transform(facts, lambda f: F.map_keys(f["numbers"]))))

    def spread(name: Column) -> Column:
        values = F.filter(F.transform(facts, lambda f: F.try_element_at(f["numbers"], name)), lambda x: x.isNotNull())
        n = F.size(values)
        mean = F.reduce(values, F.lit(0.0), lambda s, x: s + x) / n
        return F.struct(name.alias("field"), n.alias("n"), mean.alias("mean"), values.alias("values"))

    found = F.filter(F.transform(names, spread), lambda s: s["n"] >= F.size(facts) * 0.5)
    sd = F.transform(found, lambda s: F.struct(s["field"].alias("field"), s["mean"].alias("mean"), F.sqrt(F.reduce(s["values"], F.lit(0.0), lambda t, x: t + (x - s["mean"]) * (x - s["mean"])) / s["n"]).alias("sd")))
    return F.transform(F.filter(sd, lambda s: s["sd"] > 0), lambda s: F.struct(s["field"].alias("field"), s["mean"].alias("mean"), (s["sd"] * sigma).alias("reach")))


def sample_arrays(rows: DataFrame, id_col: str, text_col: str, terms_col: str | None = None, how: Sampling = Sampling()) -> DataFrame:
    """(id, path, total, text, items, picked): picked is an array of struct(index, priority) in order of index, for each text with a dominant array that loses items.

    Priority 0: the first and last items, 1: errors, 2: the best matches of ``terms_col``, 3: outliers; places are given in that order, ``max_keep`` in all.
    Texts that are short, no JSON, already cut, or stand-ins for a stored text are left out, as are nulls.
    """
    text = F.col(text_col)
    stub = text.startswith("[VAULT:") | text.startswith("[COMPRESSED") | (F.contains(text, F.lit(f'"{NOTE_KEY}"')) & F.contains(text, F.lit("vault_")))
    terms = F.col(terms_col) if terms_col else F.array().cast("array<string>")
    long = rows.filter((F.length(text) >= how.min_chars) & ~stub).select(F.col(id_col), text.alias("text"), terms.alias("_terms"))
    found = once(long, _d=dominant_array(F.col("text"), how.min_items)).filter("_d IS NOT NULL")
    numbers = lambda item: F.transform_values(F.map_filter(F.coalesce(F.try_variant_get(item, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: _is_number(v)), lambda k, v: F.try_variant_get(v, "$", "double"))
    facts = F.transform("_d.items", lambda x, i: F.struct(i.cast("int").alias("i"), is_error(x).alias("bad"), query_hits(x, F.col("_terms")).alias("hits"), numbers(x).alias("numbers")))
    known = once(found, path=F.col("_d.path"), items=F.col("_d.items"), total=F.size("_d.items"), _f=facts)
    known = once(known, _spread=_spreads(F.col("_f"), how.sigma))

    n = F.col("total")
    best = F.slice(F.array_sort(F.transform(F.filter("_f", lambda f: f["hits"] > 0), lambda f: F.struct((-f["hits"]).alias("h"), f["i"].alias("i")))), 1, how.query_top)
    odd = lambda f: F.exists("_spread", lambda s: F.coalesce(F.abs(F.try_element_at(f["numbers"], s["field"]) - s["mean"]) > s["reach"], F.lit(False)))
    known = once(known, _best=best, _odd=F.transform(F.filter("_f", odd), lambda f: f["i"]))
    ranked = F.transform("_f", lambda f: F.struct(f["i"].alias("index"), F.when((f["i"] < how.head) | (f["i"] >= n - how.tail), 0).when(f["bad"], 1).when(F.exists("_best", lambda b: b["i"] == f["i"]), 2).when(F.array_contains("_odd", f["i"]), 3).alias("priority"), F.coalesce(F.array_position("_best.i", f["i"]).cast("int"), F.lit(0)).alias("at")))
    order = F.array_sort(F.transform(F.filter(ranked, lambda r: r["priority"].isNotNull()), lambda r: F.struct(r["priority"].alias("priority"), F.when(r["priority"] == 2, r["at"]).otherwise(r["index"]).alias("at"), r["index"].alias("index"))))
    kept = once(known, _kept=F.filter(order, lambda r, i: (i < how.max_keep) | (r["priority"] == 0)))
    picked = F.array_sort(F.transform("_kept", lambda r: F.struct(r["index"].alias("index"), r["priority"].alias("priority"))))
    return kept.filter(F.size("_kept") < n).select(id_col, "text", "path", "items", "total", picked.alias("picked"))


def crush(rows: DataFrame, id_col: str, text_col: str, terms_col: str | None = None, how: Sampling = Sampling()) -> DataFrame:
    """(id, path, total, kept, vault_id, crushed, saved_chars): texts that are shorter by enough with a sample of their array and a note in its place.

    The note names the three commonest states of the items left out and the key under which the whole text belongs in the vault.
    """
    s = sample_arrays(rows, id_col, text_col, terms_col, how)
    s = once(s, kept=F.size("picked"), vault_id=F.concat(F.lit("vault_"), short_hash(F.col("text"))))
    left = F.filter(F.transform("items", lambda x, i: F.when(F.array_contains("picked.index", i), None).otherwise(_string(_get(x, "status", "state", "level")))), lambda x: x.isNotNull())
    s = once(s, _left=left)
    counts = F.array_sort(F.transform(F.array_distinct("_left"), lambda v: F.struct((-F.size(F.filter("_left", lambda x: x == v))).alias("n"), v.alias("status"))))
    said = F.array_join(F.transform(F.slice(counts, 1, 3), lambda c: F.concat((-c["n"]).cast("string"), F.lit("× "), c["status"])), ", ")
    s = once(s, _said=F.when(F.size("_left") > 0, F.concat(F.lit(" ("), said, F.lit(")"))).otherwise(""))
    note = F.concat(
        F.col("kept").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" items shown — "), (F.col("total") - F.col("kept")).cast("string"), F.lit(" similar items omitted"), F.col("_said"),
        F.lit(". Errors, outliers and query-relevant items were kept. Full data: use tool call retrieve with vault_id="), F.col("vault_id"),
    )
    items = F.transform("picked", lambda p: F.to_json(F.element_at("items", p["index"] + 1)))
    array = F.concat(F.lit("["), F.array_join(F.concat(items, F.array(F.to_json(F.struct(note.alias(NOTE_KEY))))), ","), F.lit("]"))
    s = once(s, _array=array)
    fields = F.map_entries(F.try_variant_get(F.try_parse_json("text"), "$", "map<string,variant>"))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(e["key"] == F.col("path"), F.col("_array")).otherwise(F.to_json(e["value"])))), ","), F.lit("}"))
    s = once(s, crushed=F.when(F.col("path").isNull(), F.col("_array")).otherwise(whole))
    s = once(s, saved_chars=F.length("text") - F.length("crushed"))
    return s.select(id_col, "path", "total", "kept", "vault_id", "crushed", "saved_chars", F.length("text").alias("_n")).filter((F.col("saved_chars") >= how.min_saved) & (F.col("saved_chars") / F.col("_n") >= how.min_ratio)).drop("_n")
