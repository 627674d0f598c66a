"""Usage reports of model servers, age factors, and the keys and normal forms that caches compare texts by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The offsets of two independent 32-bit FNV-1a lanes, and their prime.
FNV_LANES, FNV_PRIME = (0x811C9DC5, 0x4B9ACE2F), 0x01000193
# What changes between two reads of one thing, and what stands for it in a fingerprint. The names of vaults and calls are this package's.
VOLATILE = [
    (r"vault_[a-f0-9]+", "VAULT_ID"),
    (r'\[COMPRESSED_FILE vault_id:"[^"]+"\]', "[COMPRESSED]"),
    (r'vault_id="[^"]+"', 'vault_id="STABLE"'),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z", "TIMESTAMP"),
    (r"call_\d+_\d+", "CALL_ID"),
    (r"IDX_[0-9a-f-]{36}", "IDX_ID"),
    (r'"size":\s*\d+', '"size": SIZE'),
    (r'"lastPatchedAt":\s*"[^"]+"', '"lastPatchedAt": TIMESTAMP'),
    (r"\bat\s+\d{2}:\d{2}:\d{2}\b", "at TIMESTAMP"),
]


def fnv_pair(text: Column) -> Column:
    """Two FNV-1a hashes of the UTF-16 units of ``text``, as eight hex digits each, joined by an underscore."""
    hexes = F.hex(F.encode(text, "UTF-16BE"))
    units = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), (F.length(hexes) / 4).cast("int") - 1), lambda i: F.conv(F.substr(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array())
    lanes = [F.aggregate(units, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))) for seed in FNV_LANES]
    return F.concat_ws("_", *[F.lower(F.lpad(F.hex(h), 8, "0")) for h in lanes])


def stable(text: Column) -> Column:
    """``text`` without what changes between two reads of one thing."""
    for pattern, instead in VOLATILE:
        text = F.regexp_replace(text, pattern, instead)
    return text


def usage(report: Column) -> Column:
    """(input, cache_read, output) tokens of a usage report in JSON, of either of two dialects; zeros if it is of none."""
    value = F.try_parse_json(report)
    number = lambda path: F.coalesce(F.try_variant_get(value, path, "long"), F.lit(0))
    has = lambda path: F.try_variant_get(value, path, "variant").isNotNull()  # noqa: E731  a field that is there and null counts as there
    row = lambda i, c, o: F.struct(i.alias("input"), c.alias("cache_read"), o.alias("output"))
    cached, zero = number("$.prompt_tokens_details.cached_tokens"), F.lit(0).cast("long")
    return (
        F.when(has("$.cache_read_input_tokens"), row(number("$.input_tokens") + number("$.cache_creation_input_tokens"), number("$.cache_read_input_tokens"), number("$.output_tokens")))
        .when(has("$.prompt_tokens"), row(F.greatest(zero, number("$.prompt_tokens") - cached), cached, number("$.completion_tokens")))
        .otherwise(row(zero, zero, zero))
    )


def age_factor(age: Column, most: Column | int) -> Column:
    """How much a reference still counts: 1 when new, half at the greatest age."""
    return 1 - age / most * 0.5
