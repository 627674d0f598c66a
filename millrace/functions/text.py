"""Column functions on text; all are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256: the key of vault entries and files."""
    return F.substring(F.sha2(text, 256), 1, 16)


def canonical_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def terms(text: Column) -> Column:
    """Search terms: ASCII letters, digits, _ and -, two at least; lowered after extraction so that nothing folds in."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_-]{2,}"), 0), lambda t: F.lower(t))


def breadcrumb(text: Column) -> Column:
    """Up to the first sentence end at index 11 to 499, else the start; 150 characters at most."""
    first = F.regexp_extract(text, r"(?s)^(.{11}[^.!?]{0,488}?[.!?])", 1)
    return F.substring(F.when(first != "", first).otherwise(text), 1, 150)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def char_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def occurrences(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def week_start(ts: Column) -> Column:
    """Sunday of the week of ``ts``."""
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)
