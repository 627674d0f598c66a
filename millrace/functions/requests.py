"""Column functions on requests, tool calls and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a call shows that it changes a file, in order; the group is the file.
MUTATIONS = [
    (r'"operation"\s*:\s*"(create|append)"[^}]{0,300}"filename"\s*:\s*"([^"]+)"', 2),
    (r'"command"\s*:\s*"[^"]*>\s*([^\s"\\]+)"', 1),
    (r'(?i)"command"\s*:\s*"(?:rm|mv|cp|touch|truncate|sed|awk)[^"]*\s([^\s"\\]+)"', 1),
]
# Local model servers; words that a query's terms leave out.
LOCAL = ["ollama", "lm-studio", "llama.cpp", "localhost", "llamacpp"]
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "have", "are", "was", "you", "your", "can", "what", "how",
    "why", "all", "any", "not", "but", "please", "now", "then", "them", "they", "its", "his", "her", "out", "use",
]
# Where a text names its file, in order.
FILENAMES = [
    r"(?im)^(?:File|Path|Filename|Reading):\s*(.+\.\w+)",
    r"(?m)^```[\w]*\s+([\w/\\.\-]+\.\w+)",
    r"(?m)^((?:[\w.\-]+/)+[\w.\-]+\.\w+)\s*$",
    r"(?im)\b(?:reading|opened?|loaded?|viewing?|cat)\s+['\"]?([\w/\\.\-]+\.\w+)['\"]?",
    r"\b(/(?:[\w.\-]+/)+[\w.\-]+\.\w+)\b",
    r"\b([A-Za-z]:\\(?:[\w.\- ]+\\)+[\w.\-]+\.\w+)\b",
    r"\b((?:\.{1,2}/|[\w.\-]+/)[\w/\\.\-]+\.\w+)\b",
]
DAY_MS = 86_400_000


def mutated_file(payload: Column) -> Column:
    """The file that a tool call changes; null if it changes none."""
    found = [F.regexp_extract(payload, p, g) for p, g in MUTATIONS]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def is_local(provider: Column, model: Column) -> Column:
    p, m = F.lower(provider), F.lower(model)
    hint = F.lit(False)
    for word in LOCAL:
        hint = hint | F.contains(p, F.lit(word))
    return hint | m.rlike(r":[a-z0-9._-]+$") & ~m.startswith("claude") & ~m.startswith("gpt")


def concept_key(query: Column) -> Column:
    """Words of a name in order of the alphabet, joined; one short word stays as it is."""
    spaced = F.regexp_replace(F.regexp_replace(query, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), r"[-_\s.]+"), lambda t: t != "")
    return F.when((F.size(words) == 1) & (F.length(words[0]) < 5), F.lower(query)).otherwise(F.array_join(F.array_sort(words), ""))


def query_terms(text: Column) -> Column:
    """Distinct words and paths of three characters or more that are no stopwords, in order; reminder blocks don't count."""
    said = F.regexp_replace(F.lower(text), r"(?s)<system-reminder>.*?</system-reminder>", "")
    words = F.filter(F.split(said, "[^a-z0-9_./-]+"), lambda t: F.length(t) >= 3)
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS])))


def file_name(text: Column) -> Column:
    """The file that a text names in its first 500 characters; null if it names none."""
    head = F.substring(text, 1, 500)
    found = [F.regexp_extract(head, p, 1) for p in FILENAMES]
    return F.coalesce(*[F.when(x != "", F.trim(x)) for x in found])


def token_budget(text: Column, tokens: int) -> Column:
    """Cut at the last line end within four characters a token."""
    head = F.substring(text, 1, 4 * tokens)
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.length(text) <= 4 * tokens, text).when(whole != "", whole).otherwise(head)


def relative_time(seconds: Column) -> Column:
    ago = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def query_kind(q: Column) -> Column:
    """route, env_var, symbol or literal: the index that is asked first."""
    return (
        F.when(q.rlike(r"(?i)^(GET|POST|PUT|PATCH|DELETE|ANY)\s+(/\S*)"), "route")
        .when(q.startswith("/") & (F.length(q) > 1), "route")
        .when(F.contains(q, F.lit("/")) & q.rlike(r"^[a-zA-Z0-9_\-/]+$"), "route")
        .when(q.rlike(r"^process\.env\.([A-Z_][A-Z0-9_]*)$"), "env_var")
        .when(q.rlike(r"^[A-Z][A-Z0-9_]{2,}$"), "env_var")
        .when(q.rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$"), "symbol")
        .when(q.rlike(r"[-\s.]"), "literal")
        .otherwise("symbol")
    )
