"""The plan of a request: its intent, how that was found, and what the answer may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.once import once
from . import signals

# What each intent may use, what names a file or symbol, and the least confidences.
CAPABILITIES = {"PATCH": ["PATCH"], "DEBUG": ["GRAPH", "PATCH", "READ"], "SEARCH": ["GRAPH", "READ"], "CREATE": ["PATCH"], "CHAT": []}
REFERENCE = r"(?i)\.(js|ts|py|go|rs|jsx|tsx|java|rb|cpp)\b|function |class |const |route|endpoint|middleware"
LEAST_CONFIDENCE, LEAST_SIMILARITY, LEAST_TOTAL = 0.5, 0.2, 3
ADD = r"\badd\b"


def _allowed(intent: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, caps in CAPABILITIES.items():
        out = out.when(intent == name, F.array(*map(F.lit, caps)).cast("array<string>"))
    return F.coalesce(out, F.array().cast("array<string>"))


def plan(rows: DataFrame) -> DataFrame:
    """``rows`` (text, origin, prior_tools, near_intent, near_score, ...) with intent, method, capabilities (sorted) and bypass in place of these five.

    A blank or null text is TRIVIAL. Under the least confidence of signals the nearest labelled intent decides, if it is near enough; else a file or symbol that is
    named makes chat a search. Creating with signals of changes (but for "add") or of a search may also read. A continuation may
    patch; chat after tools becomes the best other intent with a signal, of equals the first of PATCH, DEBUG, SEARCH, CREATE.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scores = signals.intent_scores(text)
    name, _, confidence = signals.intent(text)
    added = sum((w for i, w, p, _ in signals.INTENTS if i == "PATCH" and p == ADD), 0)
    real = scores["PATCH"] - F.when(text.rlike(f"(?i){ADD}"), added).otherwise(0) > 0
    found = {**scores, "won": name, "sure": confidence, "reads": real | (scores["SEARCH"] > 0), "refers": text.rlike(REFERENCE)}
    rows = once(rows, **{f"_s_{k}": v for k, v in found.items()})  # columns of their own: fields of a struct get lost between generators
    won, total = F.col("_s_won"), sum((F.col(f"_s_{k}") for k in CAPABILITIES), F.lit(0))
    near = F.coalesce(F.col("near_score") >= LEAST_SIMILARITY, F.lit(False)) & F.col("near_intent").isNotNull()
    method = (
        F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty_message").when(F.col("_s_sure") >= LEAST_CONFIDENCE, "regex").when(near, "semantic")
        .when(F.col("_s_refers") & (won == "CHAT"), "context_signal").when((won == "CHAT") & (total < LEAST_TOTAL), "safe_fallback").otherwise("regex_fallback")
    )
    rows = once(rows, method=method)
    first = F.when(F.col("method") == "empty_message", "TRIVIAL").when(F.col("method") == "semantic", F.col("near_intent")).when(F.col("method") == "context_signal", "SEARCH").otherwise(won)
    rows = once(rows, _first=first)
    tools = F.coalesce(F.col("prior_tools"), F.lit(False))
    goes_on = (F.coalesce(F.col("origin") == "CONTINUATION", F.lit(False)) | tools) & (F.col("_first") != "TRIVIAL")
    others = [k for k in CAPABILITIES if k != "CHAT"]
    top = F.greatest(*[F.col(f"_s_{k}") for k in others])
    other = F.coalesce(*[F.when(F.col(f"_s_{k}") == top, k) for k in others])
    promoted = tools & (F.col("_first") == "CHAT") & (top > 0)
    base = _allowed(F.when(promoted, other).otherwise(F.col("_first")))
    base = F.when((F.col("_first") == "CREATE") & F.col("_s_reads"), F.array_union(base, F.array(F.lit("GRAPH"), F.lit("READ")))).otherwise(base)
    caps = F.array_sort(F.when(goes_on & (F.size(base) > 0), F.array_union(base, F.array(F.lit("PATCH")))).otherwise(base))
    rows = once(rows, intent=F.when(promoted, other).otherwise(F.col("_first")), capabilities=caps)
    return rows.withColumn("bypass", F.size("capabilities") == 0).drop(*[f"_s_{k}" for k in found], "_first", "text", "origin", "prior_tools", "near_intent", "near_score")
