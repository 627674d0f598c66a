"""Signal tables of the classifiers, and the column expressions built from them.

The patterns, weights and thresholds below are fixed values: results depend on each of them. They use only what Java's
and RE2's regular expressions have in common, so that queries and their SQL agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent signals as (intent, weight, pattern, longest message or none).
INTENTS = [
    ("PATCH", 4, r"\brename\b|\binstead of\b|\bmake\b.*\baccept\b", None),
    ("PATCH", 2, r"\bfix\s+(typo|spelling|indent|format)\b", None),
    ("PATCH", 2, r"\bchange\b|\bsplit\b|\bextract\b|\brefactor\b|\bconvert\b|\binline\b", None),
    ("PATCH", 2, r"\bupdate\s+(this\s+)?(line|function|method|variable)\b", None),
    ("PATCH", 2, r"\bmodify\b|\badjust\b|\btweak\b", None),
    ("PATCH", 2, r"\bwrap\b|\bsurround\b|\benclose\b", None),
    ("PATCH", 1, r"\bremove\b|\bdelete\b", None),
    ("PATCH", 1, r"\bclean up\b|\bimprove\b", None),
    ("PATCH", 2, r"\badd\b", None),
    ("DEBUG", 2, r"\bfix\s+(bug|issue|problem|error|crash)\b", None),
    ("DEBUG", 2, r"\bfix\s+the\s+(auth|login|database|api)\b", None),
    ("DEBUG", 2, r"\bwhy\s+(is|does|isn't|doesn't)\b", None),
    ("DEBUG", 2, r"\bnot working\b|\bdoesn't work\b|\bbroken\b", None),
    ("DEBUG", 2, r"\bfailing\b|\bthrows\b|\bcrash\b|\bexception\b", None),
    ("DEBUG", 1, r"\bdebug\b|\btrace\b|\bdiagnose\b", None),
    ("DEBUG", 4, r"not being called|not running|dropping|memory leak|cors error|stale data|slower", None),
    ("DEBUG", 2, r"\bwhat's wrong\b|\bsomething\s+(is\s+)?(weird|off|wrong)\b", None),
    ("DEBUG", 1, r"\b(is|was|returns?|being|comes? back)\s+(null|undefined)\b|\bnull pointer\b|\bundefined is not\b|\bintermittent\b", None),
    ("DEBUG", 1, r"make it better|make this better", None),
    ("SEARCH", 2, r"\bfind\b|\blocate\b|\bwhere\s+(is|are|does|do|can|should|did)\b", None),
    ("SEARCH", 2, r"which file|show me|list all", None),
    ("SEARCH", 2, r"\bcall\b|\bdepend\b|\binternally\b", None),
    ("SEARCH", 1, r"\bsymbol\b|\broute\b|\bendpoint\b", None),
    ("SEARCH", 2, r"\bwhere\s+is\s+(it\s+)?imported\b|\bwhat\s+imports\b|\bwho\s+imports\b", None),
    ("SEARCH", 2, r"\bwhat\s+(does\s+this\s+)?exports?\b|\bwho\s+exports\b", None),
    ("SEARCH", 1, r"\bdefined\b|\bdeclared\b", None),
    ("CREATE", 2, r"\bcreate\b|\bgenerate\b|\bscaffold\b", None),
    ("CREATE", 2, r"\bbuild\b|\bimplement\b|\bwrite\b", None),
    ("CREATE", 3, r"make a .*new|add a .*new|start a .*new", None),
    ("CREATE", 3, r"\bnew file\b|\bnew (module|component|service|controller|route|helper|util)\b", None),
    ("CHAT", 1, r"\bexplain\b|\bdescribe\b|\bsummarise\b|\bsummarize\b", None),
    ("CHAT", 1, r"\btranslate\b|\bwhat does\b|\bhow does\b", None),
    ("CHAT", 1, r"tell me about|what is the difference", None),
    ("CHAT", 1, r"\bok\b|\bthanks\b|\bthank you\b|\bgood job\b|\bdone\b|\bperfect\b", 80),
    ("CHAT", 1, r"looks good|that works|exactly right|got it|never mind|try again|not quite", 80),
]
#: The intent that wins among equals comes first.
INTENT_ORDER = ["DEBUG", "SEARCH", "CREATE", "PATCH", "CHAT"]

# Openings and phrases of a status report.
STATUS = [
    r"^done\b",
    r"^(the )?patch (was |has been )?applied",
    r"^(the )?log (has been |was )?removed",
    r"^(the |i've |i have )?(re-?indexed|verified|confirmed)",
    r"^(the )?graph has been re-?indexed",
    r"^(updated|modified|changed|renamed|refactored)\b",
    r"^(added|inserted|removed|deleted)\b",
    r"\bsuccessfully (applied|patched|updated|removed|added)\b",
    r"\bthe (file|function|method|class) (now|has been)\b",
    r"\bno (further|other) changes (needed|required)\b",
]
# Fixed value: what makes a short reply a task.
TASK = (
    r"\b(fix|add|remove|delete|rename|change|update|refactor|create|build|implement|write|extract|convert|move|split|inline|wrap|patch|debug"
    r"|investigate|check|test|run|deploy|install|optimi[sz]e|migrate)\b|\bwhy\s+(is|does|isn't|doesn't)\b|\bwhere\s+(is|are|does)\b"
    r"|\bnow\b.*\b(also|next|then)\b|\balso\b|\.(js|ts|py|go|rs|jsx|tsx|java|rb|cpp)\b"
)

# Content signals; a strong one adds 0.5, a weak one 0.1 (0.4 at most), a penalty takes 0.4.
CONTENT: dict[str, dict[str, list[str]]] = {
    "json": {
        "strong": [r'^[\s\n]*\{\s*"\w+":', r"^[\s\n]*\[\s*\{", r'^[\s\n]*\[\s*"[^"]*"\s*[,\]]'],
        "weak": [r":\s*\[", r":\s*\{", r'"(\w+)":', r"true\b", r"false\b", r"null\b"],
        "penalty": [r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=([^\"'\d{\[]|\z)", r"\bimport\s+\{[^}]+\}\s+from\s+['\"]", r"=>\s*\{", r"\bclass\s+\w+"],
    },
    "code": {
        "strong": [
            r"(?m)^(import|export)\s+(default\s+)?(function|class|const|let|var|\{)",
            r"(?m)^(const|let|var)\s+\w+\s*=",
            r"(?m)^(function|async function)\s+\w+\s*\(",
            r"(?m)^class\s+\w+(\s+extends\s+\w+)?\s*\{",
            r"(?m)^def\s+\w+\s*\(",
            r"(?m)^pub(lic)?\s+fn\s+\w+",
            r"(?m)^func\s+\w+",
            r'(?m)^#include\s*[<"]',
            r"(?m)^package\s+[\w.]+\s*;",
            r"(?m)^using\s+[\w.]+\s*;",
            r"(?m)^namespace\s+[\w.]+",
            r"(?m)^(public|private|protected|abstract|final|static)\s+(static\s+)?(class|interface|enum|record|void|[\w<>\[\]]+\s+\w+\s*\()",
            r"(?m)^require(_relative)?\s+['\"]",
            r"(?m)^class\s+\w+(\s*<\s*\w+)?\s*$",
            r"(?m)^<\?php",
        ],
        "weak": [r"[{};]", r"=>", r"===", r"!==", r"\?\?", r"\b(if|while|for|switch|try|catch|throw)\b", r"(?m)^\s*//.+$", r"(?ms)^\s*/\*.*?\*/"],
        "penalty": [r"(?m)^diff --git\s", r"(?m)^@@\s+-\d+,\d+\s+\+\d+,\d+ @@"],
    },
    "log": {
        "strong": [
            r"(?m)^[\d\-T:Z.]+\s+(INFO|WARN|ERROR|DEBUG|TRACE)",
            r"(?m)^\[[\d\-T:Z.]+\]\s+",
            r"(?m)^\[(INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL|CRITICAL)\]",
            r"(?i)\blevel[=:][\"']?(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)",
            r"(?m)^\s+at\s+.+\(.+:\d+:\d+\)\s*$",
            r"(?m)^Traceback \(most recent call last\):",
            r'(?m)^\s+File ".+", line \d+, in ',
        ],
        "weak": [r"(?m)^\d{2}:\d{2}:\d{2}", r"(?i)\b(exception|stacktrace)\b", r"(?m)^\s*at\s+\w+[\w.]+\s*\(", r"(?m)^\s*\[\d+\]\s+"],
        "penalty": [r"(?m)^(import|export)\s+", r"(?m)^(const|let|var|function|class)\s+", r"(?m)^def\s+\w+\s*\(", r"(?m)^pub(lic)?\s+fn\s+"],
    },
    "diff": {
        "strong": [r"(?m)^diff --git\s", r"(?m)^@@\s+-\d+,\d+\s+\+\d+,\d+ @@", r"(?m)^--- a/.+\n\+\+\+ b/.+"],
        "weak": [r"(?m)^\+([^+\n]|\+([^+]|\z))", r"(?m)^-([^-\n]|-([^-]|\z))", r"(?m)^@@\s+"],
        "penalty": [r"(?m)^#{1,6} ", r"(?m)^(import|export|const)\s+"],
    },
    "markdown": {
        "strong": [r"(?m)^#{1,6} \w", r"(?m)^```\w*\s*$", r"(?m)^\[.{1,80}\]\(https?://", r"(?m)^---\s*$"],
        "weak": [r"(?m)^[-*+] \w", r"(?m)^\d+\. \w", r"\*\*\w+.*?\*\*", r"`[^`]+`"],
        "penalty": [r"(?m)^(import|export|const|let|var)\s+", r"(?m)^diff --git", r'^[\s\n]*\{\s*"\w+":'],
    },
}
SAMPLE, LEAST_SCORE, MARGIN = 1024, 0.35, 0.3


def intent_scores(text: Column) -> dict[str, Column]:
    scores = {i: F.lit(0) for i in INTENT_ORDER}
    for intent, weight, pattern, longest in INTENTS:
        hit = text.rlike(f"(?i){pattern}")
        if longest:
            hit = hit & (F.length(text) <= longest)
        scores[intent] = scores[intent] + F.when(hit, weight).otherwise(0)
    return scores


def intent(text: Column) -> tuple[Column, Column, Column]:
    """(winner, its score, confidence): CHAT without any signal; confidence is the margin over the runner-up as a share of the winner's score."""
    scores = intent_scores(text)
    ranked = F.array_sort(F.array(*[F.struct((-scores[i]).alias("s"), F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in enumerate(INTENT_ORDER)]))
    best, second = ranked[0], ranked[1]
    confidence = F.when(best["s"] == 0, 0.0).otherwise((second["s"] - best["s"]) / -best["s"])
    return F.when(best["s"] == 0, "CHAT").otherwise(best["i"]), -best["s"], confidence


def is_status(text: Column) -> Column:
    head = F.substring(F.trim(text), 1, 200)
    return head.rlike("(?i)" + "|".join(f"(?:{p})" for p in STATUS))


def samples(text: Column) -> Column:
    """The whole text up to three windows, else its head, middle and tail."""
    n = F.length(text)
    parts = F.array(F.substring(text, 1, SAMPLE), F.substr(text, F.floor(n / 2).cast("int") - SAMPLE // 2 + 1, F.lit(SAMPLE)), F.right(text, F.lit(SAMPLE)))
    return F.when(n <= 3 * SAMPLE, F.array(text)).otherwise(parts)


def content_scores(parts: Column) -> dict[str, Column]:
    def hit(pattern: str) -> Column:
        return F.exists(parts, lambda s: s.rlike(pattern)).cast("int")

    scores = {}
    for kind, signal in CONTENT.items():
        strong, weak, penalty = (sum((hit(p) for p in signal[k]), F.lit(0)) for k in ("strong", "weak", "penalty"))
        tenths = strong * 5 + F.least(weak, F.lit(4)) - penalty * 4
        scores[kind] = F.least(F.greatest(tenths, F.lit(0)), F.lit(10))
    scores["_code_strong"] = sum((hit(p) for p in CONTENT["code"]["strong"]), F.lit(0))
    return scores


def content_kind(s: dict[str, Column], text: Column) -> Column:
    """json, code, log, diff, markdown or text, from scores in tenths."""
    bare = F.trim(text)
    first, last = F.substring(bare, 1, 1), F.right(bare, F.lit(1))
    whole = (first == "{") & (last == "}") | (first == "[") & (last == "]")
    margin = round(MARGIN * 10)
    by_code = F.when(s["diff"] > s["code"] + margin, "diff").when(s["json"] > s["code"] + margin, "json").otherwise("code")
    best = F.greatest(*[s[k] for k in CONTENT])
    winner = F.when(best < LEAST_SCORE * 10, "text")
    for kind in CONTENT:
        winner = winner.when(s[kind] == best, kind)
    return F.when(whole & (s["json"] > s["code"]), "json").when(s["_code_strong"] > 0, by_code).otherwise(winner)


def sql_literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"
