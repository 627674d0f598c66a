"""Classification, scrubbing and error- and outlier-preserving sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signals
from ..functions.text import occurrences
from ..sources.tables import table
from .registry import query

OUT_SQL = "s AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM events)"


def _with_spread(events: DataFrame) -> DataFrame:
    """Mean and population deviation of each type: a small aggregate joined back, with no window over a type's rows."""
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return events.join(stats, "event_type")


@query("outliers_2sigma", f"WITH {OUT_SQL} SELECT event_id, event_type, value FROM s WHERE abs(value - m) > 2 * sd")
def outliers_2sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_spread(table(spark, sf_dir, "events")).filter("abs(value - m) > 2 * sd").select("event_id", "event_type", "value")


ERROR_WORDS = r"\b(error|fail(ed|ure)?|exception|fatal|timeout|denied|refused)\b"


@query("error_items", f"SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '(?i){ERROR_WORDS}') OR CAST(json_extract(props, '$.k') AS INTEGER) = 13")
def error_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error words in the type, or an exit code (here 13) in the properties."""
    code = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").filter(F.col("event_type").rlike(f"(?i){ERROR_WORDS}") | F.coalesce(code == 13, F.lit(False))).select("event_id", "event_type")


@query(
    "priority_sample",
    f"""WITH {OUT_SQL}, r AS (SELECT user_id, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, event_type = 'error' AS err, CASE WHEN contains(event_type, 'click') THEN 1 ELSE 0 END AS hit, abs(value - m) > 2 * sd AS out FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hit DESC, i) AS qr FROM r),
    p AS (SELECT *, CASE WHEN i <= 3 OR i > n - 2 THEN 0 WHEN err THEN 1 WHEN hit > 0 AND qr <= 10 THEN 2 WHEN out THEN 3 END AS pri FROM q),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pri, i) AS rank FROM p WHERE pri IS NOT NULL) SELECT user_id, event_id, pri AS priority FROM k WHERE rank <= 25 OR pri = 0""",
)
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client, a list of at most 25: its ends, then errors, then the ten best matches, then outliers."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _with_spread(table(spark, sf_dir, "events")).select(
        "user_id", "event_id", F.row_number().over(by_time).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"),
        (F.col("event_type") == "error").alias("err"), F.contains("event_type", F.lit("click")).cast("int").alias("hit"), F.expr("abs(value - m) > 2 * sd").alias("out"),
    )
    rows = rows.withColumn("qr", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("hit"), "i")))
    rows = rows.withColumn("priority", F.expr("CASE WHEN i <= 3 OR i > n - 2 THEN 0 WHEN err THEN 1 WHEN hit > 0 AND qr <= 10 THEN 2 WHEN out THEN 3 END")).filter("priority IS NOT NULL")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("priority", "i")))
    return ranked.filter("k <= 25 OR priority = 0").select("user_id", "event_id", "priority")


@query("status_summary", f"WITH {OUT_SQL} SELECT event_type AS status, count(*) AS n FROM s WHERE NOT abs(value - m) > 2 * sd GROUP BY event_type ORDER BY n DESC, status LIMIT 3")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest states of the rows that a sample leaves out."""
    left = _with_spread(table(spark, sf_dir, "events")).filter("NOT abs(value - m) > 2 * sd")
    return left.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status").limit(3)


def _content_sql() -> str:
    def hit(p: str) -> str:
        return f"CASE WHEN list_bool_or(list_transform(parts, lambda s: regexp_matches(s, {signals.sql_literal(p)}))) THEN 1 ELSE 0 END"

    cols = []
    for kind, sig in signals.CONTENT.items():
        strong, weak, penalty = (" + ".join(hit(p) for p in sig[k]) for k in ("strong", "weak", "penalty"))
        cols.append(f"least(greatest(({strong}) * 5 + least({weak}, 4) - ({penalty}) * 4, 0), 10) AS s_{kind}")
    cols.append(f"{' + '.join(hit(p) for p in signals.CONTENT['code']['strong'])} AS strong")
    return f"""WITH p AS (SELECT doc_id, text, CASE WHEN length(text) <= 3072 THEN [text] ELSE [substr(text, 1, 1024), substr(text, length(text) // 2 - 512 + 1, 1024), right(text, 1024)] END AS parts FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, text, {', '.join(cols)} FROM p),
    g AS (SELECT *, greatest(s_json, s_code, s_log, s_diff, s_markdown) AS best, trim(text) AS t FROM f)
    SELECT doc_id, CASE WHEN ((t[1] = '{{' AND t[-1] = '}}') OR (t[1] = '[' AND t[-1] = ']')) AND s_json > s_code THEN 'json'
      WHEN strong > 0 THEN CASE WHEN s_diff > s_code + 3 THEN 'diff' WHEN s_json > s_code + 3 THEN 'json' ELSE 'code' END
      WHEN best < 3.5 THEN 'text' WHEN s_json = best THEN 'json' WHEN s_code = best THEN 'code' WHEN s_log = best THEN 'log' WHEN s_diff = best THEN 'diff' ELSE 'markdown' END AS kind FROM g"""


@query("classify_content", _content_sql())
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores are made once, in a projection of their own."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    parts = docs.select("doc_id", "text", signals.samples(F.col("text")).alias("parts"))
    scores = signals.content_scores(F.col("parts"))
    scored = parts.select("doc_id", F.concat(F.substring(F.trim("text"), 1, 1), F.right(F.trim("text"), F.lit(1))).alias("ends"), *[v.alias(k) for k, v in scores.items()])
    return scored.select("doc_id", signals.content_kind({k: F.col(k) for k in scores}, F.col("ends")).alias("kind"))


@query(
    "junk_kind",
    """WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines, substr(text, length(text) // 2 + 1, 2000) AS mid FROM documents)
    SELECT doc_id, CASE WHEN length(text) > 2000 AND len(lines) > 0 AND len(list_filter(lines, lambda x: length(x) > 200)) / len(lines)::DOUBLE > 0.8 THEN 'minified'
      WHEN length(text) >= 2000 AND length(regexp_replace(mid, '[A-Za-z0-9+/=\\s]', '', 'g')) / greatest(length(mid), 1)::DOUBLE < 0.02 AND regexp_matches(mid, '[A-Za-z0-9+/]{120,}') THEN 'base64' ELSE 'none' END AS junk FROM l WHERE text IS NOT NULL""",
)
def junk_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly very long lines, or one blob; lengths are parameters."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    mid = F.substr(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(2000))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.length(text).alias("n"), F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: F.length(x) > 200)).alias("long"), mid.alias("mid"))
    other = F.length(F.regexp_replace("mid", r"[A-Za-z0-9+/=\s]", "")) / F.greatest(F.length("mid"), F.lit(1))
    kind = F.when((F.col("n") > 2000) & (F.col("lines") > 0) & (F.col("long") / F.greatest(F.col("lines"), F.lit(1)) > 0.8), "minified")
    kind = kind.when((F.col("n") >= 2000) & (other < 0.02) & F.col("mid").rlike("[A-Za-z0-9+/]{120,}"), "base64").otherwise("none")
    return rows.select("doc_id", kind.alias("junk"))


@query(
    "scrub_terminal",
    r"""SELECT conv_id, turn, rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(27) || '[1;32m' || coalesce(text, '') || chr(27) || '[0m' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'end  ', '\x1b\[[0-9;?]*[A-Za-z]', '', 'g'), '\x1b\][^\x07\x1b]*(\x07|\x1b\\)', '', 'g'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS scrubbed FROM conversations""",
)
def scrub_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour codes, window titles, carriage returns and runs of empty lines go; here texts are wrapped in some first."""
    text = F.concat(F.lit("\x1b[1;32m"), F.coalesce("text", F.lit("")), F.lit("\x1b[0m\r\n\n\n\nend  "))
    for pattern, new in ((r"\x1b\[[0-9;?]*[A-Za-z]", ""), (r"\x1b\][^\x07\x1b]*(\x07|\x1b\\)", ""), (r"\r\n?", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.rtrim(text).alias("scrubbed"))


@query("sentence_truncation", "SELECT doc_id, rtrim(regexp_extract(substr(text, 1, 150), '(?s)^.*[.!?]', 0)) AS kept FROM documents")
def sentence_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sentences within the first 150 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.rtrim(F.regexp_extract(F.substring("text", 1, 150), r"(?s)^.*[.!?]", 0)).alias("kept"))


VOTES = {"de": [" der ", " die ", " und ", "ß"], "en": [" the ", " and ", " of "], "es": [" de ", " la ", "ñ", "ó"], "fr": [" le ", " la ", "è", "ç"]}


def _votes_sql() -> str:
    score = lambda words: " + ".join(f"(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END)" for w in words)
    cols = ", ".join(f"{score(w)} AS {k}" for k, w in VOTES.items())
    pick = " ".join(f"WHEN {k} = m THEN '{k}'" for k in VOTES)
    return f"WITH v AS (SELECT doc_id, {cols} FROM documents WHERE text IS NOT NULL), g AS (SELECT *, greatest({', '.join(VOTES)}) AS m FROM v) SELECT doc_id, CASE WHEN m = 0 THEN 'unknown' {pick} END AS voted FROM g"


@query("language_votes", _votes_sql())
def language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring votes; the first in the alphabet wins among equals."""
    votes = {k: sum((F.contains("text", F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in VOTES.items()}
    scored = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", *[v.alias(k) for k, v in votes.items()])
    most = F.greatest(*VOTES)
    pick = F.when(most == 0, "unknown")
    for k in VOTES:
        pick = pick.when(F.col(k) == most, k)
    return scored.select("doc_id", pick.alias("voted"))


@query("query_score", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT) AS score FROM documents WHERE text IS NOT NULL ORDER BY 2 DESC, doc_id LIMIT 10")
def query_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ("the", "license", "token")), F.lit(0))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("occurrence_counts", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", occurrences(F.col("text"), "the").alias("n"))


@query("json_properties", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "fat_result_decision",
    """SELECT doc_id, CASE WHEN length(text) > 6000 THEN 'vault' WHEN doc_id % 10 < 2 AND length(text) <= 4 * 1500 THEN 'keep_recent' WHEN length(text) > 1500 THEN 'vault' ELSE 'keep' END AS action,
    CASE WHEN length(text) > 1500 THEN substr(text, 1, 200) END AS preview FROM documents WHERE text IS NOT NULL""",
)
def fat_result_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized results go to the vault behind a preview; recent ones get four times the room."""
    action = F.expr("CASE WHEN length(text) > 6000 THEN 'vault' WHEN doc_id % 10 < 2 AND length(text) <= 4 * 1500 THEN 'keep_recent' WHEN length(text) > 1500 THEN 'vault' ELSE 'keep' END")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", action.alias("action"), F.when(F.length("text") > 1500, F.substring("text", 1, 200)).alias("preview"))
