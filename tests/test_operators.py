"""Operators on small inputs written here."""

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from millrace.functions import signals, text
from millrace.operators import dedup, extract, graph, ranking, timeseries
from millrace.plans import registry
from millrace.sources.fixtures import code_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(registry.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm_the_rest_imports(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "millrace.llm", None)
    monkeypatch.setitem(sys.modules, "millrace.llm.queries", None)
    assert set(entry.queries()) == set(registry.queries())


def test_nothing_else_imports_llm():
    from conftest import ROOT

    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def test_gap_of_exactly_an_hour_joins(spark):
    t = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    ts = [t, t + h, t + 2 * h + dt.timedelta(microseconds=1)]
    df = spark.createDataFrame([(1, x) for x in ts], "k long, ts timestamp")
    assert sorted(r["n"] for r in timeseries.gap_sessions(df, "k", "ts", 60).collect()) == [1, 2]


@pytest.mark.parametrize("ts, week", [("2024-01-06 23:59:59", "2023-12-31"), ("2024-01-07 00:00:00", "2024-01-07"), ("2023-12-31 10:00:00", "2023-12-31")])
def test_weeks_start_on_sunday(spark, ts, week):
    got = spark.range(1).select(text.week_start(F.lit(ts).cast("timestamp")).cast("string")).first()[0]
    assert got == week


def test_rollup_deltas_sum_to_the_last_total(spark):
    df = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i * i)) for i in range(20)], "u long, i long, ts timestamp, total double")
    out = timeseries.rollup(df, "day", ["u"], "ts", ["total"], ["i"])
    assert out.agg(F.sum("delta_total")).first()[0] == 361.0


def test_compact_keeps_the_most_asked_for(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)], "u long, i long")
    kept = [r["i"] for r in timeseries.compact(df, "u", ["i"], 150).collect()]
    assert len(kept) == 150 and set(range(450, 500)) <= set(kept) and 0 in kept
    assert timeseries.compact(df.filter("i < 40"), "u", ["i"], 150).count() == 40


def test_fusion_with_all_weight_on_vectors_keeps_their_order(spark):
    d = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.7)], "id long, sim double")
    s = spark.createDataFrame([(2, 3.0), (4, 9.0)], "id long, score double")
    got = [r["id"] for r in ranking.fuse(d, s, "id", 1.0).orderBy(F.desc("score"), "id").collect()]
    assert got == [1, 3, 2, 4]


def test_bm25_of_no_terms_and_repeated_terms(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta"), (3, None)], "doc_id long, text string")
    assert ranking.bm25(df, []).count() == 0
    once, twice = (dict(rows(ranking.bm25(df, ["alpha"] * n))) for n in (1, 2))
    assert twice[1] == pytest.approx(2 * once[1])


def test_impact_of_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), (None, "a"), ("d", "c")], "source_symbol string, target_symbol string")
    assert rows(graph.impact(e, "a")) == [("a", 2), ("b", 1), ("c", 1), ("d", 2)]


def test_innermost_of_nested_spans(spark):
    p = spark.createDataFrame([("f", 5), ("f", 150), ("f", 900), ("g", 5)], "file string, line long")
    s = spark.createDataFrame([("f", 0, 200, "outer"), ("f", 4, 6, "inner")], "file string, a long, b long, name string")
    got = {(r["file"], r["line"]): r["container"] for r in graph.innermost(p, s, "file", "line", "a", "b", "name").collect()}
    assert got == {("f", 5): "inner", ("f", 150): "outer", ("f", 900): None, ("g", 5): None}


def test_hamming_pairs_equal_brute_force(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + base[:2]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = sorted((i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    assert rows(dedup.hamming_pairs(df, "id", "fp")) == want


def test_fnv_of_known_words(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    words = ["", "a", "token", "größe", "x" * 40]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(dedup.fnv64(F.col("w"))).collect()] == [fnv(w.encode()) for w in words]


def test_chunks_cover_all_lines(spark):
    df = spark.createDataFrame([(n, "\n".join(f"l{i}" for i in range(n))) for n in (1, 19, 20, 21, 60)], "doc_id long, text string")
    got = dedup.line_chunks(df, "doc_id", "text").collect()
    for n in (1, 19, 20, 21, 60):
        chunks = [r["chunk_text"].split("\n") for r in got if r["doc_id"] == n]
        assert len(chunks) == (n - 1) // 20 + 1
        assert {x for c in chunks for x in c} == {f"l{i}" for i in range(n)}


def test_keep_first_keeps_all_nulls(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None)], "id long, k long")
    assert rows(dedup.keep_first(df, ["k"], ["id"]).select("id")) == [(1,), (3,), (4,)]


@pytest.mark.parametrize(
    "message, want",
    [("now fix the broken auth, thanks for all the earlier help with it, it was really kind of you and so on", "DEBUG"), ("add a null check before this line", "PATCH"), ("create a file where we store config", "CREATE"), ("thanks", "CHAT"), ("where is the route defined", "SEARCH"), ("hm", "CHAT")],
)
def test_intents(spark, message, want):
    name, score, confidence = signals.intent(F.lit(message))
    got = spark.range(1).select(name.alias("i"), score.alias("s"), confidence.alias("c")).first()
    assert got["i"] == want and (got["s"] > 0 or got["c"] == 0)


@pytest.mark.parametrize(
    "content, want",
    [
        ('{"a": [1, 2], "b": {"c": null}}', "json"),
        ("import x from 'y';\nconst a = 1;\n", "code"),
        ("package a.b;\npublic class X {\n}\n", "code"),
        ("2024-01-01T10:00:00Z ERROR disk full\n2024-01-01T10:00:01Z INFO ok\n", "log"),
        ("Traceback (most recent call last):\n  File \"a.py\", line 3, in f\n", "log"),
        ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n", "diff"),
        ("# Title\n\n- one\n- two\n\n`code` and **bold**\n", "markdown"),
        ("a plain sentence of words", "text"),
    ],
)
def test_content_kinds(spark, content, want):
    t = F.lit(content)
    assert spark.range(1).select(signals.content_kind(signals.content_scores(signals.samples(t)), t)).first()[0] == want


def test_extraction(spark):
    files = code_files(spark)
    found = extract.symbols(files)
    by = {(r["path"], r["name"]): r for r in found.collect()}
    assert by["src/app.js", "start"]["is_exported"] and by["src/app.js", "start"]["start_line0"] == 4
    assert by["src/store/users.js", "loadUser"]["is_async"] and by["src/store/users.js", "saveUser"]["is_exported"]
    assert by["src/types.ts", "Hidden"]["is_exported"] and by["tools/load.py", "Loader"]["kind"] == "class"
    assert ("cmd/main.go", "Serve") in by and ("lib/shape.rs", "area") in by and ("Main.java", "Main") in by
    assert {r["key"] for r in extract.env_refs(files).collect()} == {"PORT", "DB_URL", "API_KEY", "DATABASE_URL"}
    assert {(r["method"], r["route"]) for r in extract.routes(files).collect()} == {("USE", "/api"), ("GET", "/health"), ("POST", "/users/:id")}
    names = {(r["module"], r["name"]) for r in extract.imports(files).collect()}
    assert {("./store/users", "loadUser"), ("./store/users", "saveUser"), ("express", "express"), ("os", "path"), ("std::fmt", "Display"), ("core.h", "core.h")} <= names
    assert ("src/app.js", "start", "loadUser") in set(map(tuple, extract.call_edges(files, found).collect()))
    assert "empty.js" in {r["path"] for r in extract.module_nodes(files, found).collect()}


def test_streams_equal_batches(spark, tmp_path):
    from millrace.streaming import events as st

    src = str(tmp_path / "in")
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = batch.agg(F.max("ts")).first()[0] + dt.timedelta(days=30)
    end = spark.createDataFrame([(-1, late, -1, "end", 0.0, None)], st.EVENTS)
    batch.unionByName(end).coalesce(1).write.parquet(src)
    for name, make in (("hourly", st.hourly), ("sessions", st.sessions)):
        q = st.start(make(st.read_events(spark, src)), "memory", name, str(tmp_path / name))
        q.awaitTermination()
        assert spark.table(name).filter("user_id >= 0").agg(F.sum("n")).first()[0] == batch.count()
    sessions = timeseries.gap_sessions(batch, "user_id", "ts", 60)
    assert spark.table("sessions").filter("user_id >= 0").count() == sessions.count()
    q = st.start(st.unseen(st.read_events(spark, src)), "memory", "unseen", str(tmp_path / "unseen"))
    q.awaitTermination()
    assert spark.table("unseen").count() == batch.count() + 1
    q = st.start(st.running_means(st.read_events(spark, src)), "memory", "means", str(tmp_path / "means"), "update")
    q.awaitTermination()
    got = {r["user_id"]: r["n"] for r in spark.table("means").collect()}
    assert got == {r["user_id"]: r["n"] for r in batch.groupBy("user_id").agg(F.count("*").alias("n")).collect()} | {-1: 1}


def test_parsed_code():
    from millrace.functions import code

    source = "def f(a):\n    if a and a > 1 or not a:\n        return 1\n    return [x for x in a]\n\nasync def g():\n    try:\n        pass\n    except E:\n        pass\n"
    f, g = code.functions_of(source)
    assert (f["name"], f["complexity"], f["is_async"], f["end_line0"]) == ("f", 5, False, 3) and g["is_async"] and g["has_try"]
    assert code.functions_of("def (") == [] and code.skeleton_of(source) == source
    long = "def h():\n" + "\n".join(f"    line{i} = {i}" for i in range(30)) + "\nafter = 1"
    assert code.skeleton_of(long) == "def h():\n    line0 = 0\n    line1 = 1\n    # ... 28 lines\nafter = 1"


def test_diffs_and_prefixes():
    from millrace.functions import code

    assert code.diff_of("a\nb\nc\nd", "a\nx\nc\nd") == " a\n-b\n+x\n c"
    assert code.diff_of("a", "a") == "" and code.diff_of("", "a") == "-\n+a"
    assert code.static_prefix_of("Rules.\nDate: 2024-01-01\nCurrent state:\n  - one\n  - two\nMore rules.") == "Rules.\nMore rules."
