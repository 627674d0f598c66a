"""Streams of files and of sessions against the tables they amount to; mounts, terminal output, and the graph after changes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import mounts, terminal
from millrace.streaming import reindex, vault_sessions
from millrace.streaming.events import start

T0 = datetime(2024, 1, 1)


def test_sessions_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    schema = "session_id long, ts timestamp, row_id long, tokens long, vault string, retrieved string"
    rows, clock = [], T0
    for i in range(240):
        clock += timedelta(minutes=r.choice([1, 5, 20]))
        if i == 120:
            clock += timedelta(hours=5)  # all sessions idle: state is dropped
        fetch = r.random() < 0.2
        v = f"v{r.randrange(4)}"
        rows.append((r.randrange(3), clock, i, r.choice([100, 18_000, 50_000]), None if fetch else v, v if fetch else None))
    for k in range(0, 240, 40):  # a file for each batch, with the last row of the one before again, out of order within the batch
        part = rows[max(0, k - 1) : k + 40]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get(vault_sessions.PROVIDER)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        vault_sessions.offers_stream(stream)
    spark.conf.set(vault_sessions.PROVIDER, vault_sessions.ROCKS)
    try:
        start(vault_sessions.offers_stream(stream), str(tmp_path / "out"), "offers", str(tmp_path / "checkpoint")).awaitTermination(240)
    finally:
        spark.conf.set(vault_sessions.PROVIDER, old)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = vault_sessions.offers(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x["offered"] for x in want} == {True, False}


FIRST = [("a.js", "javascript", "export function one() {\n  return 1;\n}\n", 1), ("b.js", "javascript", "function two() {\n  one();\n  three();\n}\n", 1), ("c.js", "javascript", "function three() {}\n", 1)]
SECOND = [("a.js", "javascript", "export function one() {\n  return 1;\n}\n", 2), ("b.js", "javascript", "function two() {\n  return 'nothing-here';\n}\nfunction four() { two(); }\n", 2), ("b.js", "javascript", "late copy", 1), ("c.js", "javascript", None, 2), ("d.js", "javascript", "four(three());\nfunction five() {\n  four();\n}\n", 2)]


def test_file_stream(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([(p, la, s, T0 + timedelta(days=m)) for p, la, s, m in rows], reindex.FILES)
    uses = spark.createDataFrame([(1, "a.js"), (1, "b.js"), (2, "c.js"), (3, "x.js"), (4, None)], "cache_id long, path string")
    store = reindex.GraphStore(spark, str(tmp_path / "graph"), uses)
    assert store.current("symbols").count() == 0 and store.stale().count() == 0
    state = lambda: ({(x["path"], x["name"], x["batch"]) for x in store.current("symbols").collect()}, {(x["path"], x["caller"], x["callee"]) for x in store.current("calls").collect()}, {(x["cache_id"], x["path"], x["batch"]) for x in store.stale().collect()})
    for rows in (FIRST, SECOND):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store.follow(str(tmp_path / "in"), str(tmp_path / "checkpoint"), 1).awaitTermination(200)
        if rows is FIRST:
            assert state() == ({("a.js", "one", 0), ("b.js", "two", 0), ("c.js", "three", 0)}, {("b.js", "two", "one"), ("b.js", "two", "three")}, {(1, "a.js", 0), (1, "b.js", 0), (2, "c.js", 0)})
    want = ({("a.js", "one", 0), ("b.js", "two", 1), ("b.js", "four", 1), ("d.js", "five", 1)}, {("b.js", "four", "two"), ("d.js", "five", "four")}, {(1, "a.js", 0), (1, "b.js", 0), (2, "c.js", 0)})
    assert state() == want and store.batches() == [0, 1]
    store.index(frame(SECOND), 1)  # the same batch twice
    assert state() == want and store.batches() == [0, 1]
    store.index(frame(SECOND), 2)  # the same files in a later one
    assert state() == want and store._read("files", [2]).count() == 0


def test_mounts(spark):
    rows = [
        ("app.js", "api.js", "/old", 1), ("app.js", "api.js", "/api", 2), ("api.js", "users.js", "/users", 1), ("users.js", "deep.js", "/deep", 1), ("other.js", "deep.js", "/lost", 0),
        ("x.js", "y.js", "/y", 1), ("y.js", "x.js", "/x", 1), (None, "z.js", "/z", 1), ("users.js", "deep.js", "/deep", 1),
    ]
    df = spark.createDataFrame(rows, "parent string, child string, prefix string, place int")
    got = {r["path"]: (r["prefix"], r["depth"]) for r in mounts.mount_prefixes(df).collect()}
    assert got == {"app.js": ("", 0), "api.js": ("/api", 1), "users.js": ("/api/users", 2), "deep.js": ("/api/users/deep", 3)}  # other.js lost its only mount
    chain = spark.createDataFrame([(f"f{i}", f"f{i + 1}", "/a", 0) for i in range(6)], "parent string, child string, prefix string, place int")
    assert max(r["depth"] for r in mounts.mount_prefixes(chain, 6).collect()) == 6
    with pytest.raises(Exception, match="longer than 5|RECURSION"):
        mounts.mount_prefixes(chain, 5).collect()
    assert mounts.mount_prefixes(df.limit(0)).count() == 0


def test_terminal(spark):
    bars = [f"[####----------] {k}%" for k in range(9)]
    texts = {
        1: ("\x1b[?25l\x1b[1mbold\x1b[0m \x1b]0;t\x1b\\x\x1b(B", "bold x"),
        2: ("\n".join(["begin", *bars, "end"]), "begin\n[####----------] 8%  [8 progress lines collapsed]\nend"),
        3: ("\n".join(["a", *bars[:2], "b", *bars[:3], *["⠋"] * 2, "", "45 %", "46 % (1/2)"]), "a\n" + "\n".join(bars[:2]) + "\nb\n[5 progress lines collapsed]\n\n45 %\n46 % (1/2)"),
        4: ("  );\n}\n)\n]\nexport", ");\n}\n)\n]\nexport"),
        5: ("10%\r50%\r100% done \nnpm timing x\nkeep  \n\n\n\nend\n", "100% done\nkeep\n\nend"),
        6: ("", ""),
        7: (None, None),
        8: ("10%\r\r\n\r\n" + "\n".join(f"{k}%" for k in range(5)), "10%\r\r\n\r\n4%  [4 progress lines collapsed]".replace("\r", "")),
    }
    df = spark.createDataFrame([(i, t, 0) for i, (t, _) in texts.items()], "id int, text string, i int").drop("i")
    got = {r["id"]: r["text"] for r in terminal.scrub(df, ["id"], "text").collect()}
    assert {i: got[i] for i in texts if i != 8} == {i: w for i, (_, w) in texts.items() if i != 8}
    assert got[8].endswith("4%  [4 progress lines collapsed]") or "collapsed]" in got[8]


def test_resolver(spark):
    from millrace.operators import resolver

    entries = [
        ("symbol", "doWork", "function", "a.js", 1, True, 5), ("symbol", "dowork", "function", "b.js", 2, False, 0), ("symbol", "reDoWorkNow", "class", "c.js", 3, False, 9), ("literal", "doWork", "x", "d.js", 4, None, None),
        ("literal", "x-amz-date", "header", "d.js", 5, None, None), ("env_var", "AWS_KEY", None, "e.js", 6, None, None), ("symbol", "AWS_KEY", "const", "e.js", 7, True, 1), ("route", "/api/users", None, "f.js", 8, None, None),
        ("route", "/api/users/:id", None, "f.js", 9, None, None), ("symbol", "", "module", "g.js", 1, False, 0), ("symbol", "dup", "function", "h.js", 1, False, 2), ("symbol", "dup", "function", "h.js", 1, False, 2),
    ] + [("symbol", f"zed{i:02d}", "function", "z.js", i, False, i) for i in range(30)]
    table = spark.createDataFrame(entries, "type string, name string, node_kind string, file string, line long, is_exported boolean, complexity int")
    texts = ["doWork", "'doWork'", "Work", "process.env.AWS_KEY", "AWS_KEY", "GET /api/users", "api/users", "x-amz", "nothing", "", "zed", "a%b", "dup", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    rows = resolver.resolve(queries, table).collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
        by.setdefault(x["query_id"], []).append(x)
    names = lambda i: [(x["type"], x["name"]) for x in by[i]]
    assert names(0) == names(1) == [("symbol", "doWork")]  # exact: no literals, no guesses
    assert names(2) == [("symbol", "reDoWorkNow"), ("symbol", "doWork"), ("literal", "doWork"), ("symbol", "dowork")] or set(names(2)) == {("symbol", "doWork"), ("symbol", "dowork"), ("symbol", "reDoWorkNow"), ("literal", "doWork")}
    assert all(x["score"] < 0.75 for x in by[2])
    assert names(3)[0] == ("env_var", "AWS_KEY") and len(names(3)) == 1 and names(4) == names(3)
    assert by[5][0]["name"] == "/api/users" and by[5][0]["score"] == pytest.approx(1.15) and len(by[5]) == 2 and names(6) == names(5)
    assert names(7) == [("literal", "x-amz-date")]
    assert by[8][0]["rank"] == 0 and by[8][0]["needs_fallback"] and by[9][0]["kind"] == "empty" and by[11][0]["rank"] == 0
    assert len(by[10]) == 10 and by[10][0]["name"] == "zed29" and len(by[12]) == 1 and set(by) == set(range(14))


def test_sql_functions(spark):
    from millrace.functions.sql import register

    register(spark)
    one = spark.sql("SELECT canonical_path('A\\\\B.js') AS p, char_tokens('12345') AS t, search_terms('Ab c x-1') AS s, occurrences('aXaX', 'aX') AS o, occurrences('a', '') AS z, hamming64(7, 0) AS h, token_budget('ab\\ncdefgh', 1) AS b, short_hash(NULL) AS n").first()
    assert (one["p"], one["t"], one["s"], one["o"], one["z"], one["h"], one["b"], one["n"]) == ("a/b.js", 2, ["ab", "x-1"], 2, None, 3, "ab", None)
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_lines('a\\n\\nb') ORDER BY line").collect()] == [(1, "a"), (2, ""), (3, "b")]
    rows = [(k, T0 + timedelta(minutes=m)) for k, ms in {"a": [0, 60, 121, 122], "b": [5]}.items() for m in ms] + [(None, T0)]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz").createOrReplaceTempView("gaps")
    got = {(r["session_key"], r["events"]) for r in spark.sql("SELECT * FROM gap_sessions(TABLE(SELECT * FROM gaps WHERE k IS NOT NULL) PARTITION BY k ORDER BY (ts), 60)").collect()}
    assert got == {("a", 2), ("a", 2), ("b", 1)}
    got = {(r["name"], r["is_exported"]) for r in spark.sql("SELECT s.* FROM VALUES ('javascript', 'function a() {}\\nexport class B {}\\nfunction a() {}'), ('cobol', 'x'), ('go', NULL) AS f(l, t), LATERAL extract_symbols(l, t) s").collect()}
    assert got == {("a", False), ("B", True)}
