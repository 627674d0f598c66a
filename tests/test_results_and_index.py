"""JSON sampling and chunking, the stored text index and the vault's tiers, against plain Python."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import chunking
from millrace.operators import json_arrays, ranking, vault_retrieval
from millrace.sources.shared import shared_folder
from millrace.sources.text_index import TextIndex


def compact(x):
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def is_error(x):
    if isinstance(x, str):
        return bool(re.search(json_arrays.ERROR_TEXT[4:], x, re.I))
    if not isinstance(x, dict):
        return False
    first = lambda *names: next((x[n] for n in names if x.get(n) is not None), None)
    status, level, code = first("status", "state", "result", "outcome"), first("level", "severity"), first("exitCode", "exit_code")
    return bool(
        isinstance(status, str) and status.lower() not in json_arrays.OK_STATUS or isinstance(level, str) and level.lower() in json_arrays.ERROR_LEVELS or any(x.get(k) not in (None, False, "") or x.get(k) == 0 and x.get(k) is not False for k in json_arrays.ERROR_KEYS)
        or any(x.get(k) is False for k in ("success", "ok", "passed")) or x.get("failed") is True or isinstance(code, (int, float)) and not isinstance(code, bool) and code != 0
    )


ITEMS = [
    None, 7, True, [1], "all fine", "Connection refused", "failure", {"status": "OK"}, {"status": "broken"}, {"status": None, "state": "lost"}, {"status": 5}, {"level": "WARN"}, {"severity": "info"}, {"error": None}, {"error": ""}, {"error": 0},
    {"err": False}, {"exception": {"a": 1}}, {"stack": []}, {"success": False}, {"ok": True}, {"passed": False}, {"failed": True}, {"failed": False}, {"exitCode": 0}, {"exit_code": 2}, {"exitCode": "2"}, {"failureMessage": "x"}, {"result": "done", "error": "y"}, {},
]


def test_error_items(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(ITEMS)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", json_arrays.is_error(F.try_parse_json("t")).alias("e")).collect()}
    assert [ITEMS[i] for i in got if got[i] != is_error(ITEMS[i])] == []


def sample(items, terms, how):
    """{index: priority} by the rules, in plain Python."""
    n = len(items)
    fields = {}
    for i, x in enumerate(items):
        for k, v in (x.items() if isinstance(x, dict) else ()):
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                fields.setdefault(k, []).append((i, v))
    odd = set()
    for entries in fields.values():
        m = sum(v for _, v in entries) / len(entries)
        sd = math.sqrt(sum((v - m) ** 2 for _, v in entries) / len(entries))
        if len(entries) >= n / 2 and sd:
            odd |= {i for i, v in entries if abs(v - m) > how.sigma * sd}
    text = lambda x: (x if isinstance(x, str) else compact(x)).lower()
    hits = sorted((-sum(t in text(x) for t in terms), i) for i, x in enumerate(items))
    keep = {i: 0 for i in [*range(how.head), *range(n - how.tail, n)]}
    for priority, bucket in ((1, [i for i in range(n) if is_error(items[i])]), (2, [i for s, i in hits if s][: how.query_top]), (3, sorted(odd))):
        for i in bucket:
            if len(keep) < how.max_keep:
                keep.setdefault(i, priority)
    return keep


def test_sample_and_crush(spark):
    r = random.Random(2)
    how = json_arrays.Sampling(min_chars=300, max_keep=20, min_saved=100)
    texts, want = [], {}
    for i in range(40):
        items = [{"id": k, "status": r.choice(["ok"] * 9 + ["bad"]), "v": r.choice([1, 2, 3, 900.5]), **({"w": k} if k % 3 else {}), "name": r.choice(["needle", "straw", "größe"])} for k in range(r.choice([5, 30, 60, 90]))]
        items[1] = r.choice([None, "a timeout", 5, {"error": "x"}])
        value = items if i % 2 else {"z": [1, 2], "rows": items, "few": list(range(29)), "note": 'a "quoted" key'}
        texts.append((i, json.dumps(value, ensure_ascii=False), ["needle", "9"]))
        if len(items) >= 30:
            want[i] = (sample(items, ["needle", "9"], how), items)
    texts += [(100, None, []), (101, "no json " * 100, []), (102, "[1,2", None), (103, '[VAULT:x]' + "[1]" * 200, []), (104, json.dumps(list(range(400))), None), (105, json.dumps({"_note": "vault_id=vault_1", "a": list(range(300))}), [])]
    want[104] = (sample(list(range(400)), [], how), list(range(400)))
    df = spark.createDataFrame(texts, "id int, text string, terms array<string>")
    got = {x["id"]: {p["index"]: p["priority"] for p in x["picked"]} for x in json_arrays.sample_arrays(df, "id", "text", "terms", how).collect()}
    assert got == {i: k for i, (k, items) in want.items() if len(k) < len(items)}
    for x in json_arrays.crush(df, "id", "text", "terms", how).collect():
        keep, items = want[x["id"]]
        value = json.loads(x["crushed"])
        rows = value["rows"] if isinstance(value, dict) else value
        assert rows[:-1] == [items[i] for i in sorted(keep)] and x["vault_id"] in rows[-1]["_note"]
        assert x["kept"] == len(keep) and x["total"] == len(items) and (x["path"] == "rows") == isinstance(value, dict)
        if isinstance(value, dict):
            assert value["note"] == 'a "quoted" key' and value["z"] == [1, 2]
    again = json_arrays.crush(json_arrays.crush(df, "id", "text", "terms", how).select("id", F.col("crushed").alias("text")), "id", "text", None, how)
    assert again.count() == 0  # what is cut is left alone


def windows(text, n, overlap=0):
    lines = [x for x in text.split("\n") if x.strip()]
    out = ["\n".join(lines[max(0, i - overlap) : i + n]).strip() for i in range(0, len(lines), n)]
    return [c for c in out if len(c) >= 200]


def prose(text):
    chunks, current = [], ""
    for p in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        if len(current + p) > 1200 and len(current) > 200:
            chunks.append(current.strip())
            current = p
        else:
            current += ("\n\n" if current else "") + p
    return chunks + ([current.strip()] if current.strip() else [])


def loose(text):
    chunks, current, depth = [], [], 0
    for line in text.split("\n"):
        current.append(line)
        depth += sum(line.count(c) for c in "{[") - sum(line.count(c) for c in "}]")
        if depth <= 1 and re.match(r"^\s*},?\s*$", line) or len(current) >= 60:
            chunks.append("\n".join(current).strip())
            current = []
    return [c for c in chunks + ["\n".join(current).strip()] if len(c) >= 200]


def packed(value):
    chunks, current = [], {}
    for k in sorted(value):
        current[k] = value[k]
        if len(compact(current)) > 1200:
            chunks.append(compact(current))
            current = {}
    return [c for c in chunks + ([compact(current)] if current else []) if len(c) >= 200]


def test_chunks(spark):
    r = random.Random(4)
    para = lambda n: " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    texts = {
        "prose": ["\n\n".join(para(r.choice([3, 40, 150, 300])) for _ in range(r.randrange(1, 12))) for _ in range(20)] + [para(20000), "", "  \n\n ", "short"],
        "logs": ["\n".join(f"12:0{k % 10}:11 INFO {para(4)}" for k in range(n)) for n in (1, 20, 21, 77)],
        "code": ["import os\n" + "\n".join(f"x = {para(3)}" for _ in range(n)) for n in (5, 24, 60)],
        "json": [json.dumps([{"k": para(4), "n": k} for k in range(n)]) for n in (0, 3, 10, 31)] + [json.dumps({f"key{k}": para(r.choice([2, 60, 400])) for k in range(n)}) for n in (1, 9, 20)] + ["{\n" + "\n".join(f'"a{k}": {{\n"b": "{para(30)}"\n}},' for k in range(30)) + "\n[oops", "{\n" + "\n".join('"x": 1,' * 4 for _ in range(150))],
    }
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "id int, kind string, text string")
    got = {x["id"]: (x["k"], x["c"]) for x in df.select("id", chunking.chunk_type(F.col("text")).alias("k"), chunking.chunk_text(F.col("text"), chunking.chunk_type(F.col("text"))).alias("c")).collect()}
    for i, kind, text in rows[:-1]:
        if kind == "json":
            try:
                value = json.loads(text)
                chunks = packed(value) if isinstance(value, dict) else [c for c in (compact(value[j : j + 10]) for j in range(0, len(value), 10)) if len(c) >= 200]
            except ValueError:
                chunks = loose(text)
        else:
            chunks = {"prose": prose, "logs": lambda t: windows(t, 20, 3), "code": lambda t: windows(t, 25, 3)}[kind](text)
        chunks = [c for c in chunks if len(c) >= 200] if chunks else windows(text, 50)
        assert got[i] == (kind, chunks), (i, kind)


# the stored index


def brute(docs, queries):
    """{(query, id): score} by the formula."""
    toks = {i: [t.lower() for t in re.findall(r"[A-Za-z0-9_-]{2,}", x or "")] for i, x in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / max(1, len(docs))
    df = Counter(t for x in toks.values() for t in set(x))
    out = {}
    for q, text in queries.items():
        for i, x in toks.items():
            s = 0.0
            for t in re.findall(r"[A-Za-z0-9_-]{2,}", text or ""):
                f = x.count(t.lower())
                if f:
                    s += math.log((n - df[t.lower()] + 0.5) / (df[t.lower()] + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / avg))
            if s > 0:
                out[q, i] = s
    return out


def test_text_index(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice("red green blue cyan teal Gold the".split()) for _ in range(r.randrange(0, 12)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    queries = {1: "red gold gold", 2: "", 3: "nothing", 4: "the BLUE teal", 5: None}
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=4)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = lambda: {(x["query_id"], x["id"]): x["score"] for x in index.search(asked).collect()}
    assert got() == {}
    docs = {i: text() for i in range(60)} | {60: None, 61: ""}
    index.write(1, frame(docs).union(spark.createDataFrame([(None, "red")], "id long, text string")))
    assert got() == pytest.approx(brute(docs, queries))
    new = {i: text() for i in range(50, 75)}
    docs |= new
    index.write(2, frame(new))
    index.write(2, frame(new))  # the same write again
    assert got() == pytest.approx(brute(docs, queries))
    for i in (1, 5, 50, 70):
        docs.pop(i)
    index.write(3, spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1,), (5,), (50,), (70,), (777,), (None,)], "id long"))
    assert got() == pytest.approx(brute(docs, queries))
    index.compact(4)
    assert index.segments() == [4] and got() == pytest.approx(brute(docs, queries))
    docs[1] = "red again"
    index.write(5, frame({1: "red again"}))
    assert got() == pytest.approx(brute(docs, queries))
    stats = index.statistics().first()
    assert stats["n"] == len(docs)


def test_index_reads_its_buckets_only(spark):
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=8)
    index.write(1, spark.createDataFrame([(i, f"word{i} other{i % 3}") for i in range(50)], "id long, text string"))
    found = index.search(spark.createDataFrame([(1, "word7")], "query_id long, text string"))
    assert [x["id"] for x in found.collect()] == [7]
    assert "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()


def test_bm25_tokenises_once_a_pass(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, None), (3, "blue")], "doc_id long, text string")
    found = ranking.bm25(docs, ["red", "blue", "green"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # rows, statistics
    assert {x["doc_id"] for x in found.collect()} == {1, 3}


# the vault's tiers


def test_vault_tiers(spark):
    chunks = spark.createDataFrame([("v1", "v1c0", 0, "alpha one"), ("v1", "v1c1", 1, "alpha two " + "x" * 300), ("v1", "v1c2", 2, "omega"), ("v2", "v2c0", 0, "")], "vault_id string, chunk_id string, chunk_index int, text string")
    raw = spark.createDataFrame([("v1", "raw one"), ("v3", "raw three"), ("v4", "")], "vault_id string, text string")
    files = spark.createDataFrame([("src/a.js", "\r\n".join(f"line {k}" for k in range(1, 101)))], "path string, text string")
    asked = [
        (1, "v1", None, None), (2, "v3", "omega", None), (3, None, "look at src/a.js line 50", None), (4, None, "src\\a.js line: 500 omega", None), (5, "v9", "omega", "alpha"), (6, None, None, "alpha two"),
        (7, None, "ghost", None), (8, None, "", ""), (9, None, "silence", None), (10, "v4", "src/a.js Line 1", None), (11, None, "faint", None),
    ]
    requests = spark.createDataFrame(asked, "request_id long, vault_id string, query string, context string")
    known = {"v1c0": "alpha one", "v1c1": "alpha two", "v1c2": "omega", "gone": "ghost story " * 100}
    index = TextIndex(spark, shared_folder(spark, "index"), id_type="string", buckets=4)
    inline = spark.createDataFrame(list(known.items()), "id string, text string")
    index.write(1, inline)
    dense = spark.createDataFrame([(11, "v1c2", 0.4), (9, "v1c0", 0.2), (6, "v1c2", 0.9)], "request_id long, id string, sim double")
    got = {r["request_id"]: r for r in vault_retrieval.retrieve(requests, chunks, raw, files, index.search, inline, dense).collect()}
    assert {i: r["tier"] for i, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3, 7: 4, 8: 6, 9: 6, 10: 2, 11: 5}
    assert got[1]["text"].startswith("[Vault v1]\n\n[Chunk 0]\nalpha one\n\n[Chunk 1]\nalpha two") and got[2]["text"] == "[Vault v3]\n\nraw three"
    lines = got[3]["text"].split("\n")
    assert lines[0] == "[File slice: src/a.js lines 35–75]" and lines[2] == "  35 | line 35" and lines[-1] == "  75 | line 75"
    assert got[10]["text"].startswith("[File slice: src/a.js lines 1–26]")
    assert got[5]["text"].startswith("[Vault v9 — retrieved via semantic search]\n\n[Chunk 2 (score: 70%)]\nomega\n\n[Surrounding Context]\nalpha two " + "x" * 190)
    assert got[7]["text"] == "[Semantic search results]\n\n[Chunk 1 (score: 70%)]\n" + known["gone"][:500]
    assert got[11]["text"] == "[Low-threshold search results]\n\n[Chunk 2 (score: 30%)]\nomega" and got[8]["text"] is None
    assert "[Chunk 2 (score: 30%)]" in got[6]["text"]  # by its vector alone
