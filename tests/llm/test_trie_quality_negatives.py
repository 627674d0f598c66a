"""Prefix trie, line quality and hard negatives against brute force, with nulls, empties, ties, repeats, long rows and clashing names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives, line_quality, prefix_trie, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, path string, _c int"


def same_as_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name, table", [("op11_prefix_trie", "conversations"), ("op13_hard_negatives", "embeddings")])
def test_sql(spark, name, table):
    same_as_sql(spark, name, table)


# prefix trie


def nodes_of(paths):
    """Brute force: {prefix: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)} of {conv_id: ((role, text), ...)}."""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = {k: ",".join(str(c) for c in sorted(m) if paths[c] == k) for k, m in members.items()}
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()
    )


def plain_nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def rebuilt(own):
    """{conv_id: turns} by the rule of op11, from {conv_id: turns}."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(base, ())[:h]) + tuple(turns[h:])
    return out


def test_trie(spark):
    r = random.Random(11)
    own = {c: [(r.choice(["user", ""]), r.choice(["a", "ä" * 3, "", "long " * 5000])) for _ in range(r.randrange(1, 9))] for c in [*range(120), -3, -5, 2**40]}
    own |= {500 + i: [("user", "hot")] * (2 if i % 3 else 3) for i in range(150)}  # a large group of copies
    own[1000] = [("user", str(i)) for i in range(3000)]  # a long one
    rows = [(c, t if t else None, role or None, text or None, "clash", 1) for c, turns in own.items() for t, (role, text) in enumerate(turns)]
    rows.append((None, 1, "user", "nobody's", "clash", 1))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    want = nodes_of(rebuilt(own))
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert plain_nodes(prefix_trie.rebuilt_trie(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plain_nodes(prefix_trie.trie(prefix_trie.turn_arrays(df))) == nodes_of({c: tuple(t) for c, t in own.items()})
    assert prefix_trie.rebuilt_trie(df.limit(0)).count() == 0


def test_trie_ties(spark):
    """Turns of one number are in a set order, whatever the rows' order."""
    rows = [(1, 0, "user", x, "", 0) for x in "cab"] + [(2, 0, "user", x, "", 0) for x in "bca"] + [(1, None, "user", "c", "", 0)] * 2
    got = plain_nodes(prefix_trie.trie(prefix_trie.turn_arrays(spark.createDataFrame(rows, TURNS))))
    assert max(n[1] for n in got) == 5
    rows = [(1, 0, "user", x, "", 0) for x in "cab"] + [(2, 0, "user", x, "", 0) for x in "bca"]
    got = plain_nodes(prefix_trie.trie(prefix_trie.turn_arrays(spark.createDataFrame(rows, TURNS))))
    assert [n[:4] for n in got] == [(1, 0, -1, 2), (1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 1, 2)]


@pytest.mark.parametrize("wait", [1, 2, 20_000])
def test_sweep_and_stitch(monkeypatch, wait):
    """Any cut of the sorted rows into partitions gives the same nodes, and wide nodes too."""
    monkeypatch.setattr(prefix_trie, "WAIT", wait)
    r = random.Random(wait)
    for _ in range(40):
        paths = {c: tuple(("u", r.choice("abc")) for _ in range(r.randrange(0, 5))) for c in r.sample(range(-50, 50), r.randrange(1, 40))}
        coded = sorted((b"".join(hashlib.sha256(t[1].encode()).digest()[:16] for t in p), c, p) for c, p in paths.items())
        cuts = sorted(r.randrange(len(coded) + 1) for _ in range(r.randrange(6)))
        rows, stitch = [], prefix_trie.Stitch()
        for pid, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(coded)])):
            s = prefix_trie.Sweep(pid)
            for path, c, p in coded[a:b]:
                s.add(path, np.array([len(t[1].encode()) for t in p]), c)
            s.end()
            rows += s.out
        for x in sorted((x for x in rows if x["kind"] == 1), key=lambda x: (x["pid"], x["side"])):
            stitch.add(x["path"], x["parts"])
        stitch.end()
        parent = {x["ref"]: x["conv_id"] for x in rows + stitch.out if x["kind"] == 3}
        ids = {}
        for x in sorted((x for x in rows if x["kind"] == 2), key=lambda x: (x["pid"], x["seq"])):
            ids.setdefault(x["key"], []).extend(np.frombuffer(x["ids"], np.int64).tolist())
        got = []
        for x in rows + stitch.out:
            if x["kind"] == 0:
                up = x.get("parent_conv_id", parent[x["ref"]] if "ref" in x else -1)
                ends = x.get("ends_sha256") or hashlib.sha256(",".join(map(str, ids.get(x.get("key"), []))).encode()).hexdigest()
                got.append((x["conv_id"], x["depth"], up, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], ends))
        assert sorted(got) == nodes_of(paths)


# line quality

GOOD = "The river ran past the old mill. Nobody had seen the miller since the spring, and the wheel stood still."
BAD = ["SPAM!! BUY!! NOW!! ONLY!! TODAY!!", "foo | bar | baz | qux | quux |", "word word word word word word word"]


def test_chain_is_exact():
    """Marginals, normaliser and gradient against all labellings of short texts."""
    r = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2])
    u, move = r.normal(size=11), r.normal(size=(2, 2))
    chain = line_quality.Chain(sizes)
    p, (_, _, z) = chain.marginals(u, move), chain.run(u, move)
    at = 0
    for i, n in enumerate(sizes):
        total, good = 0.0, np.zeros(n)
        for labels in np.ndindex(*[2] * n):
            w = np.exp(sum(u[at + k] * y for k, y in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
        assert np.allclose(p[at : at + n], good / total)
        assert np.isclose(z[i], np.log(total) if n else 0)
        at += n
    x, y = r.normal(size=(11, 4)), np.array([1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0])
    w, m = line_quality.fit_chain(x, sizes, y, np.ones(5), ridge=0.05)

    def value(w, m):
        _, _, z = chain.run(x @ w, m)
        out, at = 0.0, 0
        for i, n in enumerate(sizes):
            labels = y[at : at + n]
            out += (z[i] - (x @ w)[at : at + n] @ labels - sum(m[a, b] for a, b in zip(labels, labels[1:]))) / max(n, 1)
            at += n
        return out + 0.05 * (w @ w + (m * m).sum())

    best = value(w, m)
    for _ in range(50):
        assert value(w + r.normal(size=4) * 0.05, m + r.normal(size=(2, 2)) * 0.05) >= best - 1e-6


def test_line_features():
    texts = [None, "", "\n \n\t", GOOD, f"{BAD[0]}\n\n{GOOD}\n{GOOD}", "x" * 3_000_000, "😀 \U0001f600", "a\r\nb\x00c"]
    alone = [next(line_features) for line_features in (line_quality.line_features([t]) for t in texts)]
    together = list(line_quality.line_features(texts))
    assert [n for n, _, _ in together] == [0, 0, 0, 1, 3, 1, 1, 2]
    for a, b in zip(alone, together):
        assert np.array_equal(a[1], b[1]) and np.allclose(a[2], b[2])
    assert together[3][1][0] == sum(not c.isspace() for c in GOOD)
    x = together[4][2]
    assert np.array_equal(x[1][:-2], x[2][:-2]) and x[2][-1] == 1 and x[1][-1] == 0  # only the line before differs
    z = line_quality.with_neighbours(x, np.array([2, 0, 1]))
    k = line_quality.BASE
    assert np.array_equal(z[0, 2 * k : 3 * k], x[1]) and not z[1, 2 * k : 3 * k].any() and z[2, 3 * k] == z[2, 3 * k + 1] == 1


def quality_tables(spark):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        lines = [" ".join(r.sample(GOOD.split(), 12)).capitalize() + "." for _ in range(r.randrange(1, 7))]
        if not good:
            kind = r.choice(BAD).split()
            lines[r.randrange(len(lines)) :] = [" ".join(r.choices(kind, k=25)) for _ in range(r.randrange(4, 9))]
        rows.append((i, "\n".join(lines), "en", 1.0))
        marks.append((i, int(good), 0))
    rows += [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (1002, " \n", "en", 1.0), (None, rows[0][1], "en", 1.0), (1, rows[1][1], "en", 1.0), (1003, GOOD * 20_000, "en", 1.0)]
    marks += [(None, 1, 0), (5, None, 0), (1001, 0, 0), (9999, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict(m[:2] for m in marks[:300])


def test_quality(spark):
    docs, labels, truth = quality_tables(spark)
    model = line_quality.fit(docs, labels, usable=F.col("doc_id") % 2 == 0)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in line_quality.score(docs, model).collect()]
    assert len(got) == docs.count() and all(0 <= p <= 1 and y == int(p >= 0.5) for _, p, y in got)
    held = [(truth[i], y) for i, _, y in got if i is not None and i < 300 and i % 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    by = {}
    for i, p, _ in got:
        by.setdefault(i, set()).add(p)
    assert len(by[1]) == 1 and by[None] == by[0] and by[1000] == by[1001] == by[1002]  # repeats, null and empty alike
    lines = line_quality.label_lines(docs, model).filter("doc_id < 300").collect()
    assert {r["label"] for r in lines} == {"good", "bad"}
    texts = {r["doc_id"]: r["text"].split("\n") for r in docs.filter("doc_id < 300").dropDuplicates(["doc_id"]).collect()}
    right = [(r["label"] == "good") == texts[r["doc_id"]][r["line"]].endswith(".") for r in lines if r["doc_id"] % 2]
    assert sum(right) >= 0.9 * len(right)


def test_quality_without_labels(spark):
    docs, labels, _ = quality_tables(spark)
    for marks, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert {r["score"] for r in line_quality.score(docs, line_quality.fit(docs, marks)).collect()} == {want}
    model = line_quality.fit(docs.limit(0), labels)
    assert line_quality.score(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    rows = queries.op12_line_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows) > 50


# hard negatives


def mined(rows, positives=5, negatives=3):
    """Brute force over (id, label, whole numbers)."""
    width = max(len(v) for _, _, v in rows)
    x = np.array([v + [0] * (width - len(v)) for _, _, v in rows], object)
    ids, labels = [i for i, _, _ in rows], [y for _, y, _ in rows]
    anchors = {}
    for i, y, v in rows:
        if i % 50 == 0 and (i not in anchors or (y, v) > (anchors[i][0], anchors[i][1])):
            anchors[i] = (y, v)
    out = []
    for a, (y, v) in anchors.items():
        s = x @ np.array(v + [0] * (width - len(v)), object)
        same = sorted((-s[j], ids[j]) for j in range(len(rows)) if labels[j] == y and ids[j] != a)[:positives]
        other = sorted((-s[j], ids[j]) for j in range(len(rows)) if labels[j] != y)
        for ps, p in set(same):
            near = [(ns, n) for ns, n in other if 50 * -ps <= 100 * -ns <= 95 * -ps][:negatives]
            out += [(a, p, k + 1, n, int(-ps), int(-ns)) for k, (ns, n) in enumerate(near)]
    return sorted(out)


def found(df, **kw):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in hard_negatives.hard_negatives(df, F.col("_id") % 50 == 0, **kw).collect())


VECTORS = "vec_id long, embedding array<double>, label int, _v string, block int"


def test_hard_negatives(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) + (i % 4 == 0) for _ in range(6)], r.randrange(3)) for i in range(-60, 700)]
    rows += [(2000 + i, [0.5] * 6, i % 2) for i in range(500)]  # one vector, many rows: ties by id, also among anchors
    rows += [(50, [0.25] * 5, 2), (3000, [], 1), (3001, [1.0] * 3, 0), (3050, [-9.0] * 6, 0)]  # shorter, empty, far from all
    want = mined([(i, y, [int(np.floor(256 * c)) for c in v]) for i, v, y in rows])
    odd = [(None, [1.0] * 6, 1), (4000, None, 1), (4050, [1.0, None] + [1.0] * 4, 1), (4100, [float("nan")] * 6, 1), (4150, [float("inf")] * 6, 1), (4200, [-1e300] * 6, 1), (4250, [1.0] * 6, None)]
    df = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows + odd], VECTORS).repartition(5)
    assert found(df, sample=40, block=400) == want
    assert found(df) == want
    assert found(df.limit(0)) == []


def test_large_numbers(spark):
    """Scores beyond the exact range of floats."""
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-(10**8), 10**8)) for _ in range(3)], i % 2) for i in range(600)]
    assert found(spark.createDataFrame([(i, v, y, "", 0) for i, v, y in rows], VECTORS), scale=1, sample=20, block=300) == mined([(i, y, [int(c) for c in v]) for i, v, y in rows])
