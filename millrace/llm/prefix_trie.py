"""Prefix trie of conversations from one global sort: adjacent common prefixes, a stack sweep, open stacks stitched across partitions.

A conversation is the array of its turns; a turn is known by 16 bytes of SHA-256 over role and text, so texts stay where they are.
Arrays are range-sorted over all partitions (equal ones by id, so that copies are split too). Each partition sweeps its rows once: the common
prefix with the row before says which nodes close and which open. A node that closes is whole, unless it is a prefix of the partition's
first or last array: those spines are passed on as partial nodes and stitched in order of the partitions, one stack for all, two rows for each
partition. A node's children wait for its least member; if more than ``WAIT`` do, or the node is on a spine, they get it by a join.
The digest of a node's own ids can't be merged, so ids that end on a spine are passed on in blocks and hashed in order, one node after the other.

* Turns go by turn (null first); equal turns of a conversation in order of their digests. Null role or text counts as empty.
* Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root. Other columns aren't read.
* A conversation without turns ends at the root. Repeated rows are repeated turns.
* A conversation is one row of 24 bytes a turn in its task; a partition's sweep holds its stack, ``WAIT`` children a node, and 8 bytes for each member
  that ends at the node at hand. Texts of any length are read once.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

STEP = 16  #: bytes of a turn
WAIT = 20_000  #: children that wait for their parent's least member
BLOCK = 1 << 16  #: ids of a block
EMPTY = hashlib.sha256(b"").hexdigest()

PART = "struct<depth: int, conv_id: long, n_convs: long, bytes: long, children: long, leaves: long, saved: long, ref: long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
SWEPT = f"kind int, {NODE}, ends_sha256 string, ref long, pid int, side int, path binary, parts array<{PART}>, key binary, seq int, ids binary"
STITCHED = f"kind int, {NODE}, ref long, key binary"


class _Node:
    __slots__ = ("depth", "conv_id", "n", "bytes", "children", "leaves", "saved", "ids", "waiting", "ref", "spine", "refs", "key")

    def __init__(self, depth: int, n_bytes: int, spine: bool = False):
        self.depth, self.bytes, self.spine = depth, n_bytes, spine
        self.conv_id = self.ref = self.key = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ids, self.waiting, self.refs = array("q"), [], []

    def met(self, conv_id: int | None, n: int) -> None:
        """``n`` more members, the least of which is ``conv_id``."""
        self.n += n
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id

    def row(self) -> dict:
        """The node with all its subtree known."""
        self.saved += (self.n - 1) * self.bytes
        self.leaves = self.leaves if self.children else 1
        return {"kind": 0, "conv_id": self.conv_id, "depth": self.depth, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved}

    def above(self, parent: _Node) -> None:
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved


def common(a: bytes, b: bytes) -> int:
    """The number of turns that two arrays begin with alike."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def node_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * STEP]).digest()[:16]


class Sweep:
    """One partition's rows (path, sizes of the turns, conv_id) in order; ``out`` gathers rows of ``SWEPT``."""

    def __init__(self, pid: int):
        self.pid, self.serial = pid, 0
        self.out: list[dict] = []
        self.stack: list[_Node] = []
        self.path: bytes | None = None
        self.first: bytes | None = None
        self.first_parts: list[dict] = []

    def ref(self, node: _Node) -> int:
        if node.ref is None:
            node.ref = (self.pid << 40) + self.serial
            self.serial += 1
        return node.ref

    def part(self, node: _Node) -> dict:
        return {"depth": node.depth, "conv_id": node.conv_id, "n_convs": node.n, "bytes": node.bytes, "children": node.children, "leaves": node.leaves, "saved": node.saved, "ref": node.ref}

    def leave(self, node: _Node) -> None:
        """Children that wait at ``node`` go out with a reference to it."""
        if node.waiting:
            r = self.ref(node)
            self.out += [w | {"ref": r} for w in node.waiting]
            node.waiting = []

    def open_end(self, node: _Node, path: bytes) -> None:
        """What is known of a node of a spine goes out: its children, and the ids that end at it."""
        self.leave(node)
        ids = np.frombuffer(node.ids, np.int64) if node.ids else ()
        for i in range(0, len(ids), BLOCK):
            self.out.append({"kind": 2, "key": node_key(path, node.depth), "pid": self.pid, "seq": i // BLOCK, "ids": ids[i : i + BLOCK].tobytes()})

    def close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1]
        parent.met(node.conv_id, node.n)
        if node.spine:
            self.open_end(node, self.first)
            self.first_parts.append(self.part(node))
            return
        self.out += [w | {"parent_conv_id": node.conv_id} for w in node.waiting]
        if node.ref is not None:
            self.out.append({"kind": 3, "ref": node.ref, "conv_id": node.conv_id})
        row = node.row() | {"ends_sha256": hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if node.ids else EMPTY}
        node.above(parent)
        parent.waiting.append(row)
        if len(parent.waiting) >= WAIT:
            self.leave(parent)

    def add(self, path: bytes, sizes: np.ndarray, conv_id: int) -> None:
        fresh = self.path is None
        if fresh:
            self.first = path
            self.stack.append(_Node(0, 0, True))
        else:
            keep = common(self.path, path)
            while self.stack[-1].depth > keep:
                self.close()
        self.stack += [_Node(d + 1, int(sizes[d]), fresh) for d in range(self.stack[-1].depth, len(path) // STEP)]
        self.stack[-1].met(conv_id, 1)
        self.stack[-1].ids.append(conv_id)
        self.path = path

    def end(self) -> None:
        if self.path is None:
            return
        last = []
        while self.stack:
            node = self.stack.pop()
            if self.stack:
                self.stack[-1].met(node.conv_id, node.n)
            self.open_end(node, self.path)
            last.append(self.part(node))
        for side, path, parts in ((0, self.first, self.first_parts), (1, self.path, last)):
            if parts:
                self.out.append({"kind": 1, "pid": self.pid, "side": side, "path": path, "parts": parts[::-1] if side else sorted(parts, key=lambda p: p["depth"])})


class Stitch:
    """The spines of all partitions in order; ``out`` gathers rows of ``STITCHED``."""

    def __init__(self):
        self.out: list[dict] = []
        self.stack: list[_Node] = []
        self.path = b""

    def close(self) -> None:
        node = self.stack.pop()
        self.out += [w | {"parent_conv_id": node.conv_id} for w in node.waiting]
        self.out += [{"kind": 3, "ref": r, "conv_id": node.conv_id} for r in node.refs]
        row = node.row() | {"key": node.key}
        if self.stack:
            node.above(self.stack[-1])
            self.stack[-1].waiting.append(row)
        else:
            self.out.append(row)

    def add(self, path: bytes, parts: list[dict]) -> None:
        keep = common(self.path, path)
        while self.stack and self.stack[-1].depth > keep:
            self.close()
        self.path = path
        for d in range(len(self.stack), len(path) // STEP + 1):
            self.stack.append(_Node(d, 0))
            self.stack[-1].key = node_key(path, d)
        for p in parts:
            node = self.stack[p["depth"]]
            node.met(p["conv_id"], p["n_convs"])
            node.bytes = p["bytes"]
            node.children += p["children"]
            node.leaves += p["leaves"]
            node.saved += p["saved"]
            if p["ref"] is not None:
                node.refs.append(p["ref"])

    def end(self) -> None:
        while self.stack:
            self.close()


def _batches(rows: list[dict], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], schema)
    rows.clear()


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def turn_arrays(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row per conversation: _c, path (``STEP`` bytes a turn) and sizes (bytes of each turn's text).

    With ``base`` and ``head`` (columns over _c), conversation c begins with the first ``head`` turns of conversation ``base``, followed by
    its own turns after its first ``head``. Conversations of one base must be few: they meet in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    turns = conversations.select(F.col(id_col).cast("long").alias("_c"), F.struct(F.col(turn_col).alias("t"), digest.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("turn")).filter("_c IS NOT NULL")
    if base is None:
        per = turns.groupBy("_c").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        return per.select("_c", F.unhex(F.array_join(F.col("turns.d"), "")).alias("path"), F.col("turns.n").alias("sizes"))
    per = turns.withColumn("_b", base).repartition("_b").groupBy("_b", "_c").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    of_base = F.first(F.when(F.col("_b") == F.col("_c"), F.col("turns")), ignorenulls=True).over(Window.partitionBy("_b"))
    h = head.cast("int")
    rebuilt = per.withColumn("start", of_base).select(
        "_c", F.concat(F.coalesce(F.slice("start", F.lit(1), h), F.slice("turns", 1, 0)), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns")
    )
    return rebuilt.select("_c", F.unhex(F.array_join(F.col("turns.d"), "")).alias("path"), F.col("turns.n").alias("sizes"))


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of conversations given by ``turn_arrays``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = arrays.sparkSession
    small_batches(spark, 4096)
    swept, stitched = _arrow(spark, SWEPT), _arrow(spark, STITCHED)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sweep(TaskContext.get().partitionId())
        for b in batches:
            at, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            for i, (path, conv_id) in enumerate(zip(b.column(1).to_pylist(), b.column(0).to_pylist())):
                s.add(path, flat[at[i] : at[i + 1]], conv_id)
                if len(s.out) >= 10_000:
                    yield from _batches(s.out, swept)
        s.end()
        yield from _batches(s.out, swept)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stitch()
        for b in batches:
            for r in b.to_pylist():
                s.add(r["path"], r["parts"])
                if len(s.out) >= 10_000:
                    yield from _batches(s.out, stitched)
        s.end()
        yield from _batches(s.out, stitched)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids in order of (key, pid, seq) to a digest of each key."""
        key, state, done = None, None, []
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state, comma = k, hashlib.sha256(), b""
                state.update(comma + ",".join(map(str, array("q", ids))).encode())
                comma = b","
            if done:
                yield pa.record_batch([pa.array([d[i] for d in done]) for i in (0, 1)], names=["key", "ends_sha256"])
                done = []
        if key is not None:
            yield pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    rows = cut(arrays.repartitionByRange("path", "_c").sortWithinPartitions("path", "_c").mapInArrow(sweep, SWEPT))
    spines = rows.filter("kind = 1").select("pid", "side", "path", "parts").repartition(1).sortWithinPartitions("pid", "side")
    joined = cut(spines.select("path", "parts").mapInArrow(stitch, STITCHED))
    blocks = rows.filter("kind = 2").select("key", "ids", "pid", "seq").repartition("key").sortWithinPartitions("key", "pid", "seq")
    ends = blocks.select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")
    refs = rows.filter("kind = 3").select("ref", "conv_id").unionByName(joined.filter("kind = 3").select("ref", "conv_id")).select(F.col("ref"), F.col("conv_id").alias("parent"))
    columns = [c.split()[0] for c in NODE.split(", ")] + ["ends_sha256"]
    nodes = rows.filter("kind = 0")
    whole = nodes.filter("ref IS NULL").select(columns)
    waiting = nodes.filter("ref IS NOT NULL").join(refs, "ref").withColumn("parent_conv_id", F.col("parent")).select(columns)
    spine = joined.filter("kind = 0").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(columns)
    return whole.unionByName(waiting).unionByName(spine)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt from their neighbours: c begins with the first h turns of c - c % 5, h = crc32(c) % 9."""
    c = F.col("_c")
    return trie(turn_arrays(conversations, base=c - c % 5, head=F.crc32(c.cast("string")) % 9))


OP11_SQL = """
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS a,
    (4294967295 - list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
      lambda v, b: list_reduce([xor(v, b)] || range(8), lambda w, i: xor(w >> 1, 3988292384 * (w & 1))))) % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.c, coalesce(b.a[1:o.h], []) || o.a[o.h + 1:] AS p FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
members AS (SELECT c, p, d, p[1:d] AS k FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, any_value(d) AS d, min(c) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(p) = d), '')) AS ends
  FROM members GROUP BY k),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (
  SELECT s.k, s.d, coalesce(c.n, 0) AS n_children, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN s.d = 0 THEN 0 ELSE (s.n - 1) * strlen(s.k[s.d].x) END AS saved
  FROM nodes s LEFT JOIN children c ON c.k = s.k),
sums AS (
  SELECT k[1:e] AS k, sum(leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT k, leaf, saved, unnest(range(d + 1)) AS e FROM own_sums) GROUP BY 1)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, o.n_children::BIGINT AS n_children,
  t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
FROM nodes s JOIN own_sums o ON o.k = s.k JOIN sums t ON t.k = s.k LEFT JOIN nodes p ON s.d > 0 AND p.k = s.k[1:s.d - 1]
"""
