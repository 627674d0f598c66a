"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of e edits an item is split into e + 1 pieces; any text within e edits of the item holds one of
the pieces unchanged. The pieces of all items form one Aho-Corasick automaton that reads each whole document once.
Every hit proposes a place for its item, which Myers' bit-parallel distance verifies: the least number of
insertions, deletions and substitutions between the item and any stretch of the document around that place. The pieces
are the leaves of a tree of halves, each with its share of the budget, and a hit is verified from its leaf up, so most
chance hits end at a stretch twice the piece's length.

Texts and items are compared in lower case with white space runs as one space. Null counts as empty; empty items
match nothing. Items go to the tasks in blocks of at most about ``block_bytes`` (one pass over the documents for each),
so what is sent has a bound whatever the size of the benchmark.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, text_of


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(start: int, end: int, budget: int, above: tuple = ()) -> list[tuple[int, int, tuple]]:
    """(start, end, nodes above) of the ``budget + 1`` pieces of an item's stretch; nodes are (start, end, budget).

    A stretch with budget e is halved into parts with budgets that sum to e - 1, so one part keeps within its own; this
    goes on to pieces with budget 0. A piece that is found leads up only while each node above holds within its budget.
    Shorter stretches than pieces are wanted give fewer pieces.
    """
    if budget == 0 or end - start < 2:
        return [(start, end, above)]
    left = budget // 2
    middle = start + max(1, (end - start) * (left + 1) // (budget + 1))
    above = ((start, end, budget), *above)
    return pieces(start, middle, left, above) + pieces(middle, end, budget - left - 1, above)


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` nearest to a pattern of ``m`` characters; the first of equals.

    ``pattern_bits``: for each character, the bits of the places where the pattern has it.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus = down | (~(diag | up) & full)
        minus = up & diag
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (~(diag | plus) & full)
        down = plus & diag
        if score < best:
            best, end = score, i + 1
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.bits: dict[tuple[int, int, int], dict[str, int]] = {}
        at: dict[str, list[tuple[int, int, tuple]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for start, end, above in pieces(0, len(t), int(len(t) * share)):
                at[t[start:end]].append((k, start, above))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def nearest(self, k: int, start: int, end: int, budget: int, text: str, at: int) -> tuple[int, int] | None:
        """(distance, end in ``text``) of an item's stretch near the place ``at`` of its item, if within ``budget``."""
        bits = self.bits.get((k, start, end))
        if bits is None:
            bits = self.bits[k, start, end] = bits_of(self.items[k][1][start:end])
        a = max(0, at + start - budget)
        d, e = myers(bits, end - start, text[a : max(0, at + end + budget)])
        return (d, a + e) if d <= budget else None

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of each item within its budget, at its nearest place."""
        if not self.items:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (n, places) in self.automaton.iter(text):
            for k, start, above in places:
                if k in best and best[k][0] == 0:
                    continue
                at = end + 1 - n - start
                pattern = self.items[k][1]
                if at >= 0 and text.startswith(pattern, at):
                    best[k] = (0, at + len(pattern))
                    continue
                if (k, at) in tried or not above:
                    continue
                for s, e, budget in above:
                    found = self.nearest(k, s, e, budget, text, at)
                    if found is None:
                        break
                else:
                    tried.add((k, at))
                    best[k] = min(found, best.get(k, found))
        return sorted((self.items[k][0], *x) for k, x in best.items())


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """Lists of (id, text) of at most about ``block_bytes`` each."""
    rows = text_of(items, item_id, item_text).filter("_text <> ''").withColumn("_size", F.octet_length("_text") + 64)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("_text"), F.lit(n)) == k)
        yield [(r["_id"], r["_text"]) for r in part.select("_id", "_text").collect()]


_MATCHERS: dict[tuple[str, float], Matcher] = {}


def _matcher(shared, share: float) -> Matcher:
    """The matcher of a broadcast block, built once in a worker; the block's name tells it from others."""
    name, items = shared.value
    if (name, share) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name, share] = Matcher(items, share)
    return _MATCHERS[name, share]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.1, block_bytes: int = 4 << 20
) -> DataFrame:
    """(id_col, item_id, distance, end): a row for each document and item found in it within ``share`` edits a character.

    Repeated documents and repeated items give repeated rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, distance int, end long"
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            matcher = _matcher(shared, share)
            rows, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in matcher.find(text):
                    rows.append(i)
                    hits.append(hit)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            item, distance, end = zip(*hits) if hits else ((), (), ())
            return pa.record_batch([ids, pa.array(item, pa.int64() if kinds[1] in ("bigint", "long") else None), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], names=[id_col, item_id, "distance", "end"])

        part = map_arrow(text_of(docs, id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            matcher = _matcher(shared, share)
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return batch.filter(pa.array([not matcher.find(t or "") for t in texts], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
