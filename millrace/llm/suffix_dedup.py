"""Removal of repeated substrings with suffix order: every byte covered by a string of ``width`` bytes that also starts
anywhere else, in the same document or another.

Building one suffix order of a whole corpus column by column takes as many rounds as its longest document has bytes,
each a pass over everything. The order is therefore built only where strings can repeat, on strings of bounded length:

1. Anchors. In each stretch of ``width`` bytes the place with the least hash of 32 bytes is an anchor, so two equal
   stretches have an anchor at the same offset. Only stretches with an anchor that occurs again can repeat.
2. Contexts. All stretches that hold an anchor lie within a fixed distance of it. Anchors whose contexts are all equal
   need nothing more, and equal contexts are one string with a weight.
3. Suffix order. The distinct contexts of an anchor, at most ``group_limit``, go to one task, which builds the
   Burrows-Wheeler transform and the common prefixes column by column (``bwt``), one symbol of each context a round, and
   reads repeats off them. Equal stretches have equal distance from their anchor, so contexts are aligned there.
4. Anchors with more distinct contexts (a passage in a large part of all documents) are too much for one task. There
   ranges of stretches are narrowed by counting: a range whose whole span occurs again is covered, one whose common
   part occurs only once is not, any other is cut in four. Each level is a distributed count, and exact.

Texts are named by 128 bits of hash, equal texts being one text that occurs several times. Null text counts as empty.
Rows of any number may share text or id; every row gets its result. Memory of a task: one text, or one batch of contexts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import shared_windows
from .cdc import gear
from .common import bucket, map_arrow, shared_dir, small_batches, sorted_groups, text_of

GRAM = 32
BATCH = 4000  #: contexts whose suffix order is built together


def anchors(data: bytes, width: int) -> np.ndarray:
    """Starts of the GRAM bytes with the least hash in some stretch of ``width`` bytes; the first of equals."""
    n = width - GRAM + 1  # grams of a stretch
    if len(data) < width:
        return np.zeros(0, np.int64)
    h = gear(np.frombuffer(data, np.uint8))[GRAM - 1 :]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    low = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= n:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < n:
        low = np.minimum(low[: len(low) - (n - span)], low[n - span :])
    places = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_of(df, id_col, text_col).withColumns({"t1": F.xxhash64("_text"), "t2": F.xxhash64(F.lit(1), "_text")})


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def anchor_table(texts: DataFrame, width: int) -> DataFrame:
    """(t1, t2, p, s, e, h, c): anchor place, its context's ends, and hashes of anchor and context."""
    reach = width - GRAM

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, starts, ends, hs, cs = [], [], [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        for i, data in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            p = anchors(data, width)
            if not len(p):
                continue
            s, e = np.maximum(p - reach, 0), np.minimum(p + width, len(data))
            rows.append(np.full(len(p), i))
            places.append(p)
            starts.append(s)
            ends.append(e)
            hs += [digest(data[a : a + GRAM]) for a in p.tolist()]
            # the seed tells contexts apart that are cut at the ends of a text
            cs += [digest(data[a:b], k) for a, b, k in zip(s.tolist(), e.tolist(), (p - s).tolist())]
        if not rows:
            return pa.record_batch([pa.array([], pa.int64())] * 7, names=["t1", "t2", "p", "s", "e", "h", "c"])
        take = pa.array(np.concatenate(rows))
        cols = [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(np.concatenate(x)) for x in (places, starts, ends)], _signed(hs), _signed(cs)]
        return pa.record_batch(cols, names=["t1", "t2", "p", "s", "e", "h", "c"])

    return map_arrow(texts.select("t1", "t2", "_text"), run, "t1 long, t2 long, p long, s long, e long, h long, c long")


def _contexts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(h, many, weight, t1, t2, s, skip, context) of ``reps``; each text is read once, though it may stand in many rows."""
    wanted = reps.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "many", "weight", "s", "e", "skip")).alias("parts"))
    wanted = _stored(wanted, "wanted")
    bits = 18
    some = wanted.select(bucket(bits, F.col("t1"), F.col("t2")).alias("_b")).distinct()
    near = texts.withColumn("_b", bucket(bits, F.col("t1"), F.col("t2"))).join(F.broadcast(some), "_b", "left_semi").select("t1", "t2", "_text")
    joined = near.join(wanted, ["t1", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, text, parts in zip(*(batch.column(i) for i in range(4))):
                key = (t1.as_py(), t2.as_py())
                if key == last:
                    continue
                last = key
                data = text.as_py().encode("utf-8", "surrogatepass")
                out += [(x["h"], x["many"], x["weight"], *key, x["s"], x["skip"], data[x["s"] : x["e"]]) for x in parts.as_py()]
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds)], names=["h", "many", "weight", "t1", "t2", "s", "skip", "context"])

    return joined.select("t1", "t2", "_text", "parts").mapInArrow(run, "h long, many boolean, weight long, t1 long, t2 long, s long, skip long, context binary")


def _ordered(contexts: DataFrame, width: int) -> DataFrame:
    """(t1, t2, s, e): spans that repeats cover, by the suffix order of the contexts of each anchor."""
    work = contexts.filter("NOT many").drop("many").repartition("h").sortWithinPartitions("h", "t1", "t2", "s", "skip")
    starts = width - GRAM + 1

    def solve(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        h, t1, t2, s, skip = (rows.column(c).to_numpy() for c in ("h", "t1", "t2", "s", "skip"))
        # a text that stands in two tasks' rows may come twice; one place is one string
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (s[1:] != s[:-1]) | (skip[1:] != skip[:-1])
        keep = np.flatnonzero(fresh)
        strings = rows.column("context").take(pa.array(keep)).to_pylist()
        out: list[list] = [[], [], [], []]
        for i, found in zip(keep.tolist(), shared_windows(strings, skip[keep].tolist(), h[keep].tolist(), width, starts)):
            if len(found):
                begin = found + (s[i] - skip[i])
                cut = np.flatnonzero(np.diff(begin) > width) + 1
                for part in np.split(begin, cut):
                    for column, x in zip(out, (t1[i], t2[i], part[0], part[-1] + width)):
                        column.append(x)
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["t1", "t2", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for group in sorted_groups(batches, ["h"]):
            if held and size + group.num_rows > BATCH:
                yield solve(held)
                held, size = [], 0
            held.append(group)
            size += group.num_rows
        if held:
            yield solve(held)

    return work.mapInArrow(run, "t1 long, t2 long, s long, e long")


def _narrowed(contexts: DataFrame, width: int) -> DataFrame:
    """As ``_ordered``, by counting: for anchors with too many contexts for one task.

    Ranges of starts are counted from ``width - GRAM`` bytes before the anchor, whether the text begins there or not
    (``skip``: bytes that it lacks), so that equal stretches of two contexts fall into equal ranges.
    """
    schema = "t1 long, t2 long, s long, skip long, context binary, whole long, part long, a long, b long"
    names = [x.split()[0] for x in schema.split(", ")]

    def ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        digest = xxhash.xxh3_64_intdigest
        for x in batch.to_pylist():
            data, skip = x["context"], x["skip"]
            first, last = skip, skip + len(data) - width
            step = max(1, -(-(x["b"] - x["a"] + 1) // 4))
            for lo in range(x["a"], x["b"] + 1, step):
                hi = min(x["b"], lo + step - 1)
                if hi < first or lo > last:
                    continue
                # what all stretches that start from lo to hi have in common, and their union if the text holds it all
                part = digest(data[hi - skip : lo + width - skip], hi - lo) - (1 << 63)
                whole = digest(data[lo - skip : hi + width - skip]) - (1 << 63) if first <= lo and hi <= last else None
                out.append((x["t1"], x["t2"], x["s"], skip, data, whole, part, lo, hi))
        cols = list(zip(*out)) or [()] * len(names)
        kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    open_ = contexts.filter("many").select("t1", "t2", "s", "skip", "context", F.lit(0).cast("long").alias("a"), F.lit(width - GRAM).cast("long").alias("b"))
    covered = None
    while covered is None or not open_.isEmpty():
        begin = F.col("s") + F.col("a") - F.col("skip")
        level = _stored(map_arrow(open_, ranges, schema).withColumns({"size": F.col("b") - F.col("a"), "place": F.xxhash64("t1", "t2", begin)}), "ranges")
        ends = (F.min("place").alias("lo"), F.max("place").alias("hi"))
        twice = level.filter("whole IS NOT NULL").groupBy("whole", "size").agg(*ends).filter("lo < hi").drop("hi")
        done = level.join(twice, ["whole", "size"], "left")
        spans = done.filter("lo IS NOT NULL").select("t1", "t2", begin.alias("s"), (begin + F.col("size") + width).alias("e"))
        covered = spans if covered is None else covered.unionByName(spans)
        # of equal covered ranges one goes on, as a partner for those that aren't covered yet
        rest = done.filter("size > 0 AND (lo IS NULL OR place = lo)").withColumn("waits", F.col("lo").isNull()).drop("lo")
        shared = rest.groupBy("part", "size").agg(*ends, F.bool_or("waits").alias("any")).filter("lo < hi AND any").select("part", "size")
        open_ = _stored(rest.join(shared, ["part", "size"], "left_semi").select("t1", "t2", "s", "skip", "context", "a", "b"), "open")
    return covered.distinct()


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, group_limit: int = 50_000) -> DataFrame:
    """(t1, t2, spans): for each text with repeats, the (s, e) byte spans that they cover; spans may overlap."""
    small_batches(df.sparkSession)
    texts = _named(df, id_col, text_col)
    table = _stored(anchor_table(texts, width), "anchors")
    groups = table.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1")
    again = _stored(table.join(groups.select("h", (F.col("c0") == F.col("c1")).alias("equal")), "h"), "again")
    spans = again.filter("equal").select("t1", "t2", "s", "e")

    mixed = again.filter("NOT equal")
    kinds = _stored(
        mixed.groupBy("h", "c").agg(F.count("*").alias("weight"), *[F.first(x).alias(x) for x in ("t1", "t2", "p", "s", "e")]), "kinds"
    )
    heavy = kinds.filter("weight > 1").select("h", "c")
    spans = spans.unionByName(mixed.join(heavy, ["h", "c"]).select("t1", "t2", "s", "e"))
    sizes = kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("weight").alias("least")).filter("least = 1").select("h", (F.col("n") > group_limit).alias("many"))
    contexts = _stored(_contexts(texts, kinds.join(sizes, "h").withColumn("skip", F.lit(width - GRAM) - (F.col("p") - F.col("s")))), "contexts")
    spans = spans.unionByName(_ordered(contexts, width))
    if not contexts.filter("many").isEmpty():
        # equal contexts count as covered already; each is still a partner for the others, at a place of its own
        spans = spans.unionByName(_narrowed(contexts, width))
    return spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, group_limit: int = 50_000) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    return _result(df, id_col, text_col, width, group_limit, False)


def suffix_dedup_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, group_limit: int = 50_000) -> DataFrame:
    """As ``suffix_dedup``, with kept_sha256 in place of kept."""
    return _result(df, id_col, text_col, width, group_limit, True)


def _result(df: DataFrame, id_col: str, text_col: str, width: int, group_limit: int, digest: bool) -> DataFrame:
    texts = _named(df, id_col, text_col)
    joined = texts.join(repeated_spans(df, id_col, text_col, width, group_limit), ["t1", "t2"], "left").select("_id", "_text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for data, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            runs = merged([(x["s"], x["e"]) for x in spans or ()])
            kept, start = [], 0
            for a, b in runs:
                kept.append(data[start:a])
                start = b
            kept.append(data[start:])
            rest = b"".join(kept)
            for column, x in zip(out, (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest() if digest else rest)):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
        return pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    last = "kept_sha256 string" if digest else "kept binary"
    return map_arrow(joined, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, {last}")
