"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the bytes of a text; a chunk ends where no hash within ``reach`` bytes on either side is less. Such an end
depends on the bytes near it only, so an insertion moves no other end, and a repeated passage falls into step within
some bytes of its start. From every chunk on, as many chunks as hold ``min_run`` bytes are a window, identified by its
size and 84 bits of a digest. A window is a repeat if an earlier document (by id) has it, or the same document at an earlier place that
it doesn't overlap; what repeats cover is removed. So all that goes is part of at least ``min_run`` bytes that stand
elsewhere in one piece, however small the chunks: those of a few common words often coincide by chance.

64 bits of the digest are counted first; only windows whose bits occur twice are compared by id and whole digest.

* Null text counts as empty: no chunks, nothing removed. Documents with a null id come first in the order. Integer ids are ordered as
  numbers, others as strings.
* Rows that share an id count as one document in the order: their chunks don't remove each other's.
* Texts shorter than ``min_run`` bytes, and repeats too short to hold a window, stay.
* Memory is in proportion to one text. A digest of any frequency costs partial aggregations and joins that adaptive
  execution may split.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, map_arrow, shared_dir, small_batches, text_of

#: One pseudo-random 32-bit number for each byte value, from a hash of the value.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)
FIRST = -(1 << 63)
LOW = (1 << 32) - 1


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: each byte's number, shifted by one for every byte after it."""
    h = GEAR[data]
    step = 1
    while step < 32:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before each value; the largest number where there is none."""
    top = np.iinfo(h.dtype).max
    m = np.concatenate((np.full(reach, top, h.dtype), h))
    size = 1
    while 2 * size <= reach:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < reach:
        m = np.minimum(m[: size - reach], m[reach - size :])
    return m[: len(h)]


def chunk_ends(data: bytes, reach: int = 12, most: int = 512) -> list[int]:
    """Ends of the chunks of ``data``: after each byte with ``reach`` bytes on both sides, none of which has a lesser hash; no chunk is over ``most``.

    The lower twelve bits of a hash depend on twelve bytes only, so that short passages fall into step soon.
    """
    h = gear(np.frombuffer(data, np.uint8)) & np.uint32(0xFFF)
    least = (h <= least_before(h, reach)) & (h <= least_before(h[::-1], reach)[::-1])
    marks = np.flatnonzero(least[reach : len(h) - reach]) + reach + 1
    ends, start = [], 0
    for end in [*marks.tolist(), len(data)]:
        while end - start > most:
            start += most
            ends.append(start)
        if end > start:
            ends.append(end)
            start = end
    return ends


def windows(ends: list[int], min_run: int) -> list[tuple[int, int]]:
    """(start, end) from each chunk's start to the first chunk end ``min_run`` bytes on, and of the last such up to the end."""
    starts, out, j = [0, *ends], [], 0
    for start in starts:
        while j < len(ends) and ends[j] - start < min_run:
            j += 1
        if j == len(ends):
            break
        out.append((start, ends[j]))
    if out and out[-1][1] < ends[-1]:
        out.append((out[-1][0], ends[-1]))
    return out


def _order(id_col: str, df: DataFrame) -> Column:
    """The place of a row's document in the order."""
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("_id").cast("long"), F.lit(FIRST))
    return F.coalesce(F.col("_id").cast("string"), F.lit(""))


def removed_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs that the spans (at, n) cover."""
    runs: list[list[int]] = []
    for at, n in sorted(set(spans)):
        if runs and runs[-1][1] >= at:
            runs[-1][1] = max(runs[-1][1], at + n)
        else:
            runs.append([at, at + n])
    return [(a, b) for a, b in runs]


def digest(start: int, window: bytes) -> tuple[int, int]:
    """(d1, span) of a window: 64 bits of its digest, and its start in 32 bits, its size in 12 and 20 more bits of the digest."""
    d1, d2 = struct.unpack("<qQ", xxhash.xxh3_128_digest(window))
    return d1, start << 32 | len(window) << 20 | d2 >> 44


def window_table(df: DataFrame, id_col: str, text_col: str, min_run: int, **sizes: int) -> DataFrame:
    """(id, again, d1, span): a row for each window, see ``digest``; where again, for each run of a document that windows before it in
    the document equal, with the run's size in 32 bits of span."""
    texts = text_of(df, id_col, text_col).select(_order(id_col, df).alias("id"), "_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, repeated, halves, spans = [], [], [], []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            seen: dict[tuple[int, int], int] = {}
            again = []
            for start, end in windows(chunk_ends(data, **sizes), min_run):
                d1, span = digest(start, data[start:end])
                if seen.setdefault((d1, span & LOW), end) <= start:
                    again.append((start, end - start))
                else:
                    halves.append(d1)
                    spans.append(span)
            repeated += [False] * (len(spans) - len(repeated))
            for start, end in removed_runs(again):
                halves.append(digest(start, data[start:end])[0])
                spans.append(start << 32 | end - start)
                repeated.append(True)
            ids += [i] * (len(spans) - len(ids))
        cols = [pa.array(ids, batch.schema.field(0).type), pa.array(repeated, pa.bool_()), pa.array(halves, pa.int64()), pa.array(spans, pa.int64())]
        return pa.record_batch(cols, names=["id", "again", "d1", "span"])

    return map_arrow(texts, run, f"id {dict(texts.dtypes)['id']}, again boolean, d1 long, span long")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 128, reach: int = 12, most: int = 512) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, spans (array of start and end), kept (binary)."""
    if min_run + most >= 1 << 12:
        raise ValueError("a window has to be shorter than 4096 bytes")
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    window_table(df, id_col, text_col, min_run, reach=reach, most=most).write.parquet(path)
    every = spark.read.parquet(path)
    fresh, again = every.filter("NOT again"), every.filter("again")
    twice = fresh.groupBy("d1").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select("d1")
    fresh.select("d1", "id", "span").join(twice, "d1").withColumn("again", F.lit(False)).unionByName(again).write.parquet(f"{path}-twice")
    delete(spark, path)
    found = spark.read.parquet(f"{path}-twice")
    fresh, again = (found.filter(x).withColumn("kind", F.col("span").bitwiseAND(LOW)) for x in ("NOT again", "again"))
    owners = fresh.groupBy("d1", "kind").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").select("d1", "kind", "owner")
    later = fresh.join(owners, ["d1", "kind"]).filter("id > owner")
    columns = ["id", F.struct("again", "d1", "span").alias("repeat")]
    repeats = later.select(*columns).unionByName(again.select(*columns)).groupBy("id").agg(F.collect_list("repeat").alias("repeats"))

    texts = text_of(df, id_col, text_col).withColumn("id", _order(id_col, df))
    joined = texts.join(repeats, "id", "left").select("_id", "_text", "repeats")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for data, repeats in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            found = []
            for x in repeats or ():
                at, n = x["span"] >> 32, x["span"] & LOW
                n = n if x["again"] else n >> 20
                d1, span = digest(at, data[at : at + n])
                if d1 == x["d1"] and (x["again"] or span == x["span"]):  # rows that share an id share its repeats; each has its own
                    found.append((at, n))
            runs = removed_runs(found)
            kept, start = [], 0
            for a, b in runs:
                kept.append(data[start:a])
                start = b
            kept.append(data[start:])
            for column, x in zip(out, (len(data), sum(b - a for a, b in runs), len(runs), [{"start": a, "end": b} for a, b in runs], b"".join(kept))):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(joined, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
