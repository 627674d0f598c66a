"""Duplicates within a key, and a fingerprint of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import words

MASK = 0xFFFFFFFF
# The 64-bit FNV-1a offset, as two's complement, and its prime 2^40 + 435.
FNV_OFFSET, FNV_PRIME_LOW = -3750763034362895579, 435
# Rows of one fingerprint that go together, and rows of one share of the fingerprints that agree in two blocks.
PIECE, SHARE = 256, 4096


def fnv64(word: Column) -> Column:
    """FNV-1a of the UTF-8 bytes of ``word``, as a signed long.

    The product modulo 2^64 is put together from 32-bit halves, as bigint overflow is an error: with h = hi 2^32 + lo,
    h (2^40 + 435) = ((hi 435 + lo 2^8 + carry) mod 2^32) 2^32 + (lo 435 mod 2^32).
    """
    hexes = F.hex(F.encode(word, "utf-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo, hi = x.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(x, 32)
        low = lo * FNV_PRIME_LOW
        high = (hi * FNV_PRIME_LOW + lo * 256 + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(MASK))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(MASK)))

    return F.when(F.octet_length(word) > 0, F.aggregate(bytes_, F.lit(FNV_OFFSET).cast("long"), step)).otherwise(F.lit(FNV_OFFSET).cast("long"))


def _votes(batches: Iterator) -> Iterator:
    """(id, b0, ..., b63) of rows (id, text): how many words of a text have the bit in their hash, less those that haven't; texts without words are left out."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for begin, _, h, first in words.slices(batch.column(1), words.LOWER + words.DIGITS + b"_"):
            n = np.diff(first)
            some = np.flatnonzero(n)
            if len(some):
                votes = np.empty((64, len(some)), np.int64)
                for k in range(32):  # two sums at once
                    both = np.add.reduceat(h >> np.uint64(k) & np.uint64(1 << 32 | 1), first[some])
                    votes[k], votes[k + 32] = both & np.uint64(MASK), both >> np.uint64(32)
                votes = 2 * votes - n[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + some)), *map(pa.array, votes)], ["id", *(f"b{k}" for k in range(64))])


def word_simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): majority bits of the FNV-1a hashes of a text's words ([a-z0-9_]+ of the lowered text).

    A text's votes are added up where it is read; one row of 64 counts a text goes through a shuffle, for ids that occur again.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"b{i} long" for i in range(64))
    bits = rows.mapInArrow(_votes, schema).groupBy("id").agg(*[F.sum(f"b{i}").alias(f"b{i}") for i in range(64)])
    fp: Column = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return bits.select(F.col("id").alias(id_col), fp.alias("fp"))


def threshold(length: Column) -> Column:
    """Bits that near copies of a text of this length may differ in; fixed values, not monotone."""
    return F.when(length > 200_000, 24).when(length > 100_000, 20).when(length > 50_000, 16).when(length > 20_000, 12).otherwise(14)


def near_in_key(rows: DataFrame, keys: list[str], order: list[str], fp: str, length: str, least: int = 500) -> DataFrame:
    """Rows that are near copies of the newest row of their key: adds newest (its order value) and distance."""
    newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct(*order, fp, length)).alias("_new"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    seen = rows.join(newest, same).drop(*[f"_{k}" for k in keys])
    d = F.bit_count(F.col(fp).bitwiseXOR(F.col("_new")[fp]))
    near = (F.col(order[-1]) != F.col("_new")[order[-1]]) & (F.col(length) >= least) & (F.col("_new")[length] >= least) & (d <= threshold(F.col(length)))
    return seen.withColumns({"newest": F.col("_new")[order[-1]], "distance": d}).filter(near).drop("_new")


def hamming_pairs(rows: DataFrame, id_col: str, fp: str, radius: int = 3) -> DataFrame:
    """(a, b, distance): pairs at most ``radius`` (3 at most) bits apart.

    Distinct fingerprints meet by equality on two of five blocks, which three bits can't all change. They bring their rows, in pieces, so that the pairs,
    many more than all that is read, are made where fingerprints meet and don't move. What shares two blocks is dealt to cells of two shares each, of so
    many rows that no task makes the pairs of a frequent value alone.
    """
    spark = rows.sparkSession
    blocks = [(64 * i // 5, 64 * (i + 1) // 5 - 64 * i // 5) for i in range(5)]
    value = lambda x, i: F.shiftrightunsigned(x, blocks[i][0]).bitwiseAND(F.lit((1 << blocks[i][1]) - 1))
    two = list(combinations(range(5), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), value(F.col("fp"), i).alias("u"), value(F.col("fp"), j).alias("v")) for k, (i, j) in enumerate(two)])
    members = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")).filter("id IS NOT NULL AND fp IS NOT NULL").groupBy("fp").agg(F.collect_list("id").alias("all"))
    pieces = members.select("fp", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PIECE).cast("int")), lambda k: F.slice("all", k * PIECE + 1, F.lit(PIECE)))).alias("p", "ids"))
    cut = pieces.select("fp", "p", "ids", F.inline(keys))
    on = ["k", "u", "v"]
    shares = cut.groupBy(*on).agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > SHARE).select(*on, F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    dealt = cut.join(shares, on, "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp", "p"), F.col("shares")).cast("int"))
    # a number of partitions that is given stays as it is: those that are small when read may be large when paired
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cells = lambda side, i, j: dealt.select(F.col("fp").alias(f"f{side}"), F.col("p").alias(f"p{side}"), F.col("ids").alias(f"ids{side}"), *on, i, j).repartition(n, *on, "i", "j")
    own, last = F.col("own"), F.col("shares") - 1
    left = cells("a", own.alias("i"), F.explode(F.sequence(own, last)).alias("j"))
    right = cells("b", F.explode(F.sequence(F.lit(0), own)).alias("i"), own.alias("j"))
    x = F.col("fa").bitwiseXOR(F.col("fb"))
    # a pair that agrees in several keys is taken from the first
    first = F.coalesce(*[F.when((value(x, i) == 0) & (value(x, j) == 0), F.lit(k)) for k, (i, j) in enumerate(two)])
    once = "i < j OR fa < fb OR (fa = fb AND pa <= pb)"
    near = left.join(right, [*on, "i", "j"]).filter(F.bit_count(x) <= radius).filter(once).filter(F.col("k") == first)
    same = F.expr("fa = fb AND pa = pb").alias("same")
    found = near.select("idsb", same, F.bit_count(x).cast("int").alias("distance"), F.explode("idsa").alias("x")).select("x", "same", "distance", F.explode("idsb").alias("y"))
    return found.filter("x < y OR (x > y AND NOT same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, by ``order``; rows with a null key all stay, as nulls never conflict."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    ranked = rows.filter(known).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return ranked.unionByName(rows.filter(~known))


def line_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 20, overlap: int = 3) -> DataFrame:
    """(id, chunk_index, chunk_text): lines [c size - overlap, c size + size) of chunk c, while c size < lines."""
    lines = F.split(F.col(text_col), "\n")
    cut = docs.select(id_col, lines.alias("_l"), F.explode(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))).alias("chunk_index"))
    start = F.greatest(F.col("chunk_index") * size - overlap, F.lit(0))
    return cut.select(id_col, "chunk_index", F.array_join(F.slice("_l", start + 1, F.col("chunk_index") * size + size - start), "\n").alias("chunk_text"))
