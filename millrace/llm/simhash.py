"""SimHash fingerprints and near-duplicate groups found through BK-trees.

Fingerprints are built in Arrow batches: XXH64 of every word shingle, then a majority vote on each of the 64 bits.
Links are sought between distinct fingerprints only, so a group of copies of any size is one fingerprint.

With radius r the 64 bits are cut into r + 2 blocks; two fingerprints within r bits agree in two whole blocks. A shard is
the fingerprints that share the values of two blocks. Each shard is stored as BK-trees of at most ``tree_size``
fingerprints (children keyed by the integer Hamming distance to the parent); every tree is sent to the tasks that hold
the shard's queries, which follow only the edges whose distance can still hold a match. A tree has a fixed largest
size, so what is sent to a task has one too; a shard of many trees is spread over many tasks. A task returns
a spanning forest of the links it found, at most one link per fingerprint, so no set of all pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, compact, cut, map_arrow, small_batches, sorted_groups, text_of, tidy, without
from .components import components

SEED = 42
UNIT_BYTES = 8 << 20  #: of shingle hashes that meet in a task at once


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words; of the whole sequence if there are fewer; none for no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """Bit i is set where over half of the hashes have it; zero for no hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype("<u8").view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(_id, fp): the fingerprint as a signed long, one row per input row."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["_id", "fp"])

    return map_arrow(text_of(df, id_col, text_col), run, f"_id {kind}, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                d = (v ^ values[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    break
                at = below

    def within(self, v: int, radius: int) -> list[int]:
        """Indices of the values at most ``radius`` bits from ``v``; other edges aren't followed."""
        found, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            d = (v ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            lo, hi = d - radius, d + radius
            open_.extend([c for k, c in children[at].items() if lo <= k <= hi])
        return found


    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, matching queries) for all queries at once: at each node those go on for which the edge can still match."""
        stack = [(0, queries)] if self.values else []
        while stack:
            at, rest = stack.pop()
            d = np.bitwise_count(rest ^ np.uint64(self.values[at])).astype(np.int16)
            near = rest[d <= radius]
            if len(near):
                yield at, near
            for k, child in self.children[at].items():
                on = rest[np.abs(d - k) <= radius]
                if len(on):
                    stack.append((child, on))


def _forest(tree_values: list[int], queries: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Links that span what the tree's values and the queries make connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    a, b = [], []
    tree = BKTree(tree_values)
    if len(tree_values) * len(queries) > 10_000:
        found = ((q, tree_values[i]) for i, near in tree.matches(np.array(queries, np.uint64), radius) for q in near.tolist())
    else:
        found = ((q, tree_values[i]) for q in queries for i in tree.within(q, radius))
    for q, v in found:
        if v != q and (x := root(q)) != (y := root(v)):
            parent[max(x, y)] = min(x, y)
            a.append(q)
            b.append(v)
    return a, b


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 2`` blocks that cover 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def _shards(radius: int) -> Column:
    """The shards of ``fp``: the values of two blocks, and the number of the two."""
    value = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks_of(radius)]
    pairs = list(combinations(range(len(value)), 2))
    return F.array(*[(F.shiftleft(value[i], 32).bitwiseOR(value[j])) * F.lit(len(pairs)) + F.lit(k) for k, (i, j) in enumerate(pairs)])


def near_links(fps: DataFrame, radius: int = 4, tree_size: int = 4096) -> DataFrame:
    """(a, b) longs: links that span all pairs of distinct ``fps.fp`` at most ``radius`` bits apart."""
    small_batches(fps.sparkSession)
    distinct = compact(fps.select("fp").distinct())
    sharded = distinct.select("fp", F.explode(_shards(radius)).alias("shard"))
    trees = sharded.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / F.lit(tree_size)).cast("int").alias("trees"))
    placed = sharded.join(trees, "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # a query meets every tree of its shard of its own number or above; pairs below are met from the other side
    queries = placed.select("shard", "own", "fp", F.explode(F.sequence(F.col("own"), F.col("trees") - 1)).alias("tree"), F.lit(1).alias("query"))
    holders = placed.select("shard", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("own"), "fp", F.col("own").alias("tree"), F.lit(0).alias("query"))
    work = queries.select("shard", "own", "tree", "query", "fp").unionByName(holders.select("shard", "own", "tree", "query", "fp"))
    work = work.repartition("shard", "own", "tree").sortWithinPartitions("shard", "own", "tree", "query", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in sorted_groups(batches, ["shard", "own", "tree"]):
            is_query = group.column("query").to_numpy() == 1
            values = group.column("fp").to_numpy().view(np.uint64)
            x, y = _forest(values[~is_query].tolist(), values[is_query].tolist(), radius)
            a += x
            b += y
            if len(a) > 50_000:
                yield _links(a, b)
                a, b = [], []
        if a:
            yield _links(a, b)

    return work.mapInArrow(run, "a long, b long")


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tree_size: int = 4096) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (least id reachable, own included).

    Links are between fingerprints at most ``radius`` bits apart, equal ones included; texts without words have
    fingerprint zero and link like any other. Null text counts as empty. A null id never names a component,
    unless all its rows lack an id. Repeated rows each get their row.
    """
    fps = cut(fingerprints(df, id_col, text_col, width))
    links = cut(near_links(fps, radius, tree_size))
    root = components(links)
    classes = fps.groupBy("fp").agg(F.min("_id").alias("least"))
    classes = cut(classes.join(root.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = classes.select("fp", "root").join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return fps.join(named.select("fp", "component_id"), "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similarity(a: str, b: str, width: int) -> float:
    """Share of the two texts' distinct shingles that both have; 1 for two texts without words."""
    x, y = (set(shingle_hashes(t, width).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band: texts share one if in it the least of the hashes under each of ``rows`` permutations are equal.

    A permutation of 64 bits is a product by an odd number.
    """
    if not len(hashes):
        return []
    odd = np.array([xxhash.xxh64_intdigest(b"permutation", k) | 1 for k in range(bands * rows)], np.uint64)
    least = np.array([(hashes * x).min() for x in odd], np.uint64).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)]


def greedy_links(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """(i, j): set i shares ``least`` with set j, an earlier one that has no such link itself."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(number.max(initial=-1)) + 1, bool)
    cells, used = np.zeros(len(number), np.int64), 0
    kept, at = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    n, a, b = 0, [], []
    for i in np.flatnonzero(sizes).tolist():
        own = number[starts[i] : starts[i] + sizes[i]]
        if n:
            flags[own] = True
            common = np.add.reduceat(flags[cells[:used]], at[:n], dtype=np.int64)
            flags[own] = False
            near = kept[:n][common >= least * (sizes[kept[:n]] + sizes[i] - common)]
            if len(near):
                a += [i] * len(near)
                b += near.tolist()
                continue
        kept[n], at[n] = i, used
        cells[used : used + len(own)] = own
        used += len(own)
        n += 1
    return a, b


def unit_links(members: DataFrame, sets: DataFrame, least: float, whole: bool, unit_size: int, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(node, by): by comes before node and shares ``least`` of its shingles.

    ``members`` (key, node, n, bytes) are the nodes of each bucket, with the bucket's numbers of nodes and bytes; ``sets`` (node, least_id,
    hashes) has the place in the order and the shingles. A bucket is cut into parts of ``unit_size`` nodes or ``unit_bytes``. A unit is a part,
    or where ``whole`` two parts of a bucket, so that all its pairs meet. In a unit a node is compared with those before it
    that have no link there.
    """
    small_batches(sets.sparkSession)
    parts = F.greatest(F.ceil(F.col("n") / F.lit(unit_size)), F.ceil(F.col("bytes") / F.lit(unit_bytes))).cast("int")
    placed = members.select("key", "node", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    if whole:
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        placed = placed.select("key", "node", "part", other).select("key", "node", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    else:
        placed = placed.select("key", "node", F.col("part").alias("low"), F.col("part").alias("high"))
    work = placed.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "least_id", "node")
    work = work.select("key", "low", "high", "node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "low", "high"]):
            if group.num_rows < 2:
                continue
            a, b = greedy_links([np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()], least)
            if a:
                nodes = group.column("node").to_numpy()
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], names=["node", "by"])

    return work.mapInArrow(run, "node long, by long").distinct()


def resolved(links: DataFrame) -> DataFrame:
    """(node): those that go, if a node goes where a node it is linked to stays. Links lead back in one order, so this has one answer."""
    rest, gone = links, None
    while not rest.isEmpty():
        ends = rest.select(F.col("by").alias("v"), F.lit(0).alias("out")).unionByName(rest.select(F.col("node").alias("v"), F.lit(1).alias("out")))
        stays = ends.groupBy("v").agg(F.max("out").alias("out")).filter("out = 0").select(F.col("v").alias("by"))
        now = compact(rest.join(stays, "by", "left_semi").select("node").distinct())
        gone = now if gone is None else gone.unionByName(now)
        rest = rest.join(now, "node", "left_anti")
        rest = compact(rest.join(now.select(F.col("node").alias("by")), "by", "left_anti"))
        tidy(links.sparkSession)
    return links.select("node").limit(0) if gone is None else compact(gone)


def buckets(keys: DataFrame) -> DataFrame:
    """(key, node) of the buckets with several nodes; of those with the same nodes one is left."""
    mark = F.xxhash64("node")
    same = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s")).filter("n > 1")
    same = same.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    return keys.join(same, "key")


def sized(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` (key, node) with the numbers of nodes and bytes of each bucket that has several."""
    total = members.join(sizes, "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter("n > 1")
    return members.join(total, "key")


def near_copies(rows: DataFrame, texts: DataFrame, width: int, radius: int, least: float, unit_size: int = 1024) -> DataFrame:
    """(node): the nodes that go; see ``drop_near_copies``. ``rows``: (_id, _row, fp, node, bands); ``texts``: (_row, _text).

    A bucket holds the nodes of one band key, or of all fingerprints that links of ``radius`` bits connect.
    The first round takes each node's largest bucket only, part by part; most nodes of large families go there. The next compares all that stay, in all
    buckets and across parts. After it a node whose links lead only to nodes that go stays as well, and meets again what it
    wasn't compared with. Rounds end when no link is new.
    """
    ways = rows.select("fp", "node").distinct()
    family = components(near_links(rows, radius)).select(F.col("vertex").alias("fp"), "root")
    # spanning links of a family say nothing of its other pairs within the radius, so the whole family is one bucket
    by_fp = ways.join(family, "fp", "left").select(F.xxhash64(F.lit("family"), F.coalesce("root", "fp")).alias("key"), "node")
    tidy(rows.sparkSession)
    members = compact(buckets(rows.select(F.explode("bands").alias("key"), "node").unionByName(by_fp).distinct()))
    first = rows.groupBy("node").agg(F.min(F.struct("_id", "_row")).alias("f"))
    wanted = compact(members.select("node").distinct().join(first, "node").select("node", F.col("f._id").alias("least_id"), F.col("f._row").alias("_row")))

    keys = wanted.select(bucket(18, F.col("_row")).alias("_bucket")).distinct()
    some = texts.withColumn("_bucket", bucket(18, F.col("_row"))).join(F.broadcast(keys), "_bucket", "left_semi")
    needed = some.join(wanted, "_row").select("node", "least_id", "_text")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.unique(shingle_hashes(t, width)).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(hashes, pa.binary())], names=["node", "least_id", "hashes"])

    sets = cut(map_arrow(needed, shingles, f"node long, least_id {dict(wanted.dtypes)['least_id']}, hashes binary").dropDuplicates(["node"]))
    sizes = compact(sets.select("node", F.length("hashes").alias("bytes")))
    tidy(rows.sparkSession)
    every = compact(sized(members, sizes))
    largest = every.groupBy("node").agg(F.max(F.struct("n", "key")).alias("k")).select("node", F.col("k.key").alias("key"))
    links = compact(unit_links(sized(every.join(largest, ["key", "node"]).select("key", "node"), sizes), sets, least, False, unit_size))
    again = members.select("key")
    while True:
        gone = resolved(links)
        again = again.unionByName(members.join(links.select("node").distinct().join(gone, "node", "left_anti"), "node", "left_semi").select("key")).distinct()
        now = compact(sized(members.join(again, "key", "left_semi").join(gone, "node", "left_anti"), sizes))
        if now.isEmpty():
            return gone
        new = compact(unit_links(now, sets, least, True, unit_size))
        tidy(rows.sparkSession)
        if new.isEmpty():
            return gone
        links, again = compact(links.unionByName(new).distinct()), members.select("key").limit(0)


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4, least: float = 0.8, bands: int = 12, band_rows: int = 4, unit_size: int = 1024
) -> DataFrame:
    """The rows of ``df`` that stay, all columns. A row goes only for a row that stays, comes before it (least id, nulls first) and
    shares ``least`` of their distinct shingles of ``width`` words.

    Rows are compared if links between fingerprints at most ``radius`` bits apart, found in BK-trees, connect theirs, or if they agree in one of ``bands``
    keys of ``band_rows`` least hashes each; two texts that share 0.8 agree in none with a probability of 0.002. Of rows
    with one set of shingles one stays at most. Null text counts as empty; texts without words are equal. Rows that repeat id
    and text stay or go together.
    """
    small_batches(df.sparkSession)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), key.alias("_row"))
    kinds = dict(texts.dtypes)["_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, keys = [], [], []
        for t in batch.column(1).to_pylist():
            hashes = shingle_hashes(t, width)
            fps.append(fingerprint(hashes))
            distinct = np.unique(hashes)
            nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
            keys.append(np.array(band_keys(distinct, bands, band_rows), np.uint64).view(np.int64))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
        return pa.record_batch([batch.column(0), batch.column(2), *longs, pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_row", "fp", "node", "bands"])

    rows = cut(map_arrow(texts, run, f"_id {kinds}, _row long, fp long, node long, bands array<long>"))
    nodes = near_copies(rows, texts.select("_row", "_text"), width, radius, least, unit_size)
    first = rows.groupBy("node").agg(F.min(F.struct("_id", "_row")).alias("f"), F.count("*").alias("n"))
    copies = rows.join(first.filter("n > 1").select("node", F.col("f._row").alias("stay")), "node").filter("_row <> stay").select("_row")
    gone = copies.unionByName(rows.join(nodes, "node", "left_semi").select("_row"))
    return without(df, key, cut(gone), "_row")
