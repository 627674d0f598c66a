"""Hard negatives by vantage-point trees over vectors that are augmented to one norm: a window of scores is an annulus of distances.

Components become whole numbers, floor(scale * x), and a score is an inner product of them. With one more component, the root of M^2 - |x|^2
(M: the largest norm), all rows have the norm M and a row's distance to an anchor (last component 0) falls as its score rises:
d^2 = |a|^2 + M^2 - 2 score. Rows are dealt to cells by a small vantage-point tree over a sample, large cells to several blocks by hash, and every
block gets a tree of its own. An anchor goes only to cells whose ranges of distances to the sample's vantage points meet
its annulus, which starts narrowed: the k-th best row of the sample is a bound for the k-th best of all. In a block one heap holds
nodes by the best score they can have and rows by their score, so rows come nearest first and the walk stops after k. Scores decide exactly.

* A row takes part with an id, a label and a vector that is neither null nor has null, NaN or infinite components. Shorter vectors count as
  filled up with zeros. A vector whose norm reaches 2^31 after scaling takes no part, for its scores don't fit 64 bits.
* Higher scores first, ties by smaller id. An anchor's own id is never its positive. A row that is repeated counts as often as it
  stands; of rows of one anchor id the one with the greatest label and vector is the anchor.
* A negative score of a positive makes an empty window. An anchor without positives or negatives has no rows. Empty in, empty out; other columns aren't read.
* The driver holds the sample (``sample`` rows) and a count and ranges for each of ``CELLS`` cells at most. A task holds one block's tree and
  ``CHUNK`` anchors. Every row is in the index; the sample only sets bounds.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches

LEAF = 128  #: rows of a leaf: scoring them costs about as much as two steps of the walk
CELLS = 32
CHUNK = 20_000  #: anchors that meet one block in one task
SLACK = 1e-6  #: of the largest norm, for roots that are rounded

WINDOWS = "array<struct<positive_id: long, positive_score: long, lo: long, hi: long>>"
QUERY = f"anchor_id long, label long, vector array<long>, windows {WINDOWS}"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out[of, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[of]] = flat
    return out


class Space:
    """Scores and distances of rows of ``width`` whole numbers, of squared norm ``top`` at most."""

    def __init__(self, width: int, top: int):
        self.width, self.top = width, top
        self.kind = np.float64 if top < 1 << 52 else np.int64  # floats are exact up to there
        self.slack = SLACK * (top**0.5 + 1)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return x.astype(self.kind)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them to the largest norm."""
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate((x, rest[:, None]), 1)

    def between(self, raised: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        """Distances of raised rows to raised rows."""
        return np.sqrt(np.maximum(2 * self.top - 2 * (raised @ vantage.T), 0))

    def from_anchor(self, q: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose last component is 0, to raised rows."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.top - 2 * (q @ vantage[:, :-1].T), 0))


class Tree:
    """A vantage-point tree; rows of a leaf stand together. Node i: ``vantage[i]``, children and their ranges of distances to it, or a leaf's rows."""

    def __init__(self, space: Space, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        raised = space.raised(x)
        self.vantage: list[int] = []
        self.child: list[tuple] = []  #: ((node, nearest, farthest), (node, nearest, farthest)) or (from, to)
        order: list[np.ndarray] = []
        placed = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        ranges: dict[int, list] = {}
        while todo:
            rows, parent, side = todo.pop()
            i = len(self.child)
            if parent >= 0:
                ranges[parent][side][0] = i
            d = space.between(raised[rows], raised[rows[:1]])[:, 0] if len(rows) > leaf else None
            if d is None or d.max() - d.min() <= space.slack:  # few, or all at one place
                self.vantage.append(-1)
                self.child.append((placed, placed + len(rows)))
                order.append(rows)
                placed += len(rows)
                continue
            by = np.argsort(d, kind="stable")
            half = len(by) // 2
            near, far = by[:half], by[half:]
            ranges[i] = [[0, d[near].min(), d[near].max()], [0, d[far].min(), d[far].max()]]
            self.vantage.append(int(rows[0]))
            self.child.append(None)
            todo += [(rows[near], i, 0), (rows[far], i, 1)]
        for i, r in ranges.items():
            self.child[i] = (tuple(r[0]), tuple(r[1]))
        order = np.concatenate(order)
        inner = [v for v in self.vantage if v >= 0]
        self.points = raised[inner] if inner else np.zeros((0, space.width + 1))
        at = iter(range(len(inner)))
        self.vantage = [next(at) if v >= 0 else -1 for v in self.vantage]
        self.x, self.ids, self.labels = space.numbers(x[order]), ids[order], labels[order]

    def nearest_first(self, q: np.ndarray, reach: float, to: np.ndarray, span: list[int], space: Space, wanted) -> Iterator[tuple[int, int]]:
        """(score, id) of the wanted rows within the scores ``span`` = [lo, hi], best first; the caller may raise ``span[0]`` between rows.

        ``reach``: |q|^2 + M^2; ``to``: distances of ``q`` to the vantage points.
        """
        heap: list[tuple] = [(-float("inf"), 0, 0, 0.0, float("inf"))]
        while heap:
            key, kind, number, near, far = heapq.heappop(heap)
            if -key < span[0]:
                return
            if kind:
                yield int(-key), number
                continue
            child = self.child[number]
            if self.vantage[number] < 0:
                rows = slice(*child)
                s = self.x[rows] @ q
                for k in np.flatnonzero((s >= span[0]) & (s <= span[1]) & wanted(rows)).tolist():
                    heapq.heappush(heap, (-int(s[k]), 1, int(self.ids[rows.start + k]), 0.0, 0.0))
                continue
            d = to[self.vantage[number]]
            for c, a, b in child:
                least = max(near, a - d - space.slack, d - b - space.slack)
                most = min(far, d + b + space.slack)
                best, worst = (reach - least * least) / 2 + 1, (reach - most * most) / 2 - 1
                if best >= span[0] and worst <= span[1]:
                    heapq.heappush(heap, (-min(best, span[1]), 0, c, least, most))


class Cells:
    """A shallow vantage-point tree over the sample, in levels; a row's cell is its path."""

    def __init__(self, space: Space, sample: np.ndarray, cells: int):
        self.levels = max(0, int(np.log2(max(cells, 1)))) if len(sample) else 0
        raised = space.raised(sample)
        self.vantage = np.zeros((max(1, (1 << self.levels) - 1), space.width + 1))
        self.middle = np.zeros(len(self.vantage))
        groups = {0: np.arange(len(sample))}
        for i in range((1 << self.levels) - 1):
            rows = groups.get(i, np.arange(0))
            if len(rows):
                self.vantage[i] = raised[rows[0]]
                d = space.between(raised[rows], self.vantage[i : i + 1])[:, 0]
                self.middle[i] = np.median(d)
                groups[2 * i + 1], groups[2 * i + 2] = rows[d < self.middle[i]], rows[d >= self.middle[i]]
        if not self.levels and len(sample):
            self.vantage[0] = raised[0]

    def of(self, space: Space, x: np.ndarray) -> np.ndarray:
        d = space.between(space.raised(x), self.vantage)
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (d[np.arange(len(x)), at] >= self.middle[at])
        return at - ((1 << self.levels) - 1)


def prepare(df: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: float) -> DataFrame:
    """(_id, _y, _v, _n): the rows that take part, their components as whole numbers and the squared norm."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fine = F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = df.filter(fine).select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_y"), v.alias("_v")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    norm = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.filter(norm < float(1 << 62)).withColumn("_n", F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x * x))


class Index:
    """Every row of ``rows`` (see ``prepare``) in the tree of a block; ``blocks`` is a checkpointed table (block, tree)."""

    def __init__(self, rows: DataFrame, sample: int = 2048, block: int | None = None):
        spark = rows.sparkSession
        small_batches(spark, 2048)
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("width"), F.max("_n").alias("top")).first()
        self.n = size["n"]
        if not self.n:
            return
        self.space = space = Space(max(1, size["width"]), size["top"])
        drawn = rows.select("_id", "_y", "_v").orderBy(F.xxhash64("_id"), "_id").limit(sample).toArrow()
        self.sample = _matrix(drawn.column("_v").combine_chunks(), space.width)
        self.sample_ids, self.sample_labels = (drawn.column(c).to_numpy() for c in ("_id", "_y"))
        self.block = block or max(2048, min(32_768, self.n // 64))
        cells = Cells(space, self.sample, min(CELLS, self.n // self.block))
        kept = spark.sparkContext.broadcast(cells)

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch.column(2), space.width)
            return pa.record_batch([*batch.columns[:3], pa.array(kept.value.of(space, x), pa.int64())], names=["_id", "_y", "_v", "cell"])

        placed = cut(map_arrow(rows.select("_id", "_y", "_v"), place, "_id long, _y long, _v array<long>, cell long"))
        count = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.cells = sorted(count)
        salts = [-(-count[c] // self.block) for c in self.cells]
        self.first = np.concatenate(([0], np.cumsum(salts))).astype(np.int64)  #: blocks of the k-th cell: first[k] to first[k + 1]
        deal = F.create_map(*[F.lit(x) for k, c in enumerate(self.cells) for x in (c, k)])[F.col("cell")]
        begin, parts = (F.element_at(F.array(*[F.lit(int(x)) for x in xs]), (deal + 1).cast("int")) for xs in (self.first[:-1], salts))
        # a row that is repeated, or one id for a third of all rows, is dealt by its place in the partition too
        dealt = placed.withColumn("block", begin + F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), parts))

        def build(table: pa.Table) -> pa.Table:
            x = _matrix(table.column("_v").combine_chunks(), space.width)
            d = space.between(space.raised(x), kept.value.vantage)
            tree = Tree(space, x, table.column("_id").to_numpy(), table.column("_y").to_numpy())
            out = {"block": table.column("block")[:1], "lo": pa.array([d.min(0)]), "hi": pa.array([d.max(0)]), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())}
            return pa.table(out)

        self.blocks = cut(dealt.groupBy("block").applyInArrow(build, "block long, lo array<double>, hi array<double>, tree binary"))
        # ranges by cell: as many as there are cells at most, however many blocks
        cell = F.element_at(F.array(*[F.lit(int(k)) for k in range(len(self.cells))]), F.size(F.filter(F.array(*[F.lit(int(x)) for x in self.first[:-1]]), lambda f: f <= F.col("block"))))
        spread = self.blocks.select(cell.alias("cell"), F.posexplode(F.arrays_zip("lo", "hi")).alias("v", "r")).groupBy("cell", "v").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
        self.lo, self.hi = (np.zeros((len(self.cells), len(cells.vantage))) for _ in range(2))
        for r in spread.collect():
            self.lo[r["cell"], r["v"]], self.hi[r["cell"], r["v"]] = r["lo"], r["hi"]
        self.vantage = cells.vantage

    def search(self, queries: DataFrame, k: int, positives: bool) -> DataFrame:
        """(anchor_id, positive_id, positive_score, found_id, score): for each of ``queries`` (``QUERY``) its best k rows of the same label, or for
        each of its windows the best k of other labels, of each block that can hold some: a superset of the best k of all."""
        spark, space = queries.sparkSession, self.space
        chunks = max(1, -(-queries.count() // CHUNK))
        shared = spark.sparkContext.broadcast((self.sample, self.sample_ids, self.sample_labels, self.vantage, self.lo, self.hi, self.first))

        def route(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            sample, sample_ids, sample_labels, vantage, lo, hi, first = shared.value
            q = _matrix(batch.column(2), space.width)
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            s = space.numbers(q) @ space.numbers(sample).T
            to = space.from_anchor(q, vantage)
            reach = np.einsum("ij,ij->i", q.astype(float), q.astype(float)) + space.top
            of, blocks, windows = [], [], []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                same = sample_labels == labels[i]
                spans = spans or [{"positive_id": None, "positive_score": None, "lo": -(1 << 62), "hi": 1 << 62}]
                for w in spans:
                    near = s[i][(same & (sample_ids != ids[i]) if positives else ~same) & (s[i] >= w["lo"]) & (s[i] <= w["hi"])]
                    if len(near) >= k:
                        w["lo"] = max(w["lo"], int(np.partition(near, -k)[-k]))
                least = np.maximum(np.maximum(lo - to[i], to[i] - hi).max(1), 0) - space.slack
                most = (hi + to[i]).min(1) + space.slack
                best, worst = (reach[i] - np.maximum(least, 0) ** 2) / 2 + 1, (reach[i] - most**2) / 2 - 1
                for c in np.flatnonzero((best >= min(w["lo"] for w in spans)) & (worst <= max(w["hi"] for w in spans))).tolist():
                    n = first[c + 1] - first[c]
                    blocks.append(np.arange(first[c], first[c + 1]))
                    of.append(np.full(n, i))
                windows.append(spans)
            if not of:
                return None
            of = pa.array(np.concatenate(of))
            spans = pa.array(windows, batch.schema.field(3).type).take(of)
            chunk = pa.array(ids % chunks).take(of)
            return pa.record_batch([pa.array(np.concatenate(blocks)), chunk, *[batch.column(j).take(of) for j in range(3)], spans], names=["block", "chunk", "anchor_id", "label", "vector", "windows"])

        def walk(key: tuple, queries: pa.Table, trees: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if queries.num_rows and trees.num_rows:
                tree = pickle.loads(trees.column("tree")[0].as_py())
                q = _matrix(queries.column("vector").combine_chunks(), space.width)
                to = space.from_anchor(q, tree.points)
                reach = (np.einsum("ij,ij->i", q.astype(float), q.astype(float)) + space.top).tolist()
                x = space.numbers(q)
                for i, (anchor, label, spans) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("anchor_id", "label", "windows")))):
                    if positives:
                        wanted = lambda rows: (tree.labels[rows] == label) & (tree.ids[rows] != anchor)  # noqa: B023, E731
                    else:
                        wanted = lambda rows: tree.labels[rows] != label  # noqa: B023, E731
                    taken = [0] * len(spans)
                    span = [min(w["lo"] for w in spans), max(w["hi"] for w in spans)]
                    for score, row in tree.nearest_first(x[i], reach[i], to[i], span, space, wanted):
                        for j, w in enumerate(spans):
                            if taken[j] < k and w["lo"] <= score <= w["hi"]:
                                taken[j] += 1
                                found.append((anchor, w["positive_id"], w["positive_score"], row, score))
                        left = [w["lo"] for j, w in enumerate(spans) if taken[j] < k and w["lo"] <= score]
                        if not left:
                            break
                        span[0] = min(left)
            columns = list(zip(*found)) or [()] * 5
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score", "found_id", "score"), columns)})

        routed = map_arrow(queries.select("anchor_id", "label", "vector", "windows"), route, f"block long, chunk long, {QUERY}")
        trees = self.blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "tree")
        return routed.groupBy("block", "chunk").cogroup(trees.groupBy("block", "chunk")).applyInArrow(walk, "anchor_id long, positive_id long, positive_score long, found_id long, score long")


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = 2048, block: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``anchors`` is a condition over _id)
    and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels within ``low`` to ``high`` hundredths of the positive's score.

    ``sample``: rows that set bounds; ``block``: rows of a tree (a 64th of all, 2048 to 32768, unless given)."""
    spark = df.sparkSession
    rows = prepare(df, id_col, label_col, vector_col, scale)
    index = Index(rows, sample, block)
    if not index.n:
        return spark.createDataFrame([], RESULT)
    one = rows.filter(anchors).groupBy("_id").agg(F.max(F.struct("_y", "_v")).alias("best"))
    queries = cut(one.select(F.col("_id").alias("anchor_id"), F.col("best._y").alias("label"), F.col("best._v").alias("vector"), F.lit(None).cast(WINDOWS).alias("windows")))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    near = index.search(queries, positives, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    # whole-number division towards the window's inside, exact where a quotient of doubles is not
    lo, hi = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    windows = near.select("anchor_id", F.struct(F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")).alias("w")).filter("w.lo <= w.hi").groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    asked = cut(queries.drop("windows").join(windows, "anchor_id").select("anchor_id", "label", "vector", "windows"))
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "found_id")
    found = index.search(asked, negatives, False).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.id AS a, b.id AS b, a.y = b.y AS same, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT AS s
  FROM rows a, rows b WHERE a.id % 50 = 0 AND a.id <> b.id),
positives AS (SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT * FROM (
  SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
WHERE rank <= 3
"""
