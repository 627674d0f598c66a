"""Toxicity by the nearest labelled examples under TF-IDF cosine, exact, from a block-max inverted index.

Fitting takes a bounded sample of labelled texts of each class (distinct texts, least hashes first). All its words make the vocabulary. A
word weighs (1 + ln tf) * idf * |phi|, where phi is the correlation of its presence with the label: without that factor the
subject of a text drowns its tone (README has figures). The index holds for each word the examples that have it, cut into blocks
of examples with the largest weight in each. A query adds up the shares of frequent words; where the blocks' maxima of its rare words leave few
examples that can be among the k nearest, these are scored in full, else its rare words are added up first. Ties go to the first example.
The neighbours vote with their cosine as weight and each class weighed back to its share of all labelled rows; votes are
mapped to probabilities by isotonic regression on leave-one-out votes of the sample. The neighbours are the evidence.

* Null text counts as empty. A text without any word of the sample has no neighbours and gets the probability of such texts.
* A null label counts as 0, documents with several labels as the largest. Without labels every score is 0.
* The model grows with the sample, at most ``per_class`` texts of each class; scoring shuffles nothing and holds one batch. A text of
  any length is read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, return_arrays, small_batches, text_of

word_hash = xxhash.xxh64_intdigest
WORDS = re.compile(r"[^\W\d_]+")
BLOCK = 32
FEW = 48  #: examples that are scored in full at most, before the rare words are added up for all


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Postings of unit vectors: ``start`` of each term, then ``example`` and ``weight``; blocks likewise, with their largest weight.

    ``row_start``, ``term`` and ``value`` hold the same vectors by example.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        """Example i has the next ``sizes[i]`` of ``terms``, in rising order, and ``weights``."""
        self.n = len(sizes)
        self.row_start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.term, self.value = terms.astype(np.int32), weights.astype(np.float32)
        example = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        order = np.argsort(self.term, kind="stable").astype(np.int32)
        self.example, self.weight = example[order], self.value[order]
        held = self.term[order]
        self.start = np.searchsorted(held, np.arange(n_terms + 1)).astype(np.int64)
        block = self.example // BLOCK
        first = np.flatnonzero(np.diff(held, prepend=-1) | np.diff(block, prepend=-1)) if len(held) else np.zeros(0, np.int64)
        self.block = block[first]
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.block_start = np.searchsorted(held[first], np.arange(n_terms + 1)).astype(np.int64)
        self.query = np.zeros(n_terms)
        self.full: np.ndarray | None = None

    def _fill(self) -> None:
        """Writes the postings of terms that an eighth of the examples have out in full, in rows by example; not part of what is sent to tasks."""
        many = np.flatnonzero(np.diff(self.start) * 8 >= max(self.n, 1))
        self.slot = np.full(len(self.start) - 1, -1)
        self.slot[many] = np.arange(len(many))
        self.full = np.zeros((len(many), self.n), np.float32)
        for i, t in enumerate(many.tolist()):
            a, b = self.start[t], self.start[t + 1]
            self.full[i, self.example[a:b]] = self.weight[a:b]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"full": None}

    def cosines(self, rows: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each of ``rows`` with the query; sums run in the order of terms, so equal examples get equal numbers."""
        sizes = self.row_start[rows + 1] - self.row_start[rows]
        cells = _ranges(self.row_start[rows], sizes)
        self.query[terms] = w
        shares = self.query[self.term[cells]] * self.value[cells]
        self.query[terms] = 0
        return np.add.reduceat(shares, np.cumsum(sizes) - sizes) if len(rows) else shares

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights): (examples, cosines) of the ``k`` nearest with a cosine over 0, the first of equals.

        ``without``: an example for each query that doesn't count.
        """
        if self.full is None:
            self._fill()
        for at in range(0, len(queries), 64):
            part = queries[at : at + 64]
            q = np.zeros((len(part), len(self.full)), np.float32)
            rare = []
            for i, (terms, w) in enumerate(part):
                slot = self.slot[terms]
                q[i, slot[slot >= 0]] = w[slot >= 0]
                rare.append(slot < 0)
            sums = q @ self.full
            for i, (terms, w) in enumerate(part):
                yield self._finish(sums[i], terms, w, rare[i], k, without[at + i] if without else -1)

    def _finish(self, sums: np.ndarray, terms: np.ndarray, w: np.ndarray, rare: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``sums`` has the shares of the terms that aren't ``rare``."""
        if without >= 0:
            sums[without] = 0
        t, wt = terms[rare], w[rare]
        sizes = self.block_start[t + 1] - self.block_start[t]
        cells = _ranges(self.block_start[t], sizes)
        rest = np.bincount(self.block[cells], np.repeat(wt, sizes) * self.block_max[cells], -(-self.n // BLOCK))
        rows = self._open(sums, np.repeat(rest, BLOCK)[: self.n], k)
        if len(rows) > FEW:
            sizes = self.start[t + 1] - self.start[t]
            cells = _ranges(self.start[t], sizes)
            sums = sums + np.bincount(self.example[cells], np.repeat(wt, sizes) * self.weight[cells], self.n)
            if without >= 0:
                sums[without] = 0
            rows = self._open(sums, 0.0, k)
        rows = rows[rows != without]
        found = self.cosines(rows, terms, w)
        rows, found = rows[found > 0], found[found > 0]
        top = np.lexsort((rows, -found))[:k]
        return rows[top], found[top]

    def _open(self, sums: np.ndarray, rest: np.ndarray | float, k: int) -> np.ndarray:
        """The examples that can be among the ``k`` nearest if ``rest`` is the most that sums lack; sums may err by 0.00001."""
        kth = np.partition(sums, self.n - k)[self.n - k] if self.n > k else 0.0
        bound = sums + rest
        return np.flatnonzero((bound >= kth - 2e-5) & (bound > 0))


@dataclass
class Model:
    vocabulary: np.ndarray  #: 64-bit hashes of the words, sorted; a word's place is its term
    weight: np.ndarray
    index: Index
    labels: np.ndarray
    weights: np.ndarray
    ids: list
    k: int
    prior: float
    steps: list[tuple[float, float]] = field(default_factory=list)
    empty: float = 0.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of ``text``; no terms if it has no word of the sample."""
        seen = Counter(WORDS.findall(text.lower()))
        hashes = np.array([word_hash(w.encode("utf-8", "surrogatepass"), 42) for w in seen], np.uint64).view(np.int64)
        n = np.fromiter(seen.values(), np.int64, len(seen))
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        terms = np.searchsorted(self.vocabulary[:-1], hashes)
        known = self.vocabulary[terms] == hashes
        terms, n = terms[known], n[known]
        if not len(terms):
            return terms, np.zeros(0)
        w = (1 + np.log(n)) * self.weight[terms]
        return terms, w / np.linalg.norm(w)

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines * self.weights[near]
        return float((w @ self.labels[near] + 0.1 * self.prior) / (w.sum() + 0.1))

    def calibrated(self, vote: float) -> float:
        p = self.prior
        for least, value in self.steps:
            if vote < least:
                break
            p = value
        return p

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple]]]:
        """(probability, evidence) of each text; evidence: (example id, cosine, label) of the nearest."""
        if not len(self.labels) or not len(self.vocabulary):
            return [(self.prior, [])] * len(texts)
        out: list = [(self.empty, [])] * len(texts)
        open_: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            open_.setdefault(t or "", []).append(i)
        vectors = [(t, *self.vector(t)) for t in open_]
        vectors = [x for x in vectors if len(x[1])]
        for (t, *_), (near, cosines) in zip(vectors, self.index.nearest([x[1:] for x in vectors], self.k)):
            p = self.calibrated(self.vote(near, cosines)) if len(near) else self.empty
            evidence = [(self.ids[i], round(float(c), 6), int(self.labels[i])) for i, c in zip(near[:5].tolist(), cosines[:5].tolist())]
            for i in open_[t]:
                out[i] = p, evidence
        return out


def isotonic(votes: list[float], labels: list[float], weights: list[float]) -> list[tuple[float, float]]:
    """(least vote, probability) steps, by pooling adjacent violators."""
    merged: dict[float, list[float]] = {}
    for v, y, w in zip(votes, labels, weights):
        m = merged.setdefault(round(v, 6), [0.0, 0.0])
        m[0] += y * w
        m[1] += w
    pools: list[list[float]] = []
    for v in sorted(merged):
        pools.append([v, *merged[v]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return [(v, (a + 0.01 * a / b) / (b + 0.01)) for v, a, b in pools]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, k: int = 15, usable: Column | None = None) -> Model:
    """A model from ``labels`` (``usable`` says which rows may be learned from), at most ``per_class`` texts of each class."""
    return_arrays()
    known = labels.select(F.col(id_col).alias("_id"), F.coalesce(F.col(label_col).cast("int"), F.lit(0)).alias("_y"), (usable if usable is not None else F.lit(True)).alias("_ok"))
    known = known.filter("_ok AND _id IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    none = np.zeros(0)
    empty = Model(none.astype(int), none, Index(none.astype(int), none.astype(int), none, 0), none, none, [], k, (share.get(1, 0) / total) if total else 0.0)
    if not total:
        return empty
    draw = F.xxhash64("_id")
    chosen = known.filter("_y = 1").orderBy(draw, "_id").limit(per_class).unionByName(known.filter("_y = 0").orderBy(draw, "_id").limit(per_class))
    # at most 2 * per_class ids, so the broadcast has a bound
    texts = text_of(docs, id_col, text_col).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy(F.sha2("_text", 256).alias("sha")).agg(F.min("_id").alias("_id"), F.max("_y").alias("_y"), F.first("_text").alias("_text")).drop("sha")
    texts = cut(texts)  # the sample, read three times below
    term = F.explode(F.transform(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), 0), lambda w: F.xxhash64(w))).alias("term")
    words = cut(texts.select("_id", "_y", term).groupBy("_id", "_y", "term").agg(F.count("*").cast("int").alias("tf")))
    sizes = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    n = pos + neg
    counts = words.groupBy("term").agg(F.sum("_y").alias("a"), F.count("*").alias("df"))
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    phi2 = F.pow(a * (F.lit(neg) - df + a) - (df - a) * (F.lit(pos) - a), 2) / (df * (F.lit(n) - df) * F.lit(max(pos * neg, 1.0)))
    kept = counts.filter(df < n).select("term", ((F.log(F.lit(1 + n) / (1 + df)) + 1) * F.sqrt(phi2)).alias("weight")).filter("weight > 0").toArrow()
    if not kept.num_rows:
        return empty
    order = np.argsort(kept.column("term").to_numpy())
    vocabulary, weight = kept.column("term").to_numpy()[order], kept.column("weight").to_numpy()[order]
    bags = words.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("bag"))
    rows = texts.select("_id", "_y").join(bags, "_id", "left").toArrow()

    # numbers of 32 bits, and no copies that outlive their use: the driver is small
    ids, y = rows.column("_id").to_pylist(), np.array(rows.column("_y").to_pylist(), np.float64)
    held = rows.column("bag").combine_chunks()
    size = np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    hashes, tf = (held.flatten().field(i).to_numpy() for i in (0, 1))
    terms = np.searchsorted(vocabulary[:-1], hashes).astype(np.int32)
    known = vocabulary[terms] == hashes
    value = (1 + np.log(tf, dtype=np.float32)) * weight.astype(np.float32)[terms]
    del rows, held, hashes, tf
    example = np.repeat(np.arange(len(ids), dtype=np.int32), size)[known]
    terms, value, size = terms[known], value[known], np.bincount(example, minlength=len(ids))
    value /= np.sqrt(np.bincount(example, value * value, len(ids))).astype(np.float32)[example]
    start, filled = np.cumsum(size) - size, np.flatnonzero(size)
    lead = {i: int(terms[a + value[a : a + n].argmax()]) for i, a, n in zip(filled.tolist(), start[filled].tolist(), size[filled].tolist())}
    filled = sorted(filled.tolist(), key=lambda i: (y[i], lead[i], str(ids[i])))  # examples that share their heaviest word stand together
    by = _ranges(start[filled], size[filled]).astype(np.int32)
    del example
    index = Index(size[filled], terms[by], value[by], len(vocabulary))
    del terms, value, by

    per = {1: share.get(1, 0) / max(pos, 1), 0: share.get(0, 0) / max(neg, 1)}
    per = {c: w * n / total for c, w in per.items()}
    model = Model(vocabulary, weight, index, y[filled], np.where(y[filled] > 0, per[1], per[0]), [ids[i] for i in filled], k, share.get(1, 0) / total)
    bare = np.flatnonzero(size == 0)
    if len(bare):
        w = np.where(y[bare] > 0, per[1], per[0])
        model.empty = float(w @ y[bare] / w.sum())
    else:
        model.empty = model.prior
    votes, ys, ws = [], [], []
    drawn = list(range(0, len(filled), max(1, len(filled) // 2000)))
    spans = [slice(index.row_start[i], index.row_start[i + 1]) for i in drawn]
    for i, (near, cosines) in zip(drawn, index.nearest([(index.term[x], index.value[x].astype(float)) for x in spans], k, drawn)):
        if len(near):
            votes.append(model.vote(near, cosines))
            ys.append(float(model.labels[i]))
            ws.append(float(model.weights[i]))
    model.steps = isotonic(votes, ys, ws)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``id_col``, score, predicted, evidence."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found = m.scores(batch.column(1).to_pylist())
        p = [x[0] for x in found]
        evidence = pa.array([[{"example": str(e), "cosine": c, "label": y} for e, c, y in x[1]] for x in found], pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())])))
        return pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), evidence], names=[id_col, "score", "predicted", "evidence"])

    return map_arrow(text_of(docs, id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int, evidence array<struct<example: string, cosine: double, label: int>>")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.filter(pa.array([p < threshold for p, _ in m.scores(texts)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
