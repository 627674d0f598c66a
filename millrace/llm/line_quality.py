"""Document quality by a linear-chain conditional random field over the lines of a text.

Every line with a visible character is labelled good or bad. Its features are shares of kinds of characters and words, repetition
within the line and of the line within its text, and the same numbers of the line before and after it. Fitting takes a bounded
sample of labelled texts: lines start with the label of their text; lines of bad texts that look good by themselves (the chain
switched off) are then taken for good, for junk may fill a part of a text only; then weights and transitions are fitted together by
penalised likelihood (L-BFGS), each text counting alike. The forward-backward marginals of a text's lines, weighted by the lines'
lengths, give its share of good text; a logistic curve fitted on the sample, with classes weighed back to their shares among all
labels, maps that share to the score.

* Null text counts as empty. A text without a visible character has no lines and gets the share of good ones among such texts
  of the sample, the share of good labels where there are none.
* A null label is no label; of several labels of a document the least counts. Without labels of both kinds, every score is the share
  of good labels, 0.5 without any.
* Repeated rows are scored each for itself; scores don't depend on order or batches. Other columns are neither read nor returned.
* The sample has at most ``per_class`` texts and ``max_lines`` lines of each class, texts by hash of their id, so the driver holds a bounded
  model; scoring shuffles nothing. Whole texts are read, in blocks of some million characters (one text at least).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches, text_of

BLOCK_CHARS = 2_000_000
KINDS = LOWER, UPPER, LETTER, DIGIT, STOP, PUNCTUATION, SYMBOL, SPACE = range(8)
BASE = 24  #: features of a line by itself


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each 16-bit code point, and two tables of random odd numbers for hashes of words."""
    kind = np.full(1 << 16, SYMBOL, np.uint8)
    for i in range(1 << 16):
        c = unicodedata.category(chr(i))
        if c == "Ll":
            kind[i] = LOWER
        elif c in ("Lu", "Lt"):
            kind[i] = UPPER
        elif c[0] in "LM":
            kind[i] = LETTER
        elif c[0] == "N":
            kind[i] = DIGIT
        elif c[0] == "Z" or c == "Cc":
            kind[i] = SPACE
        elif c[0] == "P":
            kind[i] = PUNCTUATION
    kind[[ord(c) for c in ".!?…。！？"]] = STOP
    r = np.random.default_rng(12)
    draw = lambda n: r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return kind, draw(1 << 16), draw(1 << 12)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct values of each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[first], minlength=n)


def _block(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, its length, its ``BASE`` features) of all lines with a visible character."""
    kind_of, mix, odd = _tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(codes == 10)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    low = codes.astype(np.uint16)
    kind = kind_of[low]
    kind[codes > 0xFFFF] = SYMBOL
    n = len(breaks) + 1
    line = np.zeros(len(codes) + 1, np.int32)
    line[breaks + 1] = 1
    line = np.cumsum(line[: len(codes)], dtype=np.int32)
    counts = np.bincount(line * np.int64(8) + kind, minlength=n * 8)[: n * 8].reshape(n, 8).astype(np.float64)
    of = np.searchsorted(ends, np.concatenate((breaks, [len(codes)])), "left")

    seen = kind != SPACE
    begin = np.flatnonzero(seen & ~np.concatenate(([False], seen[:-1])))
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, BASE))
    end = np.flatnonzero(seen & ~np.concatenate((seen[1:], [False]))) + 1
    size = end - begin
    row = line[begin]
    word = np.cumsum(seen & ~np.concatenate(([False], seen[:-1]))) - 1
    at = (np.arange(len(codes)) - begin[np.maximum(word, 0)]) & 0xFFF
    h = np.add.reduceat(np.where(seen, mix[low] * odd[at], np.uint64(0)), begin)
    words = np.bincount(row, minlength=n).astype(np.float64)
    share = lambda flags: np.bincount(row[flags], minlength=n) / np.maximum(words, 1)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])))
    pair = np.where(np.concatenate((row[1:] == row[:-1], [False])), h + np.roll(h, -1) * np.uint64(0x9E3779B97F4A7C15), h)
    last, first = kind[end - 1], kind[begin]
    marks = size - np.add.reduceat(np.where(kind <= DIGIT, 1, 0), begin)

    length = counts[:, :SPACE].sum(1)
    letters = np.maximum(counts[:, :DIGIT].sum(1), 1)
    long = np.maximum(length, 1)
    head, tail = np.full(n, SPACE), np.full(n, SPACE)
    head[row[::-1]], tail[row] = first[::-1], last
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, row, h * odd[np.arange(len(h)) - np.searchsorted(row, row) & 0xFFF])
    kept = length > 0
    key = whole ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    distinct, pairs = _distinct(row, h, n), _distinct(row, pair, n)
    x = np.stack(
        [
            np.log1p(length), np.log1p(words), letters / long, counts[:, UPPER] / letters, counts[:, LETTER] / letters, counts[:, DIGIT] / long,
            counts[:, STOP] / long, counts[:, PUNCTUATION] / long, counts[:, SYMBOL] / long, long / np.maximum(words, 1), share(size <= 3), share(size >= 16),
            share(again), distinct / np.maximum(words, 1), pairs / np.maximum(words, 1), np.log1p(words) - np.log1p(distinct), share(marks == size), share(marks >= 2),
            share((first == UPPER) & (size > 1)), share((last != STOP) & (last > DIGIT)), head == UPPER, tail == STOP, np.log(times[back]), np.concatenate(([False], (key[1:] == key[:-1]) & kept[:-1])),
        ],
        1,
    )
    return of[kept], length[kept], x[kept]


def line_features(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of lines, their lengths, their features) of each text, in order."""
    held: list[str] = []
    chars = 0

    def flush():
        of, length, x = _block(held)
        edges = np.searchsorted(of, np.arange(len(held) + 1))
        for a, b in zip(edges, edges[1:]):
            yield int(b - a), length[a:b], x[a:b]

    for t in texts:
        held.append(t or "")
        chars += len(held[-1])
        if chars >= BLOCK_CHARS:
            yield from flush()
            held, chars = [], 0
    if held:
        yield from flush()


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The features of each line, of the one before and the one after it, and whether there are such; ``sizes``: lines of each text."""
    n = len(x)
    starts = np.cumsum(sizes) - sizes
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = sizes > 0
    first[starts[full]], last[(starts + sizes - 1)[full]] = True, True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate((x, before, after, first[:, None], last[:, None], np.ones((n, 1))), 1)


class Chain:
    """Texts of ``sizes`` lines side by side: step t holds the t-th line of every text that has one."""

    def __init__(self, sizes: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        self.order, self.n = order, len(sizes)
        alive = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
        self.steps = [starts[order[:k]] + t for t, k in enumerate(alive.tolist())]
        self.ends = (starts + sizes - 1)[order]

    def run(self, u: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log odds of good over bad at every line, and the log of each text's normaliser.

        ``u``: the log odds that a line's features give; ``move[i, j]``: weight of label j after label i (0 bad, 1 good).
        """
        ahead, behind, total = u.copy(), np.zeros(len(u)), np.zeros(len(u))
        for prev, now in zip(self.steps, self.steps[1:]):
            a = ahead[prev[: len(now)]]
            low = np.logaddexp(move[0, 0], a + move[1, 0])
            ahead[now] += np.logaddexp(move[0, 1], a + move[1, 1]) - low
            total[now] = total[prev[: len(now)]] + low
        for now, then in zip(self.steps[-2::-1], self.steps[:0:-1]):
            b = u[then] + behind[then]
            behind[now[: len(then)]] = np.logaddexp(move[1, 0], b + move[1, 1]) - np.logaddexp(move[0, 0], b + move[0, 1])
        z = np.zeros(self.n)
        z[self.order] = total[self.ends] + np.logaddexp(0, ahead[self.ends])
        return ahead, behind, z

    def marginals(self, u: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The probability of good at every line."""
        ahead, behind, _ = self.run(u, move)
        return _sigmoid(ahead + behind)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lbfgs(f, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """A minimum of ``f``, which gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, marks = grad.copy(), []
        for s, y in reversed(past):
            marks.append(s @ d / (s @ y))
            d -= marks[-1] * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), m in zip(past, reversed(marks)):
            d += (m - y @ d / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        for _ in range(25):
            new = x - step * d
            v, g = f(new)
            if v <= value - 1e-4 * step * (grad @ d):
                break
            step /= 2
        else:
            break
        if (new - x) @ (g - grad) > 1e-12:
            past = [*past[1 - memory :], (new - x, g - grad)]
        done = value - v < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


def fit_chain(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, chained: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and transitions that maximise the penalised likelihood of the labels ``y`` of all lines.

    ``weight``: of each text; its lines' likelihood is divided by their number.
    """
    chain = Chain(sizes)
    full = sizes > 0
    of = np.repeat(np.arange(len(sizes)), sizes)
    per = np.where(full, weight / np.maximum(sizes, 1), 0)
    inner = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, int)
    pair_weight = per[of[inner]]
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[inner].astype(int), y[inner + 1].astype(int)), pair_weight)
    k = x.shape[1]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, move = p[:k], (p[k:].reshape(2, 2) if chained else np.zeros((2, 2)))
        u = x @ w
        ahead, behind, z = chain.run(u, move)
        p1 = _sigmoid(ahead + behind)
        then = u[inner + 1] + behind[inner + 1]
        joint = np.stack([[np.full(len(inner), move[0, 0]), move[0, 1] + then], [ahead[inner] + move[1, 0], ahead[inner] + move[1, 1] + then]])
        joint = np.exp(joint - joint.max((0, 1)))
        joint /= joint.sum((0, 1))
        gold = (per[of] * y) @ u + (truth * move).sum()
        value = per @ z - gold + ridge * (p @ p)
        grad = np.concatenate((x.T @ (per[of] * (p1 - y)), ((joint * pair_weight).sum(2) - truth).ravel() if chained else np.zeros(4)))
        return value, grad + 2 * ridge * p

    p = _lbfgs(loss, np.zeros(k + 4))
    return p[:k], p[k:].reshape(2, 2)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    curve: tuple[float, float]  #: the score is the logistic function of curve[0] * log odds of the share of good text + curve[1]
    empty: float  #: score of a text without lines
    prior: float | None = None  #: score of every text, where nothing could be learned

    def inputs(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, sizes)

    def line_marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return Chain(sizes).marginals(self.inputs(x, sizes) @ self.weights, self.move)

    def shares(self, x: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The share of good text of each text, by its lines' marginals and lengths; 0 without lines."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(of, length, len(sizes))
        return np.bincount(of, length * self.line_marginals(x, sizes), len(sizes)) / np.maximum(total, 1)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The score of each text."""
        out: list[np.ndarray] = []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush():
            sizes = np.array([h[0] for h in held])
            if self.prior is not None:
                return np.full(len(sizes), self.prior)
            length, x = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            return np.where(sizes > 0, _sigmoid(self.curve[0] * _log_odds(self.shares(x, sizes, length)) + self.curve[1]), self.empty)

        lines = 0
        for one in line_features(texts):
            held.append(one)
            lines += one[0]
            if lines > 50_000:
                out.append(flush())
                held, lines = [], 0
        if held:
            out.append(flush())
        return np.concatenate(out) if out else np.zeros(0)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_lines(x: np.ndarray, sizes: np.ndarray, length: np.ndarray, y: np.ndarray, share_good: float) -> Model:
    """A model of texts of ``sizes`` lines with features ``x`` and lengths, ``y`` good or bad; ``share_good``: among all labels."""
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    if not len(x) or len(set(y[sizes > 0].tolist())) < 2:
        return Model(np.zeros(BASE), np.ones(BASE), np.zeros(3 * BASE + 3), np.zeros((2, 2)), (0.0, 0.0), share_good, prior=share_good)
    even = np.where(y > 0, 1 / n[1], 1 / n[0])
    of = np.repeat(np.arange(len(sizes)), sizes)
    model = Model(x.mean(0), x.std(0) + 1e-3, np.zeros(0), np.zeros((2, 2)), (1.0, 0.0), share_good)
    z = model.inputs(x, sizes)
    label = y[of].astype(float)
    weights, _ = fit_chain(z, sizes, label, even, chained=False)
    alone = _sigmoid(z @ weights)
    worst = np.full(len(sizes), np.inf)
    np.minimum.at(worst, of, alone)
    label = np.where((label == 0) & (alone > 0.5) & (alone > worst[of]), 1.0, label)
    model.weights, model.move = fit_chain(z, sizes, label, even)
    full = sizes > 0
    s = _log_odds(model.shares(x, sizes, length))[full]
    back = np.where(y > 0, share_good / n[1], (1 - share_good) / n[0])
    target, w = y[full].astype(float), back[full]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        v = p[0] * s + p[1]
        g = w * (_sigmoid(v) - target)
        return float(w @ (np.logaddexp(0, v) - target * v) + 1e-4 * (p @ p)), np.array([g @ s, g.sum()]) + 2e-4 * p

    model.curve = tuple(_lbfgs(loss, np.array([1.0, 0.0])).tolist())
    if (~full).any():
        model.empty = float(back[~full] @ y[~full] / back[~full].sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, max_lines: int = 50_000, usable: Column | None = None) -> Model:
    """A model from ``labels`` (``usable`` says which rows may be learned from), at most ``per_class`` texts and ``max_lines`` lines of each class."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("_id"), (F.col(label_col).cast("int") > 0).cast("int").alias("_y"), (usable if usable is not None else F.lit(True)).alias("_ok"))
    known = known.filter("_ok AND _id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y"))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share_good = count.get(1, 0) / sum(count.values()) if count else 0.5
    draw = F.xxhash64("_id")
    chosen = known.filter("_y = 1").orderBy(draw, "_id").limit(per_class).unionByName(known.filter("_y = 0").orderBy(draw, "_id").limit(per_class))
    # at most 2 * per_class ids, so the broadcast has a bound
    texts = text_of(docs, id_col, text_col).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("draw"), "_y", "_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(line_features(batch.column(2).to_pylist()))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())), pa.array([f[2].ravel().astype(np.float32) for f in found], pa.list_(pa.float32()))], names=["draw", "_y", "n", "length", "x"])

    lines = cut(map_arrow(texts, run, "draw long, _y int, n int, length array<float>, x array<float>"))
    order = Window.partitionBy("_y").orderBy("draw", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("to", F.sum("n").over(order)).filter(F.col("to") <= max_lines).orderBy("_y", "to", "draw").toArrow()
    sizes, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "_y"))
    length, x = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("length", "x"))
    del rows
    return fit_lines(x.reshape(-1, BASE), sizes, length, y, share_good)


def _score_batch(model: Model, texts: pa.Array, threshold: float) -> tuple[pa.Array, pa.Array]:
    p = model.scores(x.as_py() for x in texts)
    return pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col``, score (1: good) and predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), *_score_batch(shared.value, batch.column(1), threshold)], names=[id_col, "score", "predicted"])

    return map_arrow(text_of(docs, id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every line with a visible character of every text: ``id_col``, line (its number among these, from 0), good (its marginal) and label."""
    small_batches(docs.sparkSession, 64)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(line_features(x.as_py() for x in batch.column(1)))
        sizes = np.array([f[0] for f in found])
        if not sizes.sum():
            return None
        p = shared.value.line_marginals(np.concatenate([f[2] for f in found]), sizes) if shared.value.prior is None else np.full(sizes.sum(), shared.value.prior)
        of = np.repeat(np.arange(len(sizes)), sizes)
        number = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
        return pa.record_batch([batch.column(0).take(pa.array(of)), pa.array(number, pa.int32()), pa.array(p, pa.float64()), pa.array(np.where(p >= threshold, "good", "bad"))], names=[id_col, "line", "good", "label"])

    return map_arrow(text_of(docs, id_col, text_col), run, f"`{id_col}` {kind}, line int, good double, label string")
