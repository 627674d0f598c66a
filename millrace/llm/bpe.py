"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can be the last of its encoding: the token t for which the encoding of
what precedes it ends in a token u such that (u, t) stays (u, t) when encoded together. The encoder stores that token
for each prefix. So bytes can be appended without encoding anything again, and after an edit only prefixes from the
edit on are redone. Read backwards, the stored tokens are the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches, text_of


class Pairs:
    """Which two tokens can be neighbours in an encoding, and which token two neighbours are merged to.

    ``left`` and ``right`` hold the two parts a token is made of when its bytes are merged alone; a byte has itself.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.age = [0] * size  #: 0 for bytes; a token of greater age is made later
        self.joined: dict[int, int] = {}
        self.stands = [False] * size  #: whether merging a token's bytes gives just it
        for token, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.stands[t] = True
                continue
            self.age[t] = t + 1
            for i in range(1, len(token)):
                u, v = ranks.get(token[:i], -1), ranks.get(token[i:], -1)
                if u >= 0 and v >= 0 and self.age[u] <= t and self.age[v] <= t and self.stands[u] and self.stands[v] and self.fit(u, v):
                    self.left[t], self.right[t], self.stands[t] = u, v, True
                    self.joined[u << 32 | v] = t
                    break

    def fit(self, u: int, v: int) -> bool:
        """Takes the merges on both sides of the border back, the latest first.

        Merging would have crossed the border if the parts that touch there make a token older than the merge that was
        taken back last. Of equal ranks the left one is merged first.
        """
        limit, age, joined = 1 << 40, self.age, self.joined
        while True:
            if joined.get(u << 32 | v, limit) < limit:
                return False
            if not age[u] and not age[v]:
                return True
            if age[u] > age[v]:
                limit, u = u, self.right[u]
            else:
                limit, v = v + 1, self.left[v]


class Columns:
    """The prefix tokens of many pieces at once, one prefix length at a time, with numpy.

    Tokens are looked up in a trie: a row of 256 children for every node that has any. Results of pairs are held in a
    table of fixed size in which a new pair takes the place of the one before it.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs, memo_bits: int = 20):
        inner = {b""} | {t[:i] for t in ranks for i in range(1, len(t))}
        number = {x: k for k, x in enumerate(sorted(inner, key=len))}
        for t in ranks:
            number.setdefault(t, len(number))
        self.child = np.full((len(inner), 256), -1, np.int32)
        for x, k in number.items():
            if x:
                self.child[number[x[:-1]], x[-1]] = k
        self.token = np.full(len(number), -1, np.int32)
        for x, t in ranks.items():
            if pairs.stands[t]:
                self.token[number[x]] = t
        self.left, self.right, self.age = (np.array(x, np.int64) for x in (pairs.left, pairs.right, pairs.age))
        self.bits = max(4, (4 * len(pairs.joined)).bit_length())
        self.keys, self.made = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int64)
        for key, t in pairs.joined.items():
            at = int(self._slot(np.array([key]), self.bits)[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.made[at] = key, t
        self.memo_bits = memo_bits
        self.memo, self.held = np.full(1 << memo_bits, -1, np.int64), np.zeros(1 << memo_bits, bool)

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _joined(self, key: np.ndarray) -> np.ndarray:
        """The token of each pair, or a number above all tokens."""
        at = self._slot(key, self.bits)
        found = self.keys[at]
        out = np.where(found == key, self.made[at], 1 << 40)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def fit(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``Pairs.fit`` of each pair."""
        key = u << 32 | v
        at = self._slot(key, self.memo_bits)
        out = self.held[at]
        fresh = np.flatnonzero(self.memo[at] != key)
        if len(fresh):
            out[fresh] = self._fit(u[fresh], v[fresh])
            self.memo[at[fresh]] = key[fresh]
            same = fresh[self.memo[at[fresh]] == key[fresh]]  # of pairs that meet in a slot, one stays
            self.held[at[same]] = out[same]
        return out

    def _fit(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(u), bool), np.arange(len(u))
        limit = np.full(len(u), 1 << 40)
        while len(rows):
            go = self._joined(u << 32 | v) >= limit
            rows, u, v, limit = rows[go], u[go], v[go], limit[go]
            a, b = self.age[u], self.age[v]
            done = (a == 0) & (b == 0)
            out[rows[done]] = True
            rows, u, v, limit, first = rows[~done], u[~done], v[~done], limit[~done], (a > b)[~done]
            limit = np.where(first, u, v + 1)
            u, v = np.where(first, self.right[u], u), np.where(first, v, self.left[v])
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none is empty) as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)  # where the piece of a byte ends
        begin = stop - np.repeat(sizes, sizes)
        node, at = np.zeros(len(data), np.int32), np.arange(len(data))
        found, depth = [], 0
        while len(at):
            node = self.child[node, data[at + depth]]
            depth += 1
            live = node >= 0
            node, at = node[live], at[live]
            token = self.token[node]
            hit = token >= 0
            found.append((at[hit], token[hit], np.full(int(hit.sum()), depth)))
            live = (node < len(self.child)) & (at + depth < stop[at])
            node, at = node[live], at[live]
        start, token, width = (np.concatenate(x) for x in zip(*found))
        last = start + width - 1
        column = last - begin[start]
        order = np.argsort(column, kind="stable")
        start, token, width, last = start[order], token[order].astype(np.int64), width[order], last[order]
        edges = np.searchsorted(column[order], np.arange(int(sizes.max(initial=0)) + 1))
        first = begin[start] == start
        best, wide = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for a, b in zip(edges, edges[1:]):
            ok = first[a:b].copy()
            later = np.flatnonzero(~ok)
            ok[later] = self.fit(best[start[a:b][later] - 1], token[a:b][later])
            best[last[a:b][ok]], wide[last[a:b][ok]] = token[a:b][ok], width[a:b][ok]
        if len(best) and best.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        chosen, at, rows = np.zeros(len(data), bool), ends - 1, np.arange(len(pieces))
        floor, count = ends - sizes, np.zeros(len(pieces), np.int64)
        while len(at):
            chosen[at] = True
            count[rows] += 1
            at = at - wide[at]
            live = at >= floor[rows]
            at, rows = at[live], rows[live]
        ids, stops = best[chosen].astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]


class PrefixBPE:
    """Encodes as merging by rank does; ``ranks`` maps the bytes of each token to its id.

    ``cache``: encodings of so many pieces of at most ``longest`` bytes are held in each of two halves; when the younger is full, the
    older goes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 100_000, longest: int = 64):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.width = max(map(len, ranks))
        self.pairs = Pairs(ranks)
        self.columns = Columns(ranks, self.pairs)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank, the leftmost of equals, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Adds to ``last`` the last token of each prefix of ``data`` longer than those it covers."""
        get, stands, fit = self.ranks.get, self.pairs.stands, self.pairs.fit
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.width), end):
                t = get(data[start:end])
                if t is not None and stands[t] and (start == 0 or fit(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def read(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """(data + more, its prefix tokens); what is stored for ``data`` stays valid."""
        return data + more, self.extend(data + more, list(last))

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """``data`` with ``data[start:end]`` replaced; only prefixes from ``start`` on are encoded again."""
        data = data[:start] + new + data[end:]
        return data, self.extend(data, last[:start])

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token is that token, as in rank-file tokenizers; else the prefix encoding."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.extend(data, []))

    def _learn(self, pieces: set[str]) -> list[str]:
        """Puts the encodings of all of ``pieces`` into ``young``; returns those too long to stay there."""
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        young, short, long = self.young, [], []
        for p in pieces:
            if p not in young:
                held = self.old.get(p)
                if held is not None:
                    young[p] = held
                    continue
                data = p.encode("utf-8", "surrogatepass")
                t = self.ranks.get(data)
                if t is not None:
                    young[p] = t.to_bytes(4, "little")
                elif len(data) > self.longest:
                    young[p] = np.array(self.piece(data), "<u4").tobytes()
                    long.append(p)
                else:
                    short.append((p, data))
        if short:
            young.update(zip([p for p, _ in short], self.columns.encode([d for _, d in short])))
        return long

    def encode_all(self, texts: list[str], block: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces of some ``block`` characters are encoded together."""
        at = 0
        while at < len(texts):
            found, size = [], 0
            while at < len(texts) and size < block:
                found.append(self.find(texts[at]))
                size += len(texts[at])
                at += 1
            long = self._learn(set().union(*found))
            for x in found:
                yield b"".join(map(self.young.__getitem__, x))
            for p in long:
                del self.young[p]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> PrefixBPE:
    """The encoder of a rank file (base64 token and rank per line), kept for the life of a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return PrefixBPE(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids (binary, little-endian u32), decoded (binary).

    ``path``: a rank file that every executor has with the tokenizer's package. Null text counts as empty and gives no
    ids. A text is encoded in one task, with memory in proportion to that text.
    """
    return _apply(df, path, pattern, id_col, text_col, False)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of ids and decoded bytes."""
    return _apply(df, path, pattern, id_col, text_col, True)


def _apply(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        ids = list(bpe.encode_all(batch.column(1).to_pylist()))
        back = [bpe.decode(x) for x in ids]
        n = pa.array([len(x) // 4 for x in ids], pa.int64())
        if digest:
            cols = [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (ids, back)]
            return pa.record_batch([batch.column(0), n, *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.record_batch([batch.column(0), n, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    columns = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return map_arrow(text_of(df, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, {columns}")
