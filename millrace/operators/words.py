"""Words of many texts at once, by columns of bytes; this runs on executors, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

# FNV-1a of 64 bits: its offset and prime, fixed values
OFFSET, PRIME = 14695981039346656037, (1 << 40) + 435
DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# bytes of texts at a time
SLICE = 4 << 20


def word_hashes(data, bounds, letters: bytes, least: int = 1) -> tuple:
    """(h, first): FNV-1a of each lowered word of the bytes ``data``, in order, and where each text's words begin among them.

    Text k is ``data[bounds[k]:bounds[k + 1]]``; a word is a run of ``letters``, of ``least`` bytes at least.
    """
    import numpy as np

    table = np.zeros(256, np.uint8)
    table[np.frombuffer(letters, np.uint8)] = np.frombuffer(letters.lower(), np.uint8)
    data = table[data]
    inside = np.concatenate([[False], data > 0, [False]])
    cut = np.zeros(len(data) + 1, bool)  # no word goes over the end of a text
    cut[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
    length = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1 - start
    start, length = start[length >= least], length[length >= least]
    order = np.argsort(-length, kind="stable")
    at, more = start[order], np.cumsum(np.bincount(length, minlength=1)[::-1])[::-1]  # more[j]: words of j bytes at least
    h, prime = np.full(len(at), OFFSET, np.uint64), np.uint64(PRIME)
    for j in range(len(more) - 1):
        if (n := more[j + 1]) < 16:  # the rest of a few long words
            for k in range(n):
                x = int(h[k])
                for byte in data[at[k] + j : at[k] + length[order[k]]].tobytes():
                    x = (x ^ byte) * PRIME & ((1 << 64) - 1)
                h[k] = x
            break
        h[:n] = (h[:n] ^ data[at[:n] + j]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out, np.searchsorted(start, bounds)


def slices(texts, letters: bytes, least: int = 1) -> Iterator:
    """(begin, end, h, first) for some texts at a time of an Arrow column without nulls: ``word_hashes`` of those from begin to end."""
    import numpy as np

    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLICE, "right")) - 1)
        yield begin, end, *word_hashes(data[at[begin] : at[end]], at[begin : end + 1] - at[begin], letters, least)
        begin = end
