"""Column-wise construction of a Burrows-Wheeler transform and common prefixes for many aligned strings.

Strings stand in a table, one column for each position from a common mark; each round inserts one symbol of every
string, from the last column to the first. The order of the suffixes that start in a column follows from the
order in the next one by one stable pass that deals them out by their new first symbol, and the common prefixes of
neighbours by the least value between their old places plus one. The symbols that stand before the suffixes, in their
order, are that column of the transform; only the column at hand is kept, so a round costs one pass over the strings,
whatever their length. Suffixes are ordered within their group, and only those of one column are compared: that is all
that is needed where equal substrings are known to stand at equal distance from the mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MOST = 255  #: common prefixes are counted up to here


def aligned(strings: list[bytes], skip: list[int], columns: int) -> np.ndarray:
    """(columns + 1, strings) table of symbols plus one; string i begins in column skip[i]; 0: no symbol there."""
    table = np.zeros((len(strings), columns + 1), np.int16)
    for i, (s, k) in enumerate(zip(strings, skip)):
        table[i, k : k + len(s)] = np.frombuffer(s, np.uint8)
        table[i, k : k + len(s)] += 1
    return np.ascontiguousarray(table.T)


def column_order(table: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, order, lcp, transform) for each column from the last to the first.

    order: the strings by group and then by their suffix from this column on. lcp[i]: the symbols that suffixes i - 1 and
    i share, at most MOST; 0 between groups. transform: the symbol (plus one) before each suffix, 0 if there is none.
    """
    m = table.shape[1]
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(m, np.int16)
    base = np.unique(group, return_inverse=True)[1].astype(np.int64) * 512
    for column in range(table.shape[0] - 1, -1, -1):
        symbol = table[column][order]
        key = base[order] + symbol
        perm = np.argsort(key, kind="stable")
        key = key[perm]
        new = np.zeros(m, np.int16)
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[perm[1:]] > 0)) + 1
        if len(same):
            low, high = perm[same - 1] + 1, perm[same]
            new[same] = lcp[high]
            wide = np.flatnonzero(high > low)
            if len(wide):
                low, high = low[wide], high[wide]
                size = high - low + 1
                ends = np.cumsum(size)
                spots = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
                new[same[wide]] = np.minimum.reduceat(lcp[spots], ends - size)
            new[same] = np.minimum(new[same] + 1, MOST)
        order, lcp = order[perm], new
        yield column, order, lcp, table[column - 1][order] if column else np.zeros(m, table.dtype)


def shared_windows(strings: list[bytes], skip: list[int], group: list[int], width: int, starts: int) -> list[np.ndarray]:
    """For each string, the columns below ``starts`` where ``width`` symbols begin that another of its group has there."""
    table = aligned(strings, skip, starts + width)
    hit = np.zeros((starts, len(strings)), bool)
    for column, order, lcp, _ in column_order(table, np.array(group, np.int64)):
        if column < starts:
            at = np.flatnonzero(lcp >= width)
            hit[column, order[at]] = True
            hit[column, order[at - 1]] = True
    return [np.flatnonzero(hit[:, i]) for i in range(len(strings))]
