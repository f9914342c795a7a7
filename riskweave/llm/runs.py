"""Periodic runs of words: stretches that repeat with a period, found by descending LCP.

A run is a stretch of words with smallest period ``q`` that no neighbouring
word extends and that is at least ``exponent`` periods and ``shortest`` words
long. Suffixes of a text are put into classes of equal beginnings, which are
united by decreasing length of the common beginning (LCP) with union-find. A
class keeps its positions in order. Where two positions of different classes
become neighbours at a distance ``d`` within the LCP ``l``, the words from the
first on repeat with smallest period ``d`` over ``d + l`` words; the pair whose
words before differ is the start of a run, and each run has exactly one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm.common import add_columns

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
#: Characters of text that a task holds at once, apart from a longer single text.
BATCH = 1 << 20


def find_runs(df: DataFrame, text: str = "text", shortest: int = 6, exponent: int = 4) -> DataFrame:
    """Add ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    Words are what stands between ASCII white space. ``collapsed`` has the
    words joined by one space, without those that lie in a run after its first
    period. A null or empty text has no words, no runs and an empty
    ``collapsed``. Rows are judged one by one, so repeated rows come out alike
    and an empty table stays empty. Columns of the added names, in any case,
    are replaced; all others pass through, the text does not.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has at least two periods and two words")
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
                          T.StructField("collapsed", T.StringType())])
    return add_columns(df, added, lambda: lambda texts: _columns(texts, shortest, exponent), text, most=BATCH)


def _columns(texts: list[str], shortest: int, exponent: int) -> list:
    words = [t.encode().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    total = int(lengths.sum())
    known = dict.fromkeys(chain.from_iterable(words))
    number = dict(zip(known, range(len(known)), strict=True))
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, total)
    start, length, period = runs_of(codes, lengths, shortest, exponent)

    text = np.searchsorted(ends, start, "right")
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth)[:total] == 0
    first = ends - lengths
    hit = set(text.tolist())
    collapsed = [b" ".join(compress(w, kept[first[i]:ends[i]].tolist()) if i in hit else w).decode()
                 for i, w in enumerate(words)]
    fields = [start - first[text], length, period]
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(text, np.arange(len(words) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields],
                                   fields=[pa.field(n, pa.int64(), False) for n in RUN.names]))
    return [lengths, runs, collapsed]


def runs_of(codes: np.ndarray, lengths: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, ...]:
    """Start (in all of ``codes``), length and period of every run, by start, then period."""
    # A pair at distance d seeds a run only if its LCP reaches (exponent - 1) * d and shortest - d.
    least = min(max(shortest - d, (exponent - 1) * d) for d in range(1, shortest + 1))
    x, y, lcp = _neighbours(codes, lengths, least)
    i, j, l = _unite(x, y, lcp, shortest, exponent)
    opens = np.zeros(len(codes) + 1, bool)
    opens[np.cumsum(lengths) - lengths] = True
    begins = opens[i] | (codes[i - 1] != codes[j - 1])
    i, j, l = i[begins], j[begins], l[begins]
    order = np.lexsort((j - i, i))
    return i[order], (j - i + l)[order], (j - i)[order]


def _shared(codes: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``least`` words stand elsewhere in the text too, and a number of these words."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    at = np.flatnonzero(left >= least)
    # Most are told by a count over hash values; equal words always share a value.
    mixed = text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(least):
        mixed = (mixed ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bits = max(8, int(4 * len(at)).bit_length())
    slot = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    at = at[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    ids = text[at]
    for k in range(least):
        ids = np.unique(ids * (len(codes) + 1) + codes[at + k], return_inverse=True)[1]
    again = np.bincount(ids, minlength=1)[ids] > 1
    return at[again], np.unique(ids[again], return_inverse=True)[1]


def _neighbours(codes: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` words or more, and how many they share.

    Prefix doubling over positions with a shared beginning; any other position
    counts as a letter of its own.
    """
    pos, ids = _shared(codes, lengths, least)
    m = len(pos)
    if not m:
        return (np.zeros(0, np.int64),) * 3
    slot = np.full(len(codes) + 1, -1, np.int64)
    slot[pos] = np.arange(m)
    rank = m + np.arange(len(codes) + 1)
    rank[pos] = (np.cumsum(np.bincount(ids)) - np.bincount(ids))[ids]
    levels = [rank[pos].astype(np.int32)]
    active, step = np.arange(m), 1
    while len(active):
        high, low = rank[pos[active]], rank[pos[active] + step]
        order = np.lexsort((low, high))
        active, high, low = active[order], high[order], low[order]
        index = np.arange(len(active))
        new_high = np.r_[True, high[1:] != high[:-1]]
        new = new_high | np.r_[True, low[1:] != low[:-1]]
        begin = np.maximum.accumulate(np.where(new, index, 0))
        rank[pos[active]] = high + begin - np.maximum.accumulate(np.where(new_high, index, 0))
        levels.append(rank[pos].astype(np.int32))
        single = new & np.r_[new[1:], True]
        active = active[~single]
        step *= 2
    suffix = np.empty(m, np.int64)
    suffix[rank[pos]] = np.arange(m)
    together = levels[0][suffix[1:]] == levels[0][suffix[:-1]]
    x, y = pos[suffix[:-1][together]], pos[suffix[1:][together]]
    lcp = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = slot[x + lcp], slot[y + lcp]
        lcp += np.where((a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b]), 1 << k, 0)
    return x, y, lcp + least - 1


def _unite(x: np.ndarray, y: np.ndarray, lcp: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, ...]:
    """Kruskal over suffix neighbours: pairs that become neighbours of a class, close enough to seed a run.

    The smaller class goes into the larger one, so a position moves a
    logarithmic number of times.
    """
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    first, second, common = [], [], []
    for a, b, l in zip(x[order].tolist(), y[order].tolist(), lcp[order].tolist(), strict=True):
        while (up := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[up]
        while (up := parent.setdefault(b, b)) != b:
            parent[b] = b = parent[up]
        big, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        if 8 * len(small) < len(big) or len(small) == 1:
            for p in small:
                insort(big, p)
        else:
            big += small
            big.sort()
        places[a] = big
        # Of neighbours in the united class only those from different classes are new.
        near, at, last = l // (exponent - 1), 0, len(big) - 1
        for before, p, after in zip([-1, *small], small, [*small[1:], -1]):
            at = bisect_left(big, p, at)
            if at and (q := big[at - 1]) != before and shortest - l <= p - q <= near:
                first.append(q)
                second.append(p)
                common.append(l)
            if at < last and (q := big[at + 1]) != after and shortest - l <= q - p <= near:
                first.append(p)
                second.append(q)
                common.append(l)
    return np.array(first, np.int64), np.array(second, np.int64), np.array(common, np.int64)
