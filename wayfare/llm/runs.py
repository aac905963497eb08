"""Runs of words: every maximal stretch that repeats itself with some smallest period.

Seed and extend on diagonals. A stretch of period q and length max(12, 2q) or more agrees with itself
shifted by q words (its diagonal, lag q) over max(12 - q, q) words at least. So a diagonal of
a lag below 12 holds an equal gram of 6 words, one of a lag from k to 2k an equal gram of k words, for
k = 12, 24, 48 and on. Grams of each length are indexed per document: grams of 2k words are named
by two names of k words, and words whose gram occurs once leave the search for good.

Occurrences of one gram at most half its length apart form a chain, a repetition that a
shorter gram has found, or, with 6 words, the first two of the chain show. Other words of one chain are
never paired: their lag is a multiple of the chain's period. Words of different chains are paired as seeds if one of them heads its chain, for
a seed of two later words lies on the diagonal of the words before them. That leaves O(n) seeds per
length and no pair of all occurrences. Seeds of one lag are extended in order of place; the table of
the furthest word covered per lag passes over those within a stretch already extended. Multiples of
a smallest period give the same stretch and lose to it.

Words are runs of bytes other than space and \\t to \\r. Words are compared by 64-bit hashes within a
document. NULL and empty texts have no words and no runs; the rows of a table, repeated ones
included, are taken one by one; an empty table gives an empty one. A text is whole in one
task, with memory and time in proportion to its length (times its logarithm).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import pieces, vectorized
from wayfare.llm.words import SPACED, Words, scan, windows

LEAST = 12  # words in a run
GRAM = LEAST // 2  # the smallest overlap of a run with itself: 6 words at period 6
BLOCK = 64


def _chains(places: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by (gram, place); the number of the chain of each, and which ones head it."""
    order = np.lexsort((places, names))
    at, name = places[order], names[order]
    head = np.ones(len(at), bool)
    head[1:] = (name[1:] != name[:-1]) | (at[1:] - at[:-1] > k // 2)
    return order, np.cumsum(head), head


def _between(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with low[i] <= keys[j] < high[i], for sorted keys."""
    first, stop = np.searchsorted(keys, low), np.searchsorted(keys, high)
    n = stop - first
    i = np.repeat(np.arange(len(low)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _seeds(places: np.ndarray, names: np.ndarray, k: int, low: int, high: int, size: int):
    """Pairs (place, lag) of equal grams with low <= lag < high, one word of each heading its chain."""
    order, chain, head = _chains(places, names, k)
    at = places[order]
    _, dense = np.unique(names[order], return_inverse=True)
    span = size + 2 * high
    keys = dense.astype(np.int64) * span + high + at  # sorted, with room on both sides
    heads = np.flatnonzero(head)
    here = keys[heads]
    i, j = _between(keys, here + low, here + high)  # partners behind
    a, b = heads[i], j
    i, j = _between(keys, here - high + 1, here - low + 1)  # and before
    a, b = np.concatenate([a, j]), np.concatenate([b, heads[i]])
    apart = chain[a] != chain[b]
    a, b = a[apart], b[apart]
    if k == GRAM:  # no shorter gram has found these: a head and the next word are one period apart
        inner = heads[heads + 1 < len(at)]
        inner = inner[chain[inner] == chain[inner + 1]]
        a, b = np.concatenate([a, inner]), np.concatenate([b, inner + 1])
    return at[a], at[b] - at[a]


def _reach(words: np.ndarray, i: np.ndarray, lag: np.ndarray, step: int, bound: np.ndarray) -> np.ndarray:
    """How many words on from i, in direction `step`, agree with those `lag` further, up to `bound`."""
    count = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(bound > 0)
    block = BLOCK
    while len(open_):
        ahead = np.arange(block)
        here = i[open_, None] + step * (count[open_, None] + ahead)
        inside = count[open_, None] + ahead < bound[open_, None]
        here = np.where(inside, here, 0)
        equal = inside & (words[here] == words[np.where(inside, here + lag[open_, None], 0)])
        first = np.where(equal.all(1), block, equal.argmin(1))
        count[open_] += first
        open_ = open_[(first == block) & (count[open_] < bound[open_])]
        block = min(block * 2, max(BLOCK, (1 << 20) // max(1, len(open_))))
    return count


def _extended(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, at: np.ndarray, lag: np.ndarray, k: int):
    """(start, end, lag) of the stretches around the seeds; begin and stop are each word's document."""
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)  # grams of one lag that touch are one stretch
    fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] - at[:-1] > k)
    at, lag = at[fresh], lag[fresh]
    lags, group = np.unique(lag, return_inverse=True)
    furthest = np.full(len(lags), -1, np.int64)
    found = []
    while len(at):
        first = np.ones(len(at), bool)
        first[1:] = group[1:] != group[:-1]
        i, q = at[first], lag[first]
        right = _reach(words, i + k, q, 1, stop[i] - (i + k) - q)
        left = _reach(words, i - 1, q, -1, i - begin[i])
        furthest[group[first]] = i + k + right
        found.append((i - left, i + k + right + q, q))
        rest = ~first & (at >= furthest[group])
        at, lag, group = at[rest], lag[rest], group[rest]
    return [np.concatenate(c) for c in zip(*found)]


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, as places among all words, sorted by start and period."""
    none = np.zeros(0, np.int64)
    values, rows, n = words.hashes, words.rows, len(words.hashes)
    if n < LEAST:
        return none, none, none
    borders = np.concatenate([[0], np.cumsum(words.counts)])
    begin, stop = borders[rows], borders[rows + 1]
    places, grams = windows(words, GRAM)
    grams = grams + rows[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # of one document each
    k, low, high = GRAM, 1, 2 * GRAM
    found = []
    while len(places):
        _, names, counts = np.unique(grams, return_inverse=True, return_counts=True)
        again = counts[names] > 1
        places, names = places[again], names[again]
        if not len(places):
            break
        found.append(_extended(values, begin, stop, *_seeds(places, names, k, low, high, n), k))
        name_at = np.full(n + 1, -1, np.int64)
        name_at[places] = names
        second = name_at[np.minimum(places + k, n)]
        whole = (second >= 0) & (places + 2 * k <= stop[places])
        grams = names[whole] * np.int64(n + 1) + second[whole]
        places = places[whole]
        k, low, high = 2 * k, 2 * k, 4 * k
    if not found:
        return none, none, none
    start, end, lag = (np.concatenate(c) for c in zip(*found))
    long = end - start >= np.maximum(LEAST, 2 * lag)
    start, end, lag = start[long], end[long], lag[long]
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[own], end[own], lag[own]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def _kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) == 0


def _joined(data: np.ndarray, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every row, joined by one space."""
    spaced = np.concatenate([data, [32]]).astype(np.uint8)
    at = np.flatnonzero(kept)
    lengths = words.ends[at] - words.starts[at] + 1
    last = np.ones(len(at), bool)
    last[:-1] = words.rows[at[1:]] != words.rows[at[:-1]]
    lengths = lengths - last  # no space behind a row's last word
    total = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(total[-1]) + np.repeat(words.starts[at] - total[:-1], lengths)
    space = (total[1:] - 1)[~last]
    source[space] = len(data)
    per_row = np.zeros(len(words.counts), np.int64)
    np.add.at(per_row, words.rows[at], lengths)
    borders = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(per_row), pa.py_buffer(borders.tobytes()),
                                            pa.py_buffer(spaced[source].tobytes())).cast(pa.string())


@vectorized("struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
def find_runs(text: pa.Array) -> pa.Array:
    """Words, runs (by start, then period) and the text without what repeats, of every text."""
    parts = []
    for data, ends in pieces(text):
        words = scan(data, ends, SPACED)
        start, end, period = runs_of(words)
        row = words.rows[start] if len(start) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(words.counts)])[row]
        each = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in (start - first, end - start, period)], ["start", "length", "period"])
        borders = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words.counts)))]).astype(np.int32)
        kept = _kept(len(words.starts), start, end, period)
        parts.append(pa.StructArray.from_arrays(
            [pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(borders), each),
             _joined(data, words, kept)], ["n_words", "runs", "collapsed"]))
    if not parts:
        each = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        return pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(each)),
                                       ("collapsed", pa.string())]))
    return pa.concat_arrays(parts)


def with_runs(docs: DataFrame, text_col: str = "text", found: str = "found") -> DataFrame:
    """`docs` with a struct `found`: n_words, runs (start, length, period) and the collapsed text.

    A column of that name is replaced; all others are kept as they are.
    """
    return docs.withColumn(found, find_runs(F.col(text_col)))


def longest(runs) -> F.Column:
    """The longest of an array of runs; ties go to the smallest start, then the smallest period."""
    best = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period"))
