"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

A suffix is S-type if it is smaller than the one after it, else L-type; a leftmost S-type suffix
(LMS) follows an L-type one. The order of the LMS suffixes induces the order of all others in two
linear scans over buckets of the first symbol. A bucket is scanned as a whole: the suffixes before
its members are dealt to their buckets by one stable counting sort.

LMS suffixes are ordered by first inducing the order of the LMS substrings, naming them, and sorting
the string of names. That string has many symbols and short buckets, so it is sorted by pairing
names again and again (pairs of pairs and so on), until names are unique or reach over `depth`
symbols: the order is exact up to `depth`, and nothing here looks further.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S-type. The last symbol must be the only smallest one."""
    n = len(text)
    small = np.ones(n, bool)
    if n > 1:
        differs = text[1:] != text[:-1]
        at = np.where(differs, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        small[:-1] = (text[1:] > text[:-1])[at]
    return small


def _deal(text, kind, wanted, members, fill, order_of, step, sigma):
    """Put the suffixes before `members`, if of the wanted type, at the fronts of their buckets."""
    before = members[members > 0] - 1
    before = before[kind[before] == wanted]
    if not len(before):
        return
    symbols = text[before]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    counts = np.bincount(symbols, minlength=sigma)
    rank = np.arange(len(before)) - (np.cumsum(counts) - counts)[symbols]
    if step > 0:
        order_of[fill[symbols] + rank] = before[order]
        fill += counts
    else:
        order_of[fill[symbols] - 1 - rank] = before[order]
        fill -= counts


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes from LMS suffixes given in order (within first symbols)."""
    counts = np.bincount(text, minlength=sigma)
    large = np.bincount(text[~small], minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    order_of = np.full(len(text), -1, np.int32)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    seed_ends = np.cumsum(np.bincount(text[lms], minlength=sigma))
    used = np.flatnonzero(counts).tolist()
    fill = starts.copy()
    for c in used:
        done = starts[c]
        while done < fill[c]:  # members may add members before themselves
            upto = fill[c]
            _deal(text, small, False, order_of[done:upto], fill, order_of, 1, sigma)
            done = upto
        own = seeds[seed_ends[c - 1] if c else 0:seed_ends[c]]
        _deal(text, small, False, own, fill, order_of, 1, sigma)
    fill = ends.copy()
    last = int(text[-1])
    fill[last] -= 1
    order_of[fill[last]] = len(text) - 1
    for c in reversed(used):
        done = ends[c]
        while fill[c] < done:
            upto = fill[c]
            _deal(text, small, True, order_of[upto:done][::-1], fill, order_of, -1, sigma)
            done = upto
        own = order_of[starts[c]:starts[c] + large[c]][::-1]
        _deal(text, small, True, own, fill, order_of, -1, sigma)
    return order_of


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at `a` and `b` share, up to `most` each. Symbols are uint16."""
    padded = np.concatenate([text.astype("<u2"), np.zeros(8, "<u2")])
    four = np.ndarray((len(text) + 4,), "<u8", buffer=padded, strides=(2,))
    shared = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    end = len(text)
    while len(active):
        x = np.minimum(a[active] + shared[active], end)
        y = np.minimum(b[active] + shared[active], end)
        differ = four[x] ^ four[y]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))
        exact = np.frexp(low.astype(np.float64))[1] - 1  # place of the lowest differing bit
        shared[active] += np.where(same, 4, exact // 16)
        active = active[same & (shared[active] < most[active])]
    return np.minimum(shared, most)


def suffix_array(text: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, exact up to `depth` symbols.

    `text` holds symbols below `sigma` and ends with a symbol smaller than all others.
    """
    text = text.astype(np.uint16)
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = types(text)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(leftmost)
    if len(lms) > 1:
        first = induce(text, small, lms, sigma)
        ordered = first[leftmost[first]].astype(np.int64)
        place = np.zeros(n, np.int64)
        place[lms] = np.arange(len(lms))
        lengths = np.diff(np.concatenate([lms, [n - 1]])) + 1
        size = lengths[place[ordered]]
        alike = size[1:] == size[:-1]
        shared = common_prefixes(text, ordered[1:], ordered[:-1], np.where(alike, size[1:], 0))
        fresh = ~(alike & (shared >= size[1:]))
        names = np.zeros(len(lms), np.int64)
        names[place[ordered]] = np.concatenate([[1], 1 + np.cumsum(fresh)])
        lms = lms[_order_of_names(names, depth)]
    return induce(text, small, lms, sigma)


def _order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names, by pairing; a name spans 2 symbols or more."""
    reach = 1
    order = np.argsort(names, kind="stable")
    while names.max() < len(names) and 2 * (reach - 1) < depth:
        after = np.zeros(len(names), np.int64)
        after[:-reach] = names[reach:]
        pairs = names << 32 | after
        order = np.argsort(pairs, kind="stable")
        ordered = pairs[order]
        names = np.empty_like(names)
        names[order] = 1 + np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        reach *= 2
    return order


def permuted_prefixes(text: np.ndarray, order_of: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per position the suffix just smaller (-1: none) and the symbols shared with it, up to `most`.

    If the neighbours of two following positions follow each other too, the later one shares one
    symbol less. Only the other positions are compared. Counts below `most` at a position that
    follows such a chain of k positions are exact below `most` - k.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order_of[1:]] = order_of[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1)
    chained[1:] &= text[:-1] == text[np.maximum(before[1:] - 1, 0)]
    chained[1:] &= (np.arange(1, n) % max(most // 2, 1)) != 0  # a chain ends well before `most`
    head = np.flatnonzero(~chained)
    shared = np.zeros(n, np.int64)
    real = head[before[head] >= 0]
    shared[real] = common_prefixes(text, real, before[real], np.full(len(real), most))
    at = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
    return before, np.maximum(shared[at] - (np.arange(n) - at), 0)


def repeated_starts(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Which `length`-byte strings of each part occur anywhere else in the parts, by start."""
    text = np.ones(sum(map(len, parts)) + len(parts) + 1, np.uint16)
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        text[at:at + len(part)] = part
        text[at:at + len(part)] += 2
        at += len(part) + 1  # 1 sets parts apart
    text[-1] = 0
    order_of = suffix_array(text, 258, length)
    before, shared = permuted_prefixes(text, order_of, 4 * length)
    alike = np.flatnonzero(shared >= length)
    found = np.zeros(len(text), bool)
    found[alike] = True
    found[before[alike]] = True
    return [found[a:a + max(len(p) - length + 1, 0)] for a, p in zip(starts, parts)]
