"""Words of many texts at once: borders, rows and 64-bit hashes, as numpy arrays over UTF-8.

Separators are ASCII in every definition used here, so bytes decide exactly as characters would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wayfare.llm.common import mixed, random_words

_BYTES = random_words(256, 11)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first `n` powers of a fixed odd number, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1 << 12), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers[:n]


def separated_by(separators: bytes, lower: bool = False) -> np.ndarray:
    """What each byte adds to a hash: 0 for separators; A-Z counts as a-z if `lower`."""
    values = _BYTES.copy()
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


SPACES = bytes([32, *range(9, 14)])
SPACED = separated_by(SPACES)
ALPHANUMERIC = separated_by(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]).translate(None, bytes(range(65, 91))),
    lower=True,
)
LINES = separated_by(b"\n")


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  # per row


def scan(data: np.ndarray, borders: np.ndarray, values: np.ndarray) -> Words:
    """The maximal runs of bytes that are no separators, within each row."""
    rows = len(borders) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(rows, np.int64))
    worth = values[data]
    inside = worth != 0
    first = np.zeros(len(data) + 1, bool)
    first[borders] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    row_of = np.searchsorted(borders, starts, "right") - 1
    counts = np.bincount(row_of, minlength=rows)
    if not len(starts):
        return Words(starts, ends, row_of, np.zeros(0, np.uint64), counts)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]),
                       np.diff(np.concatenate([[0], starts, [len(data)]])))
    place[~inside] = 0
    worth *= powers(int(place.max()) + 1)[place]
    hashes = mixed(np.add.reduceat(worth, starts) ^ (ends - starts).astype(np.uint64))
    return Words(starts, ends, row_of, hashes, counts)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of `k` words within a row, and the hashes of the runs."""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    step = powers(k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words.hashes[j:j + n] * step[j + 1]
    first = np.flatnonzero(words.rows[:n] == words.rows[k - 1:])
    return first, mixed(total[first])
