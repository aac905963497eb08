"""Simple-8b: whole numbers in 64-bit words. A selector says how many share the word.

Numbers are coded in blocks of BLOCK with an offset each, so many blocks are coded and decoded at
once. A number of more than 60 bits is an escape: its word holds a place in a list of exceptions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# selector 0 is the escape; selector i > 0 packs COUNTS[i] numbers of WIDTHS[i] bits
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 60
_MASK = np.uint64((1 << 60) - 1)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each number, at least 1."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.maximum(np.frexp(low)[1], 1)).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block begins, and exceptions."""
    values = values.astype(np.uint64)
    blocks = -(-len(values) // BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:len(values)] = values
    grid = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = len(values) - (blocks - 1) * BLOCK
    bits = np.zeros((blocks, BLOCK + 2 * _PAD), np.uint8)
    bits[:, :BLOCK + _PAD] = bit_lengths(grid)
    bits[:, BLOCK:] = 0
    if blocks:
        bits[-1, sizes[-1]:] = 0
    # the selector that packs most, at every position; a window's widest number from two shorter ones
    chosen = np.full((blocks, BLOCK), 14, np.uint8)
    widest, width = bits, 1
    for selector in range(13, 0, -1):
        count = int(COUNTS[selector])
        n = widest.shape[1] - (count - width)
        widest = np.maximum(widest[:, :n], widest[:, count - width:count - width + n])
        width = count
        chosen[widest[:, :BLOCK] <= WIDTHS[selector]] = selector
    chosen[bits[:, :BLOCK] > 60] = 0
    at, number = np.zeros(blocks, np.int64), np.arange(blocks)
    step, block, place, pick = [], [], [], []
    turn = 0
    while len(number):
        selector = chosen[number, at]
        step.append(np.full(len(number), turn))
        block.append(number)
        place.append(at)
        pick.append(selector)
        at = at + COUNTS[selector]
        more = at < sizes[number]
        number, at, turn = number[more], at[more], turn + 1
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    step, block, place, pick = (np.concatenate(x) for x in (step, block, place, pick))
    order = np.lexsort((step, block))
    block, place, pick = block[order], place[order], pick[order]
    words = pick.astype(np.uint64) << np.uint64(60)
    cells = grid.ravel()
    start = block * (BLOCK + _PAD) + place
    exceptions = cells[start[pick == 0]]
    words[pick == 0] |= np.arange(len(exceptions), dtype=np.uint64)
    for selector in range(1, 15):
        at = np.flatnonzero(pick == selector)
        for j in range(int(COUNTS[selector])):
            words[at] |= cells[start[at] + j] << np.uint64(j * WIDTHS[selector])
    return words, np.searchsorted(block, np.arange(blocks)), exceptions


def decode(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The `n` numbers again; blocks are found by their offsets, words decoded by selector."""
    blocks = len(offsets)
    pick = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[pick]
    total = np.cumsum(counts) - counts
    block = np.repeat(np.arange(blocks), np.diff(np.concatenate([offsets, [len(words)]])))
    cells = np.zeros(blocks * (BLOCK + _PAD), np.uint64)
    start = block * (BLOCK + _PAD) + total - total[offsets][block] if len(words) else total
    body = words & _MASK
    escaped = pick == 0
    cells[start[escaped]] = exceptions[body[escaped].astype(np.int64)]
    for selector in range(1, 15):
        at = np.flatnonzero(pick == selector)
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        for j in range(int(COUNTS[selector])):
            cells[start[at] + j] = (body[at] >> np.uint64(j * WIDTHS[selector])) & mask
    return cells.reshape(blocks, BLOCK + _PAD)[:, :BLOCK].ravel()[:n]
