"""Token ids of many texts with a public byte-level tokenizer, its work on repeated words done once.

The tokenizer splits a text into words before it merges bytes, so equal words have equal ids. Here
numpy finds the words of a whole batch, the tokenizer library encodes those not met before, and
the ids are gathered. Texts whose words are not told apart safely this way (runs of white space,
apostrophes, control and rare characters) are encoded by the library as a whole.

Words are known by 64-bit hashes; a worker keeps at most KNOWN of them.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from wayfare.llm.common import mixed, pieces, random_words
from wayfare.llm.words import powers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

KNOWN = 800_000
_JOINED = 512
_BYTES = random_words(256, 23)
ODD, LETTER, NUMBER, MARK, SPACE, LINE = range(6)


@cache
def _classes() -> np.ndarray:
    """The kind of each character of the basic plane, by its Unicode category."""
    kinds = {"L": LETTER, "N": NUMBER, "P": MARK, "S": MARK, "M": MARK}
    found = np.array([kinds.get(unicodedata.category(chr(c))[0], ODD) for c in range(1 << 16)], np.uint8)
    found[ord("'")] = ODD
    found[ord(" ")], found[ord("\n")] = SPACE, LINE
    return found


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    table = _classes()
    kinds = np.concatenate([table[:128], np.full(128, ODD, np.uint8)])[data]
    at = np.flatnonzero(data >= 0xC0)
    at = at[data[at] < 0xF0]
    if not len(at):
        return kinds
    wide = data[at] >= 0xE0
    one = data[at].astype(np.int64)
    two = (data[at + 1] & 0x3F).astype(np.int64)
    three = (data[np.minimum(at + 2, len(data) - 1)] & 0x3F).astype(np.int64)
    code = np.where(wide, ((one & 15) << 12) | (two << 6) | three, ((one & 31) << 6) | two)
    kind = table[code]
    kinds[at], kinds[at + 1] = kind, kind
    kinds[at[wide] + 2] = kind[wide]
    return kinds


def _split(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and which rows must be encoded as a whole."""
    kinds = _kinds(data)
    blank = kinds >= SPACE
    first = np.zeros(len(data) + 1, bool)
    first[borders] = True
    last = first[1:]
    first = first[:-1]
    wrong = kinds == ODD
    wrong[1:] |= blank[1:] & blank[:-1] & ~first[1:]
    wrong |= last & (kinds == SPACE)
    before = np.concatenate([[LINE], kinds[:-1]])
    start = first | blank | (before == LINE) | ((kinds != before) & (before != SPACE))
    total = np.concatenate([[0], np.cumsum(wrong)])
    return np.flatnonzero(start), total[borders[1:]] > total[borders[:-1]]


class Encoder:
    """Texts to ids. Names of special tokens in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for name, i in names.items() if name[0] == "Ġ"]] = True
        self.line = self.whole("\n")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids).tobytes(), np.uint32)

    def _joined(self, words: list[str], between: str) -> list[np.ndarray]:
        """Ids of words that each begin with a space, or of words set apart by a line's end."""
        out = []
        for i in range(0, len(words), _JOINED):
            some = words[i:i + _JOINED]
            ids = self.whole(between + between.join(some))
            if between:
                at = np.flatnonzero(ids == self.line[0])
                found = [ids[a + 1:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]
            else:
                at = np.flatnonzero(self.opens[ids]).tolist()
                found = [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)])]
            if len(found) != len(some):  # never for words as split here
                found = [self.whole(word) for word in some]
            out += found
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        spaced = np.array([w[0] == " " for w in words])
        alone = np.array([w == "\n" for w in words])
        ids: list = [self.line] * len(words)
        for mask, between in ((spaced, ""), (~spaced & ~alone, "\n")):
            at = np.flatnonzero(mask).tolist()
            for i, found in zip(at, self._joined([words[i] for i in at], between)):
                ids[i] = found
        counts = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        joined = np.concatenate([self.keys, keys])
        order = np.argsort(joined, kind="stable")
        self.keys = joined[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def rows(self, data: np.ndarray, borders: np.ndarray):
        """The ids of each row, as arrays."""
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(borders) - 1)
        starts, odd = _split(data, borders)
        ends = np.concatenate([starts[1:], [len(data)]])
        place = np.arange(len(data)) - np.repeat(starts, ends - starts)
        hashes = np.add.reduceat(_BYTES[data] * powers(int(place.max()) + 1)[place], starts)
        hashes = mixed(hashes ^ (ends - starts).astype(np.uint64))
        row = np.searchsorted(borders, starts, "right") - 1
        safe = ~odd[row]
        keys, first, back = np.unique(hashes[safe], return_index=True, return_inverse=True)
        new = np.flatnonzero(self._find(keys) < 0)
        if len(self.keys) + len(new) > KNOWN:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            at = np.flatnonzero(safe)[first[new]]
            buffer = data.tobytes()
            self._learn(keys[new], [buffer[a:b].decode() for a, b in
                                    zip(starts[at].tolist(), ends[at].tolist())])
        known = self._find(keys)[back] if len(keys) else np.zeros(0, np.int64)
        counts = np.zeros(len(starts), np.int64)
        counts[safe] = self.counts[known]
        total = np.concatenate([[0], np.cumsum(counts)])
        shift = np.zeros(len(starts), np.int64)
        shift[safe] = self.starts[known]
        shift -= total[:-1]
        ids = self.pool[np.arange(total[-1]) + np.repeat(shift, counts)]
        edges = total[np.searchsorted(starts, borders)]
        out = []
        for i in range(len(borders) - 1):
            if odd[i]:
                out.append(self.whole(data[borders[i]:borders[i + 1]].tobytes().decode()))
            else:
                out.append(ids[edges[i]:edges[i + 1]])
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(texts: pa.Array, path: str):
    """The ids of each text as unsigned 32-bit numbers; NULL is empty."""
    for data, borders in pieces(texts):
        yield from encoder(path).rows(data, borders)
