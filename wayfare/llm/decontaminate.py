"""Benchmark decontamination: texts are scanned for word windows of the test items.

The normalised windows of the benchmark go to every task as a hash set. Each document's windows are
looked up, hits are verified word by word, and hit spans or whole documents can be removed.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item shorter than
a window is one window. NULL and empty texts and items have no words. Items may repeat; an item
without an id hits but is not listed. A document may hit many items; each counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import dropped, lists, pieces, utf8, vectorized, written
from wayfare.llm.words import ALPHANUMERIC, scan, windows

WINDOW = 10
# of item texts in one scan; a larger benchmark takes more scans. A window and a word
# cost 12 bytes each, so a worker holds at most 13 bytes per byte of text (words of one letter), usually 5.
BROADCAST_BYTES = 16 << 20
KNOWN_WINDOWS = 4096  # verified windows that a worker remembers
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STATE = "n_words long, from_word array<int>, to_word array<int>, items array<string>, rest string"


class WindowSet:
    """The windows of items as arrays: sorted hashes to look up, places of words to verify, and owners."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        data, borders = utf8(pa.array([text for _, text in items], pa.string()))
        words = scan(data, borders, ALPHANUMERIC)
        self.low = _LOWER[data]
        self.starts, self.ends = words.starts.astype(np.int32), words.ends.astype(np.int32)
        self.names = [name for name, _ in items]
        self.rows, self.last = words.rows.astype(np.int32), {}
        self.hashes, self.first, self.maps = {}, {}, {}
        for length in range(1, size + 1):
            first, hashes = windows(words, length)
            if length < size:  # a shorter window is a whole item
                whole = words.counts[words.rows[first]] == length
                first, hashes = first[whole], hashes[whole]
            if not len(first):
                continue
            order = np.argsort(hashes, kind="stable")
            self.hashes[length], self.first[length] = hashes[order], first[order].astype(np.int32)
            self.maps[length] = np.zeros(1 << 20, bool)
            self.maps[length][(hashes >> np.uint64(44)).astype(np.int64)] = True

    def _owners(self, length: int, text: bytes, lo: int, hi: int) -> frozenset[str] | None:
        """Named items with the window `text` among the places lo to hi of one hash; None if none has it."""
        if (length, text) not in self.last:
            same = [at for at in self.first[length][lo:hi].tolist() if plain(self.low, self, at, length) == text]
            if len(self.last) >= KNOWN_WINDOWS:
                self.last.clear()
            names = {self.names[self.rows[at]] for at in same} - {None}
            self.last[length, text] = frozenset(names) if same else None
        return self.last[length, text]

    def hits(self, low: np.ndarray, words):
        """(first word, length, owners) of each verified occurrence."""
        for length, keys in self.hashes.items():
            first, hashes = windows(words, length)
            some = np.flatnonzero(self.maps[length][(hashes >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(keys, hashes[some])
            hi = np.searchsorted(keys, hashes[some], "right")
            met = hi > lo
            for at, a, b in zip(first[some[met]].tolist(), lo[met].tolist(), hi[met].tolist()):
                owners = self._owners(length, plain(low, words, at, length), a, b)
                if owners is not None:
                    yield at, length, owners


def plain(low: np.ndarray, words, at: int, length: int) -> bytes:
    """The words from `at` on, lower-cased, with one space between."""
    return b" ".join(low[words.starts[i]:words.ends[i]].tobytes() for i in range(at, at + length))


def _runs(flags: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of runs of set flags that stay within a row."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = rows[1:] == rows[:-1]
    before = np.concatenate([[False], flags[:-1] & same])
    after = np.concatenate([flags[1:] & same, [False]])
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def scanner(window_set):
    """A column function (text, what earlier scans found) -> what is found now, all together."""

    @vectorized(_STATE)
    def find(text: pa.Array, earlier: pa.Array) -> pa.Array:
        known, out, row0 = window_set.value, [], 0
        past = earlier.to_pylist() if earlier.null_count < len(earlier) else None
        for data, borders in pieces(text):
            n = len(borders) - 1
            words = scan(data, borders, ALPHANUMERIC)
            low = _LOWER[data]
            begin = np.concatenate([[0], np.cumsum(words.counts)])
            hit = np.zeros(len(words.starts), bool)
            items: list[set[str]] = [set() for _ in range(n)]
            for at, length, owners in known.hits(low, words):
                hit[at:at + length] = True
                items[words.rows[at]] |= owners
            if past:
                for i, state in enumerate(past[row0:row0 + n]):
                    for a, b in zip(state["from_word"], state["to_word"]):
                        hit[begin[i] + a:begin[i] + b] = True
                    items[i] |= set(state["items"])
            first, last = _runs(hit, words.rows)
            rows = words.rows[first]
            counts = np.bincount(rows, minlength=n)
            keep = np.ones(len(data), bool)
            for a, b in zip(words.starts[first].tolist(), words.ends[last - 1].tolist()):
                keep[a:b] = False
            rest = [data[a:b][keep[a:b]].tobytes().decode() if hits else None
                    for a, b, hits in zip(borders[:-1].tolist(), borders[1:].tolist(), counts.tolist())]
            out.append((words.counts, first - begin[rows], last - begin[rows], counts,
                        [sorted(x) for x in items], rest))
            row0 += n
        join = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(join(0), pa.int64()), lists(join(1), join(3), pa.int32()),
             lists(join(2), join(3), pa.int32()),
             pa.array([x for part in out for x in part[4]], pa.list_(pa.string())),
             pa.array([x for part in out for x in part[5]], pa.string())],
            ["n_words", "from_word", "to_word", "items", "rest"])

    return find


def found_windows(docs: DataFrame, items: DataFrame, text_col: str = "text", size: int = WINDOW,
                  item_id: str = "item_id", item_text: str = "text", found: str = "found",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with a struct `found`: n_words, runs of hit words, the items that occur, and, if any
    does, the rest of the text without the bytes from the first to the last word of each run.

    The items are measured first. Up to `limit` bytes travel in one broadcast and the documents
    are scanned without any shuffle; a larger benchmark is divided and scanned part by part, each
    part adding to what the parts before it found.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-max(total, 1) // limit)
    docs = docs.withColumn(found, F.lit(None).cast(f"struct<{_STATE.replace(' ', ':').replace(',:', ',')}>"))
    last = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        windows_of = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in rows], size))
        docs = docs.withColumn(found, scanner(windows_of)(F.col(text_col), F.col(found)))
        if parts > 1:
            docs = written(docs, "scanned")
            if last is not None:
                dropped(last)
            last = docs
    return docs


def hit_words(found: str = "found"):
    spans = F.zip_with(f"{found}.from_word", f"{found}.to_word", lambda a, b: (b - a).cast("long"))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  drop_share: float = 0.5, **options) -> DataFrame:
    """Documents without the benchmark: hit spans are cut out, and a document of which at least
    `drop_share` of the words are hit goes as a whole. Columns stay; clean rows are untouched."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("body"))
    scanned = found_windows(packed, items, "body", **options)
    n = hit_words()
    kept = scanned.filter((n == 0) | (n < F.lit(drop_share) * F.col("found.n_words")))
    text = F.coalesce("found.rest", "body")
    return kept.select(*[text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c)
                         for c in docs.columns])
