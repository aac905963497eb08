"""Removal of repeated byte strings, found with suffix arrays over shards of the corpus.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
document or another. The suffix arrays (see suffix_array.py) decide that. So that every two equal
strings meet in one shard, each string is known by its anchor: of its 8-byte grams the one with
the smallest hash, the leftmost if equal. Equal strings have equal anchors, and neighbouring strings
of a document mostly share one, so a run of strings with one anchor travels as one segment.

1. Runs are cut in two by the place of the anchor, which leaves a core of over 100 bytes that all
   strings of the run contain. Cores are counted; a run whose core occurs once repeats nowhere.
2. Runs of one core that are equal as a whole are one kind. The only kind of a core repeats as a whole
   or not at all. The segments of other kinds are cut from the texts, once a kind.
3. Segments are dealt to shards by core. Each shard's suffix array and permuted common prefixes
   tell which strings start twice; a kind that occurs twice repeats as a whole.
4. A core with more different segments than one shard should hold (a common line amid different
   texts) is split: its runs are cut into ever shorter ones with longer cores, and counted again.
   At one string per run the core is the string itself, so this ends and is exact, too.

Documents are UTF-8 bytes; NULL is empty. Texts below `length` bytes never match. Repeated rows are
occurrences of their own. Keys are 64-bit hashes of cores, and 128 bits for kinds of runs
(core and whole run) and for rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import (
    dropped,
    give_back,
    lists,
    mixed,
    pieces,
    random_words,
    row_key,
    utf8,
    vectorized,
    written,
)
from wayfare.llm.suffix_array import repeated_starts
from wayfare.llm.words import powers

LENGTH = 200
GRAM = 8
SHARD_BYTES = 1 << 20
CORE_BYTES = 1 << 18  # of different segments with one core that a shard may get
WIDTHS = (48, 24, 12, 6, 3, 1)  # strings per run when a crowded core is split
_BYTES = random_words(256, 5)
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
_inverse_powers = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        steps = np.full(max(n, 1 << 12), _INVERSE, np.uint64)
        steps[0] = 1
        _inverse_powers = np.cumprod(steps)
    return _inverse_powers[:n]


class Hashes:
    """Hashes of any stretch of some bytes, whatever its place."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(len(data)), out=self.total[1:])
        self.inverse = _inverses(len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray, kind) -> np.ndarray:
        stretch = (self.total[end] - self.total[begin]) * self.inverse[begin]
        return mixed(stretch ^ mixed(np.asarray(kind, np.uint64) + np.uint64(1))).view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have, least = 1, values
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:len(values) - width + 1], least[width - have:]) if have < width else least


def runs(data: np.ndarray, borders: np.ndarray, length: int):
    """Runs of strings with one anchor: row, core hash, hash of the whole run, and the places of its anchor,
    first and last string."""
    sizes = np.diff(borders)
    strings = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not strings.any():
        return none, none, none, none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))
    ranked = mixed(grams.copy())
    ranked &= np.uint64(0xFFFFFFFF00000000)
    ranked |= np.arange(len(data), dtype=np.uint64)
    best = _least(ranked, length - GRAM + 1)
    total = np.cumsum(strings)
    begin = np.arange(total[-1]) + np.repeat(borders[:-1] - (total - strings), strings)
    row = np.repeat(np.arange(len(sizes)), strings)
    anchor = (best[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    half = (length - GRAM) // 2
    late = anchor - begin > half
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (late[1:] != late[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begin)) - 1
    anchor, late, row = anchor[first], late[first], row[first]
    # what all strings have in common whose anchor lies at most / more than `half` bytes in
    core_from = np.where(late, anchor - half - 1, anchor)
    core_to = np.where(late, anchor + GRAM, anchor - half + length)
    hashes = Hashes(data)
    core = hashes.of(core_from, core_to, late)
    whole = hashes.of(begin[first], begin[last] + length, anchor - begin[first])
    return row, core, whole, anchor, begin[first], begin[last]


def run_column(length: int):
    """Runs of a text as arrays: core, whole run, and in steps that fit 16 bits the first string (from that
    of the run before, in `step` and `far` times 2^15), the anchor and the last string from the first."""
    @vectorized("struct<core:array<bigint>,h:array<bigint>,step:array<smallint>,far:array<smallint>,"
                "anchor:array<smallint>,last:array<smallint>>")
    def find(text: pa.Array) -> pa.Array:
        parts = []
        for data, borders in pieces(text):
            row, core, whole, anchor, first, last = runs(data, borders, length)
            counts = np.bincount(row, minlength=len(borders) - 1)
            step = np.diff(first, prepend=0)
            fresh = np.diff(row, prepend=-1) != 0
            step[fresh] = (first - borders[row])[fresh]
            parts.append((core, whole, step & 0x7FFF, step >> 15, anchor - first, last - first, counts))
        if not parts:
            parts = [(np.zeros(0, np.int64),) * 7]
        *columns, counts = (np.concatenate(x) for x in zip(*parts))
        kinds = [pa.int64()] * 2 + [pa.int16()] * 4
        return pa.StructArray.from_arrays(
            [lists(c.astype(k.to_pandas_dtype()), counts, k) for c, k in zip(columns, kinds)],
            ["core", "h", "step", "far", "anchor", "last"])

    return find


def firsts(length: int):
    @vectorized("array<struct<core:bigint,h:bigint,first:int,anchor:smallint,last:smallint>>")
    def place(found: pa.Array) -> pa.Array:
        """The arrays of `run_column` as rows, the first strings counted from the start of the text."""
        core = found.field("core")
        borders = core.offsets.to_numpy().astype(np.int64)
        flat = {c: found.field(c).flatten().to_numpy() for c in ("core", "h", "step", "far", "anchor", "last")}
        total = np.cumsum(flat["step"].astype(np.int64) + (flat["far"].astype(np.int64) << 15))
        counts = np.diff(borders)
        base = np.concatenate([[0], total])[borders[:-1] - borders[0]]
        rows = pa.StructArray.from_arrays(
            [pa.array(flat["core"]), pa.array(flat["h"]), pa.array((total - np.repeat(base, counts)).astype(np.int32)),
             pa.array(flat["anchor"]), pa.array(flat["last"])], ["core", "h", "first", "anchor", "last"])
        return pa.ListArray.from_arrays(pa.array((borders - borders[0]).astype(np.int32)), rows)

    return place


@vectorized("binary")
def squeezed(text: pa.Array) -> pa.Array:
    """Texts packed for a shuffle; they are only unpacked where Python works on them anyway."""
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else pack.compress(t.encode()) for t in text.to_pylist()],
                    pa.binary())


def _unpacked(data: bytes | None) -> bytes:
    return b"" if data is None else zstandard.ZstdDecompressor().decompress(data)


def segment_column(length: int):
    @vectorized("array<struct<core:bigint,h:bigint,n:bigint,anchor:smallint,seg:binary>>")
    def cut(packed: pa.Array, chosen: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(packed.to_pylist(), chosen.to_pylist()):
            data = _unpacked(value)
            out.append([{"core": s["core"], "h": s["h"], "n": s["n"], "anchor": s["anchor"],
                         "seg": data[s["first"]:s["first"] + s["last"] + length]} for s in spans])
        return pa.array(out, pa.list_(pa.struct([("core", pa.int64()), ("h", pa.int64()), ("n", pa.int64()),
                                                 ("anchor", pa.int16()), ("seg", pa.binary())])))

    return cut


def _stretches(flags: np.ndarray) -> list[dict]:
    """Runs of set flags, first and last."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


_HITS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = pa.schema([("core", pa.int64()), ("h", pa.int64()), ("hits", _HITS)])
_FOUND_DDL = "core long, h long, hits array<struct<a:int,b:int>>"


def shard_decision(length: int):
    """One shard: which strings of its segments start twice, by its suffix array."""
    def decide(shard: pa.Table) -> pa.Table:
        parts = [np.frombuffer(s.as_py(), np.uint8) for s in shard.column("seg")]
        found = repeated_starts(parts, length)
        twice = shard.column("n").to_numpy() > 1
        hits = [_stretches(f | t) for f, t in zip(found, twice)]
        some = np.flatnonzero([bool(h) for h in hits])
        give_back()
        keep = shard.select(["core", "h"]).take(pa.array(some))
        return pa.table([*keep.columns, pa.array([hits[i] for i in some], _HITS)], schema=_FOUND)

    return decide


def _split(length: int, width: int):
    """Shorter runs of a segment: those of its strings with `width` neighbouring anchor places."""
    @vectorized("array<struct<core2:bigint,h2:bigint,a:int,b:int>>")
    def split(seg: pa.Array, anchor: pa.Array, ranges: pa.Array) -> pa.Array:
        data, borders = utf8(seg)
        hashes = Hashes(data)
        out = []
        for i, (p, spans) in enumerate(zip(anchor.to_pylist(), ranges.to_pylist())):
            own = []
            for span in spans:
                at = np.arange(span["a"], span["b"] + 1)
                part = (p - at) // width
                firsts = np.flatnonzero(np.diff(part, prepend=part[0] + 1))
                lasts = np.append(firsts[1:], len(at)) - 1
                begin, end, part = at[firsts], at[lasts], part[firsts]
                base = borders[i]
                core = hashes.of(base + p - part * width, base + p - (part + 1) * width + 1 + length,
                                 part * 256 + width)
                whole = hashes.of(base + begin, base + end + length, part * 256 + width)
                own += [{"core2": c, "h2": h, "a": x, "b": y} for c, h, x, y in
                        zip(core.tolist(), whole.tolist(), begin.tolist(), end.tolist())]
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("core2", pa.int64()), ("h2", pa.int64()),
                                                 ("a", pa.int32()), ("b", pa.int32())])))

    return split


def _crowded(segments: DataFrame, length: int) -> DataFrame:
    """The same decision for segments of crowded cores, run by run. No group of rows meets: every level
    only counts hashes, and what occurs once is dropped. Bytes are read once a level and never written."""
    key = ["core", "h"]
    everything = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("seg") - length).alias("b")))
    pending = segments.select(*key, "n", everything.alias("ranges"))
    found = None
    for width in WIDTHS:
        parts = segments.select(*key, "seg", "anchor").join(pending, key).select(
            *key, "n", F.explode(_split(length, width)("seg", "anchor", "ranges")).alias("p"))
        parts = written(parts.select(*key, "n", "p.*"), f"split{width}")
        same = written(parts.groupBy("core2", "h2").agg(F.sum("n").alias("same")), f"same{width}")
        again = parts.join(same.filter("same > 1"), ["core2", "h2"], "left_semi")
        hits = again.select(*key, F.array(F.struct("a", "b")).alias("hits"))
        found = hits if found is None else found.unionByName(hits)
        # cores with different runs go on; of equal runs one stays as the partner of the others
        mixed_cores = same.groupBy("core2").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        fields = [*key, "n", "a", "b"]
        ones = (parts.join(mixed_cores, "core2", "left_semi").groupBy("core2", "h2")
                .agg(F.min_by(F.struct(*fields), F.struct(*key, "a")).alias("one")).select("one.*"))
        pending = ones.groupBy(*key, "n").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        if width == WIDTHS[-1] or mixed_cores.isEmpty():
            return found
    return found


def _of_repeated_cores(rows: DataFrame, length: int) -> DataFrame:
    """(ka, kb, core, h, anchor, first, last) of every run whose core occurs twice; places as in `run_column`,
    `first` from the start of the text."""
    found = written(rows.select("ka", "kb", run_column(length)("text").alias("r"))
                    .filter(F.size("r.core") > 0), "runs")
    twice = (found.select(F.explode("r.core").alias("core")).groupBy("core")
             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    flat = found.select("ka", "kb", F.explode(firsts(length)("r")).alias("x")).select("ka", "kb", "x.*")
    chosen = written(flat.join(twice, "core", "left_semi"), "chosen")
    dropped(found)
    return chosen


def repeated_spans(docs: DataFrame, text_col: str, id_col: str, length: int = LENGTH,
                   core_bytes: int = CORE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row key (ka, kb) the starts of repeated strings, as stretches a to b."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    chosen = _of_repeated_cores(rows, length)
    found = _decided(rows, chosen, length, core_bytes, shard_bytes)
    places = chosen.select("ka", "kb", "core", "h", "first").distinct().join(found, ["core", "h"])
    return places.select("ka", "kb", F.explode("hits").alias("x"), "first").groupBy("ka", "kb").agg(
        F.collect_list(F.struct((F.col("first") + F.col("x.a")).alias("a"),
                                (F.col("first") + F.col("x.b")).alias("b"))).alias("spans"))


def _decided(rows: DataFrame, chosen: DataFrame, length: int, core_bytes: int, shard_bytes: int) -> DataFrame:
    """(core, h, hits) of every kind of run: the stretches of its strings that start twice.

    A kind (core, h) is counted first. The one kind of a core repeats as a whole or not at all; the bytes of
    other kinds are cut from the text of one run each.
    """
    one = F.min(F.struct("ka", "kb", "first", "anchor", "last")).alias("one")
    kinds = written(chosen.groupBy("core", "h").agg(F.count(F.lit(1)).alias("n"), one), "kinds")
    several = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("one.last").cast("int").alias("b")))
    equal = kinds.filter("n > 1").select("core", "h", whole.alias("hits"))
    asked = (kinds.join(several, "core", "left_semi").groupBy("one.ka", "one.kb")
             .agg(F.collect_list(F.struct("core", "h", "n", "one.first", "one.anchor", "one.last")).alias("asked")))
    packed = (rows.select("ka", "kb", squeezed("text").alias("packed")).groupBy("ka", "kb")
              .agg(F.first("packed").alias("packed")).join(asked, ["ka", "kb"]))  # equal rows have equal keys
    cut = packed.select(F.explode(segment_column(length)("packed", "asked")).alias("s"))
    different = written(cut.select("s.*"), "different")
    sized = different.groupBy("core").agg(F.sum(F.octet_length("seg")).alias("bytes"))
    crowded = written(sized.filter(F.col("bytes") > core_bytes).select("core"), "crowded")
    total = different.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    n_crowded = crowded.count()
    calm = different.join(crowded, "core", "left_anti") if n_crowded else different
    found = (calm.select(F.pmod(F.xxhash64("core"), F.lit(shards)).alias("shard"), "core", "h", "seg", "n")
             .groupBy("shard").applyInArrow(shard_decision(length), _FOUND_DDL))
    if n_crowded:
        found = found.unionByName(_crowded(different.join(crowded, "core", "left_semi"), length))
    # a kind that occurs twice is known to repeat as a whole
    lone = equal.join(several, "core", "left_anti")
    decided = written(found.unionByName(lone), "found")
    dropped(different)
    return decided


def kept_column(length: int):
    @vectorized("struct<removed:bigint,n_spans:bigint,kept:binary>")
    def keep(packed: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(packed.to_pylist(), spans):
            data = np.frombuffer(_unpacked(value), np.uint8)
            depth = np.zeros(len(data) + 1, np.int32)
            for s in found.as_py() or ():
                depth[s["a"]] += 1
                depth[s["b"] + length] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            edges = np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)
            out.append({"removed": int(gone.sum()), "n_spans": int(edges), "kept": data[~gone].tobytes()})
        return pa.array(out, pa.struct([("removed", pa.int64()), ("n_spans", pa.int64()),
                                        ("kept", pa.binary())]))

    return keep


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = LENGTH, found: str = "found", **sizes) -> DataFrame:
    """`docs` with a struct `found` in place of the text: removed bytes, removed runs, the remaining bytes, and
    `was_text`, whether there was a text at all. A column of the name `found` is replaced."""
    spans = repeated_spans(docs, text_col, id_col, length, **sizes)
    others = [c for c in docs.columns if c not in (text_col, found)]
    packed = docs.select(F.struct(F.lit(0), *others).alias("doc"), *row_key(id_col, text_col),
                         squeezed(text_col).alias("packed"))
    cut = packed.join(spans, ["ka", "kb"], "left").withColumn("cut", kept_column(length)("packed", "spans"))
    told = F.struct("cut.*", F.col("packed").isNotNull().alias("was_text"))
    return cut.select(*[F.col("doc").getField(c).alias(c) for c in others], told.alias(found))


def as_text(kept: str):
    """Remaining bytes as text; a character cut in two at a border of what was removed is dropped."""
    @vectorized("string")
    def decode(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else d.decode("utf-8", "ignore") for d in data.to_pylist()],
                        pa.string())

    return decode(F.col(kept))
