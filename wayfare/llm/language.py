"""Language identification by cross-parsing entropy.

Per language, the suffix automaton of a bounded sample of labelled text accepts exactly the
strings that occur in the sample. A text is parsed greedily into the longest phrases that occur
there; its cross-entropy is phrases * log2(sample size) / length, and the language with the lowest
one wins, ties by name. Letters A-Z count as a-z, other ASCII characters as spaces.

The sample is the only bounded part: of up to `SAMPLE_DOCS` texts per language, `SAMPLE_BYTES` bytes
in equal shares, what short texts leave going to longer ones; a text longer than its share gives
stretches from all over it. Languages may be any number: those whose tables fit in `TABLE_BYTES`
together are compared in one scan of the documents, and the best two so far go from scan to scan.

Parsing restarts every BLOCK bytes, so that a long text takes no more steps than a short one; every
byte is parsed. NULL texts and texts without a letter are `und` with score 0, as are all texts if
there is no labelled sample. Ids, sources and labels are never looked at when predicting.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import dropped, pieces, vectorized, written
from wayfare.operators.skew import salted_join

SAMPLE_DOCS = 96  # labelled texts per language, equal texts counted once
SAMPLE_BYTES = 24_000  # of text per language in its automaton, separators aside
STRETCHES, STRETCH_BYTES = 8, 200  # at most so many stretches of a text, of so many bytes or more
SAMPLE_BUCKETS = 64  # the smallest hashes are found per bucket first, so that no language is one task
BROADCAST_ROWS = 1 << 20  # sampled (language, hash) pairs that one broadcast may hold
TABLE_BYTES = 128 << 20  # of automata in one scan
BLOCK = 2048
UNKNOWN = "und"
_BEST = "lang string, best double, second double"

# 0 separates, ASCII letters have one case, the rest of ASCII is one space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`; state 0 is the root."""
    links, lengths, moves, last = [-1], [0], [{}], 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = links[at]
        if at >= 0:
            target = moves[at][symbol]
            if lengths[target] != lengths[at] + 1:
                copy = len(moves)
                moves.append(dict(moves[target]))
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                links[target] = copy
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = links[at]
                target = copy
            links[new] = target
        last = new
    return moves


def shares(lengths: list[int], total: int) -> list[int]:
    """How much of each length is taken so that all together take `total`, as equally as they can."""
    taken, left = [0] * len(lengths), total
    for place, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        taken[i] = min(lengths[i], left // (len(lengths) - place))
        left -= taken[i]
    return taken


def stretches(text: bytes, limit: int) -> bytes:
    """`text`, or if it is longer than `limit`, stretches at equal distances with a space between."""
    if len(text) <= limit:
        return text
    parts = max(1, min(STRETCHES, limit // STRETCH_BYTES))
    size = limit // parts
    gap = len(text) - size * parts
    starts = [i * size + gap * (2 * i + 1) // (2 * parts) for i in range(parts)]
    return b" ".join(text[at:at + size] for at in starts)


def _stretched(text):
    """`stretches` of a text column down to SAMPLE_BYTES, so that long texts are cut before they move."""
    raw, n, size = text.cast("binary"), F.octet_length(text), SAMPLE_BYTES // STRETCHES
    cut = []
    for i in range(STRETCHES):
        at = i * size + F.floor((n - size * STRETCHES) * (2 * i + 1) / (2 * STRETCHES)) + 1
        cut += [F.lit(b" "), raw.substr(at.cast("int"), F.lit(size))]
    return F.when(n <= SAMPLE_BYTES, raw).otherwise(F.concat(*cut[1:]))


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language's sample and its automaton as (state, symbol, target) triples."""
    texts = pdf.sort_values("h")["text"].tolist()
    taken = shares([len(t) for t in texts], SAMPLE_BYTES)
    text = _FOLD[np.frombuffer(b" ".join(map(stretches, texts, taken)), np.uint8)].tobytes()
    moves = automaton(text)
    triples = np.array([(s, c, t) for s, to in enumerate(moves) for c, t in to.items()], np.int32)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "sample": [text], "size": [len(text)],
                         "states": [len(moves)], "symbols": [bytes(sorted(set(text)))],
                         "moves": [triples.tobytes()]})


class Parser:
    """The automata of all languages in one table: next state and whether a phrase begins."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["lang"])
        self.names = [r["lang"] for r in rows]
        self.bits = np.array([math.log2(r["size"] + 2) for r in rows])
        all_moves = [np.frombuffer(r["moves"], np.int32).reshape(-1, 3) for r in rows]
        symbols = np.unique(np.concatenate([m[:, 1] for m in all_moves]))
        self.code = np.zeros(256, np.uint8)
        self.code[symbols] = np.arange(1, len(symbols) + 1)
        self.code = self.code[_FOLD]
        self.width = len(symbols) + 1
        code = np.zeros(256, np.int64)
        code[symbols] = np.arange(1, len(symbols) + 1)
        tables, self.roots, total = [], [], 0
        for moves in all_moves:
            states = int(moves[:, [0, 2]].max()) + 1
            table = np.full((states, self.width), -1, np.int64)
            table[moves[:, 0], code[moves[:, 1]]] = moves[:, 2]
            # at the root a phrase begins; a symbol that the sample lacks is one by itself
            root = np.where(table[0] < 0, 0, table[0])
            table = np.where(table < 0, (total + root) * 2 + 1, (total + table) * 2)
            table[0] |= 1
            tables.append(table.astype(np.int32))
            self.roots.append(total)
            total += states
        self.table = np.concatenate(tables).ravel()

    def phrases(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Phrases per language and row."""
        lengths = np.diff(borders)
        blocks = -(-lengths // BLOCK)
        row = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(lengths[row] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], (borders[row] + nth * BLOCK)[order], size[order]
        count = np.zeros((len(self.names), len(lengths)), np.int64)
        if not len(row):
            return count
        codes = np.concatenate([self.code[data], np.zeros(BLOCK, np.uint8)])
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(row), 1)
        begun = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for step in range(int(size[0])):
            n = int(active[step])
            move = self.table[state[:, :n] * self.width + codes[start[:n] + step]]
            begun[:, :n] += move & 1
            state[:, :n] = move >> 1
        for i in range(len(self.names)):
            count[i] = np.bincount(row, begun[i], len(lengths))
        return count


def _smallest(rows: DataFrame, *keys: str) -> DataFrame:
    """The SAMPLE_DOCS rows with the smallest hash of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return rows.withColumn("place", place).filter(F.col("place") <= SAMPLE_DOCS).drop("place")


def parsers(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per language: its bounded sample and the automaton of it, written to the shared folder.

    Equal texts are met once, by hash and before any text moves; of the distinct ones the
    `SAMPLE_DOCS` with the smallest hash are read. Rows without a language or text teach nothing.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(text_col).alias("h")).filter(
        "lang is not null and text is not null and octet_length(text) > 0")
    hashes = rows.select("lang", "h").distinct().withColumn("bucket", F.pmod("h", F.lit(SAMPLE_BUCKETS)))
    chosen = written(_smallest(_smallest(hashes, "lang", "bucket"), "lang").select("lang", "h"), "sample")
    if chosen.count() <= BROADCAST_ROWS:
        picked = rows.join(F.broadcast(chosen), ["lang", "h"])
    else:
        picked = salted_join(rows, chosen, ["lang", "h"])
    texts = (picked.select("lang", "h", _stretched(F.col("text")).alias("text"))
             .groupBy("lang", "h").agg(F.min("text").alias("text")))
    return written(texts.groupBy("lang").applyInPandas(
        _train, "lang string, sample binary, size long, states long, symbols binary, moves binary"), "automata")


def _scans(automata: DataFrame, limit: int) -> list[list[str]]:
    """Languages by name, cut into scans whose tables hold `limit` bytes, or one language."""
    scans, states, symbols = [], 0, set()
    for row in sorted(automata.select("lang", "states", "symbols").collect(), key=lambda r: r["lang"]):
        states, symbols = states + row["states"], symbols | set(row["symbols"])
        if not scans or 4 * states * (len(symbols) + 1) > limit:
            scans.append([])
            states, symbols = row["states"], set(row["symbols"])
        scans[-1].append(row["lang"])
    return scans


def _comparer(known):
    """A column function (text, best two so far) -> best two with the languages of one scan."""

    @vectorized(_BEST)
    def compare(text: pa.Array, earlier: pa.Array) -> pa.Array:
        parser, out, row0 = known.value, [], 0
        names = np.array(parser.names, object)
        for data, borders in pieces(text, 1 << 20):
            before = earlier.slice(row0, len(borders) - 1)
            row0 += len(borders) - 1
            bits = parser.phrases(data, borders) * parser.bits[:, None]
            bits /= np.maximum(np.diff(borders), 1)
            which = np.argmin(bits, 0)
            # an earlier scan has the names that come first, so it keeps ties
            old = np.asarray(before.field("best"), float)
            ranked = np.sort(np.concatenate(
                [[old, np.asarray(before.field("second"), float)], np.sort(bits, 0)[:2]]), 0)
            was = np.asarray(before.field("lang").to_numpy(zero_copy_only=False), object)
            out.append((np.where(bits.min(0) < old, names[which], was), ranked[0], ranked[1]))
        join = lambda i, empty: np.concatenate([x[i] for x in out]) if out else np.zeros(0, empty)
        return pa.StructArray.from_arrays(
            [pa.array(join(0, object), pa.string()), pa.array(join(1, float)), pa.array(join(2, float))],
            ["lang", "best", "second"])

    return compare


def identify(docs: DataFrame, automata: DataFrame, text_col: str = "text", lang: str = "lang_pred",
             score: str = "score", limit: int = TABLE_BYTES) -> DataFrame:
    """`docs` with the predicted language and a score from 0 to 1: how far the second is behind.

    One scan per `limit` bytes of tables; all scans but a single one write the documents. A single
    language scores 1. Columns named `lang` or `score` are replaced.
    """
    spark = docs.sparkSession
    found = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("body"),
        F.struct(F.lit(None).cast("string").alias("lang"), F.lit(math.inf).alias("best"),
                 F.lit(math.inf).alias("second")).alias("found"))
    scans, last = _scans(automata, limit), None
    for names in scans:
        known = spark.sparkContext.broadcast(Parser(automata.filter(F.col("lang").isin(names)).collect()))
        found = found.withColumn("found", _comparer(known)(F.col("body"), F.col("found")))
        if len(scans) > 1:
            found = written(found, "compared")
            if last is not None:
                dropped(last)
            last = found
    known = F.col("body").rlike(r"\p{L}") & F.col("found.lang").isNotNull()
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    return found.select(
        *kept, F.when(known, F.col("found.lang")).otherwise(UNKNOWN).alias(lang),
        F.when(known & (F.col("found.second") > 0), 1 - F.col("found.best") / F.col("found.second"))
        .otherwise(0.0).alias(score))


def held_out(id_col: str = "doc_id"):
    """The fold kept for testing: a quarter of the ids, by their CRC."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2,
                      F.lit(False))
