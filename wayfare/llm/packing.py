"""Packing of token sequences: first-fit decreasing in randomised groups.

A document is tokenised and closed by an end id. One longer than a sequence is cut into full pieces
and a rest. Pieces are dealt at random into groups of about GROUP_PIECES, and each group is packed
by itself: longest piece first, into the first sequence with room, found in a tournament tree of
the room left. A NULL or empty text is a piece of one id. Equal lengths go by document, start and
checksum; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import vectorized, written
from wayfare.llm.tokens import encoded

LENGTH = 2048
GROUP_PIECES = 8192


def first_fit(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the order given.

    The tree's leaves are bins, an inner node holds the most room below it: the first bin with
    room is found by going left wherever the left half has enough.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= length
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def piece_table(docs: DataFrame, vocab: str, id_col: str, text_col: str, end_id: int,
                length: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked, the ids."""
    kind = "start long, length int, ids_crc32 long" + (", ids binary" if with_ids else "")

    @vectorized(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    def cut(text: pa.Array) -> pa.Array:
        starts, sizes, sums, data, counts = [], [], [], [], []
        for ids in encoded(text, vocab):
            flat = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            n = len(flat) // 4
            for start in range(0, n, length):
                part = flat[4 * start:4 * (start + length)]
                starts.append(start)
                sizes.append(len(part) // 4)
                sums.append(zlib.crc32(part))
                if with_ids:
                    data.append(part)
            counts.append(-(-n // length))
        columns = [pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())]
        columns += [pa.array(data, pa.binary())] if with_ids else []
        whole = pa.StructArray.from_arrays(columns, ["start", "length", "ids_crc32", "ids"][:len(columns)])
        borders = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(borders, whole)

    found = docs.select(F.col(id_col).alias("doc_id"), cut(F.col(text_col)).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    return found.select("doc_id", total.alias("doc_tokens"), F.explode("p").alias("p")).select(
        "doc_id", "doc_tokens", "p.*")


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 1, length: int = LENGTH, group_pieces: int = GROUP_PIECES,
         with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset; texts and ids are not shuffled.

    Pieces are written once; the groups are dealt over their row numbers there, so that a task
    that runs again deals alike and no document or length can crowd one group.
    """
    table = written(piece_table(docs, vocab, id_col, text_col, end_id, length, with_ids), "pieces")
    n = max(1, -(-table.count() // group_pieces))
    numbered = table.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.select(
        F.pmod(F.xxhash64(F.col("row")), F.lit(n)).alias("g"), "doc_id", "doc_tokens", "start", "length",
        "ids_crc32", *(["row"] if with_ids else []))
    fields = [(f.name, f.dataType.simpleString()) for f in dealt.schema.fields if f.name != "g"]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"],
                                  ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(frame["length"].tolist(), length)
        frame["sequence_id"] = np.array(bins, np.int64) + (np.int64(frame["g"].iloc[0]) << 32)
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns="g")

    schema = ", ".join(f"{a} {b}" for a, b in fields) + ", sequence_id long, offset long"
    placed = dealt.groupBy("g").applyInPandas(place, schema)
    placed = placed.withColumn("length", F.col("length").cast("long"))
    if with_ids:
        placed = placed.join(numbered.select("row", "ids"), "row").drop("row")
    return placed
