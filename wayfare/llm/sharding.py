"""Sharding by sampled splitters: near-equal sizes, equal texts together, gapless places.

The key of a row is (hash of its text, id). Keys are sampled in proportion to row size; quantiles of
the sample part the keys into narrow ranges, whose sizes are then summed exactly. Ranges that
came out overfull are subdivided, by hash or, inside one hash, by id. Consecutive ranges make up a
shard. Equal texts share a hash and stay in one shard unless their group alone is overfull. The
same rows give the same shards. NULL texts are empty; rows equal in id and text are one key and
stay together; an empty table stays empty. Ids are whole numbers or, by their hash, anything else.

The number of ranges follows from the shards alone, so what comes to the driver (samples, a row per
range) does not grow with the input. Places are numbered in parts of a range, after the parts before.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wayfare.llm.common import vectorized, written

RANGES = 128  # narrow ranges per shard
PART_ROWS = 200_000  # about so many rows of a range are numbered in one task
SAMPLES = 24  # sampled keys per range
OVERFULL = 2.0  # times the share of a range


def _range_of(splitters: np.ndarray):
    """The range of a (hash, id) key: how many splitters are not above it."""
    hashes, ids = splitters[:, 0], splitters[:, 1]

    @vectorized("int")
    def find(h: pa.Array, i: pa.Array) -> pa.Array:
        h, i = h.to_numpy(zero_copy_only=False), i.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = high.astype(np.int32)
        met = high > low
        for at in np.unique(low[met]).tolist():
            some = np.flatnonzero(met & (low == at))
            out[some] = at + np.searchsorted(ids[at:high[some[0]]], i[some], "right")
        return pa.array(out)

    return find


def _quantiles(rows, weight_of, parts: int) -> list[tuple[int, int]]:
    """Keys at the borders of `parts` stretches of equal weight, from weighted samples."""
    rows = sorted(rows)
    if not rows or parts < 2:
        return []
    total = np.cumsum([weight_of(r) for r in rows])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts, "left")
    return sorted({(rows[i][0], rows[i][1]) for i in np.minimum(at, len(rows) - 1).tolist()})


def _sampled(keyed: DataFrame, total: int, n: int) -> list[tuple[int, int, int]]:
    """About `n` keys, each row taken with a chance in proportion to its size."""
    rate = n / max(total, 1)
    chance = F.pmod(F.xxhash64("h", "i", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = keyed.filter(chance < F.col("size") * rate).groupBy("h", "i").agg(F.sum("size").alias("size"))
    return [(r["h"], r["i"], max(r["size"], 1 / rate)) for r in rows.select("h", "i", "size").collect()]


def _sizes(keyed: DataFrame, splitters: list[tuple[int, int]]) -> dict[int, tuple[int, int, int, int]]:
    """Per range: bytes, rows, smallest and largest hash. One row per range comes to the driver."""
    find = _range_of(np.array(splitters, np.int64).reshape(-1, 2))
    rows = keyed.withColumn("r", find("h", "i")).groupBy("r").agg(
        F.sum("size"), F.count(F.lit(1)), F.min("h"), F.max("h")).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                   ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot and, to route files, range."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    number = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    keyed = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.coalesce(number, F.lit(-(1 << 63))).alias("i")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges
    splitters = _quantiles(_sampled(keyed, total, parts * SAMPLES), lambda r: r[2], parts)
    sizes = _sizes(keyed, splitters)
    full = {r for r, s in sizes.items() if s[0] > OVERFULL * total / parts}
    if full:
        find = _range_of(np.array(splitters, np.int64).reshape(-1, 2))
        inside = keyed.withColumn("r", find("h", "i")).filter(F.col("r").isin(sorted(full)))
        # a range of one hash is a group of equal texts: only that is cut by id
        one_hash = {r for r in full if sizes[r][2] == sizes[r][3] and sizes[r][0] > total / shards / 8}
        samples = sorted(_sampled(inside, sum(sizes[r][0] for r in full), len(full) * SAMPLES * 8))
        borders = [0, *(bisect_left(samples, key, key=lambda s: s[:2]) for key in splitters), len(samples)]
        for r in sorted(full):
            own = samples[borders[r]:borders[r + 1]]
            cuts = _quantiles(own, lambda s: s[2], max(2, -(-int(sizes[r][0]) * parts // max(total, 1))))
            if r not in one_hash:
                cuts = [(h, -(1 << 63)) for h in {c[0] for c in cuts}]
            splitters = sorted({*splitters, *cuts})
        sizes = _sizes(keyed, splitters)
    find = _range_of(np.array(splitters, np.int64).reshape(-1, 2))
    # the middle of a range decides its shard, so no shard is off by more than half a range a side
    shard, first, before, counts = {}, {}, 0, {}
    for r in sorted(sizes):
        size, n = sizes[r][:2]
        shard[r] = min(shards - 1, int((before + size / 2) * shards // max(total, 1)))
        first[r] = counts.get(shard[r], 0)
        counts[shard[r]] = first[r] + n
        before += size
    plan = docs.sparkSession.createDataFrame(
        [(r, shard[r], first[r], -(-sizes[r][1] // PART_ROWS)) for r in sorted(sizes)],
        "range int, shard int, first long, parts long")
    placed = (keyed.withColumn("range", find("h", "i")).join(F.broadcast(plan), "range")
              .withColumn("part", F.pmod(F.xxhash64("h", "i"), F.col("parts"))))
    # rows are numbered inside a part, after the rows of the parts and ranges before
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("range", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy("range", "part").orderBy("h", "i"))
    return (placed.withColumn("place", place).join(before, ["range", "part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "range"))
