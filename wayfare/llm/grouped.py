"""Whole groups in Arrow tables: many small groups per call, large ones as tiles of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 4096


def tiles(df: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Rows of a large group in tiles, so that every two rows of it meet in one tile.

    A group of `blocks` blocks has blocks * (blocks + 1) / 2 tiles (x, y); a row of block x goes to
    the tiles of its block. Groups of one block have one tile and no copies. In tile (x, y) with
    x < y only pairs of different blocks count.
    """
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    return (df.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
            .drop("blocks", "other"))


def by_group(df: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], pa.Table | None],
             schema: str) -> DataFrame:
    """Apply `function` to tables of whole groups; it gets the table and the borders of its groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            rest = table
            if len(table) < ROWS:
                continue
            borders = _borders(table, keys)
            if len(borders) > 2:  # the last group may go on
                yield from _given(function(table.slice(0, borders[-2]).combine_chunks(), borders[:-1]))
                rest = table.slice(borders[-2])
        if rest is not None and len(rest):
            yield from _given(function(rest.combine_chunks(), _borders(rest, keys)))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _given(found: pa.Table | None):
    return found.to_batches() if found is not None and len(found) else []


def _borders(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = len(table)
    fresh = np.zeros(n, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(fresh), [n]])


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of `n` indices by edges a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    return label
