"""Token ids of a corpus as binary files in Simple-8b, and the way back.

Documents are ordered by id (NULL first, equal ids by text hash), cut into ranges, and each range
becomes one file: groups of coded ids with the offsets of their blocks, then the documents' ids and
lengths. Files follow each other in the order of their numbers. A NULL or empty text has only its
end id; repeated rows are written as often as they occur; an empty table has no file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import written
from wayfare.llm.files import Output, reader
from wayfare.llm.simple8b import BLOCK, decode, encode
from wayfare.llm.tokens import encoded
from wayfare.operators.totals import running_total

MAGIC = b"S8BIDS01"
GROUP = 256 * BLOCK
FILE_BYTES = 64 << 20  # of text in one file
_GROUP_HEAD = struct.Struct("<IIII")  # ids, blocks, words, exceptions
_TAIL = struct.Struct("<QQ8s")  # where the table of documents begins, how many, magic
_MANIFEST = "number long, path string, n_docs long, n_ids long"


def _write_group(out: Output, ids: np.ndarray) -> None:
    words, offsets, exceptions = encode(ids)
    out.write(_GROUP_HEAD.pack(len(ids), len(offsets), len(words), len(exceptions)))
    for part, kind in ((offsets, "<u4"), (words, "<u8"), (exceptions, "<u8")):
        out.write(part.astype(kind).tobytes())


class _File:
    def __init__(self, path: str):
        self.out = Output(path)
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= GROUP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // GROUP * GROUP
        for i in range(0, whole, GROUP):
            _write_group(self.out, ids[i:min(i + GROUP, whole)])
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def done(self) -> None:
        self._flush(True)
        at = self.out.size
        self.out.write(np.array([i is not None for i in self.docs], np.uint8).tobytes())
        self.out.write(np.array([i or 0 for i in self.docs], "<i8").tobytes())
        self.out.write(np.array(self.lengths, "<u8").tobytes())
        self.out.write(_TAIL.pack(at, len(self.docs), MAGIC))
        self.out.done()


def write_token_files(docs: DataFrame, folder: str, vocab: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 0,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and return the manifest: number, path, n_docs, n_ids, and the ids before."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (rows.withColumn("h", F.xxhash64("text"))
               .repartitionByRange(max(1, -(-size // file_bytes)), "id", "h")
               .sortWithinPartitions("id", "h").drop("h"))

    def write(batches):
        from pyspark import TaskContext

        number, file = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows and file is None:
                path = f"{folder}/{number:06d}.s8b"
                file = _File(path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), vocab)):
                file.add(doc_id, np.append(ids, np.uint32(end_id)))
        if file is not None:
            file.done()
            yield pa.RecordBatch.from_pydict({"number": [number], "path": [path],
                                              "n_docs": [len(file.docs)], "n_ids": [file.n_ids]})

    manifest = written(ordered.mapInArrow(write, _MANIFEST), "manifest")
    return running_total(manifest, [], "number", "n_ids", "start", "all_ids").drop("all_ids")


def groups(file):
    """The ids of one open file, group by group."""
    if file.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("no token file")
    end, *_ = _TAIL.unpack(file.read_at(_TAIL.size, file.size() - _TAIL.size))
    at = len(MAGIC)
    while at < end:
        n, blocks, words, exceptions = _GROUP_HEAD.unpack(file.read_at(_GROUP_HEAD.size, at))
        at += _GROUP_HEAD.size
        data = file.read_at(4 * blocks + 8 * (words + exceptions), at)
        at += len(data)
        offsets = np.frombuffer(data, "<u4", blocks).astype(np.int64)
        both = np.frombuffer(data, "<u8", words + exceptions, 4 * blocks)
        yield decode(both[:words], offsets, both[words:], n).astype(np.uint32)


def documents_of(file):
    """(id, token ids) of each document of one open file."""
    end, n, magic = _TAIL.unpack(file.read_at(_TAIL.size, file.size() - _TAIL.size))
    if magic != MAGIC:
        raise ValueError("no token file")
    table = file.read_at(17 * n, end)
    valid = np.frombuffer(table, np.uint8, n)
    names, lengths = np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<u8", n, 9 * n)
    parts, have, more = [], 0, groups(file)
    for i in range(n):
        need = int(lengths[i])
        while have < need:
            parts.append(next(more))
            have += len(parts[-1])
        ids = np.concatenate(parts) if len(parts) != 1 else parts[0]
        yield (int(names[i]) if valid[i] else None), ids[:need]
        parts, have = [ids[need:]], have - need


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(frames):
        import pandas as pd

        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                out = []
                with reader(path) as file:
                    for doc_id, ids in documents_of(file):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _frame(pd, out)
                            out = []
                if out:
                    yield _frame(pd, out)

    files = manifest.select("path", "start")
    n = max(1, manifest.count())
    return files.repartition(n).mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(pd, rows):
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return frame.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
