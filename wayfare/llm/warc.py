"""WARC archives with an index written first, and reads that follow the index.

Each page becomes a record. Of pages with equal payloads of some length, the one with the smallest
id is a response and the others are revisits of it. The index (archive, offset, length, URL,
digest) is worked out with the records, so a selection of records is read as few sorted, merged byte
ranges. Every record is a gzip member of its own, so offsets and lengths are those in the file. A NULL
payload is empty; a NULL URL has no target header; pages without an id are responses unless an
equal payload has an id; rows repeated with the smallest id are all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import vectorized, written
from wayfare.llm.files import Output, reader
from wayfare.session import scratch_path

ARCHIVE_BYTES = 32 << 20
LEVEL = 6  # of compression
READ_BYTES = 4 << 20  # most bytes of one merged read, unless one record is longer
GAP_BYTES = 64 << 10  # unselected bytes that are read along rather than skipped
LEAST_REVISIT = 100
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # a record's date must not depend on when it was written
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\r\n", *lines)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html") -> DataFrame:
    """page_id, url, html, bytes and digest of every page."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    return rows.withColumns({"bytes": F.octet_length("html").cast("long"),
                             "digest": F.sha2(F.encode("html", "UTF-8"), 256)})


def _revisit() -> Column:
    return F.col("refers_to").isNotNull()


def _http() -> Column:
    """What stands before a payload; nothing in a revisit, which has none."""
    start = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    return F.when(_revisit(), F.lit("")).otherwise(F.concat(start, F.col("bytes"), F.lit(END)))


def _block_bytes() -> Column:
    return F.octet_length(_http()) + F.when(_revisit(), F.lit(0)).otherwise(F.col("bytes"))


def _head() -> Column:
    # white space and control characters may not stand in a header
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(_revisit(), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Identified-Payload-Length: "), F.col("bytes")),
        F.when(_revisit(), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.when(_revisit(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Type: "),
                 F.lit("application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), _block_bytes()),
    )


def _record(payload: Column) -> Column:
    return F.concat(_head(), F.lit(END), _http(), payload, F.lit(END))


@vectorized("binary")
def _member(records: pa.Array) -> pa.Array:
    """The gzip member of each record, without a time stamp; NULL stays NULL."""
    return pa.array([zlib.compress(r.as_py().encode(), LEVEL, wbits=31) if r.is_valid else None
                     for r in records], pa.binary())


def _path(folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.format_string("%06d.warc.gz", "archive"))


_ORDER = ["page_id", "digest", "url"]


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, **columns) -> tuple[DataFrame, str]:
    """Write the index, then the archives; return the index and the archives' folder.

    The index follows from ids, URLs, digests and sizes alone; a payload's compressed size is found
    where it is read. Records move once and compressed, to the task that writes their archive; there
    they meet what the index says of revisits. An archive is one file: its records in the order of
    the index, each closed by the empty lines that end a WARC record.
    """
    rows = (_rows(pages, **columns).withColumn("refers_to", F.lit(None).cast("string"))
            .withColumn("member", _member(_record(F.col("html")))).drop("html", "refers_to"))
    sizes = written(rows.withColumn("whole", F.octet_length("member").cast("long")).drop("member"), "sizes")
    n = max(1, -(-(sizes.agg(F.sum("whole")).first()[0] or 0) // ARCHIVE_BYTES))
    archive = F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(n)).cast("int")
    first = (sizes.filter(F.col("bytes") >= least).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and first is not null").select("digest", "first"))
    known = sizes.join(first, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    revisit = _member(F.when(_revisit(), _record(F.lit(""))))
    before = F.sum("length").over(Window.partitionBy("archive").orderBy(*_ORDER)
                                  .rowsBetween(Window.unboundedPreceding, 0))
    index = written(
        known.withColumn("revisit", revisit)
        .select(*_ORDER, "refers_to", F.when(_revisit(), "revisit").otherwise("response").alias("type"),
                archive.alias("archive"),
                F.coalesce(F.octet_length("revisit").cast("long"), "whole").alias("length"))
        .withColumn("offset", before - F.col("length")), "index")
    said = index.filter(_revisit()).select("archive", *_ORDER, F.col("refers_to").alias("said")).distinct()
    same = Window.partitionBy("archive", *_ORDER)
    met = (rows.withColumn("archive", archive).unionByName(said, allowMissingColumns=True)
           .repartitionById(n, F.col("archive")).withColumn("refers_to", F.max("said").over(same))
           .filter(F.col("member").isNotNull()))
    folder = scratch_path(pages.sparkSession, "warc")
    files = (met.withColumn("revisit", revisit).withColumn("path", _path(folder))
             .sortWithinPartitions("archive", *_ORDER)
             .select("path", F.coalesce("revisit", "member").alias("member")))
    written(files.mapInArrow(_write, "path string, bytes long"), "archives")
    return index, folder


def _write(batches):
    """Write sorted records to the archives they name; one row per archive."""
    path, file = None, None
    for batch in batches:
        for name, member in zip(batch.column("path").to_pylist(), batch.column("member")):
            if name != path:
                if file is not None:
                    file.done()
                    yield _done(path, file)
                path, file = name, Output(name)
            file.write(member.as_buffer())
    if file is not None:
        file.done()
        yield _done(path, file)


def _done(path: str, file: Output) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "bytes": [file.size]})


def byte_ranges(index: DataFrame, read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """Merged reads of the selected records: archive, start, end and the records' places.

    Records are sorted by offset; a read goes on over small gaps and ends at steps of `read_bytes`.
    """
    by_offset = Window.partitionBy("archive").orderBy("offset")
    step = F.floor(F.col("offset") / read_bytes)
    last_end = F.lag(F.col("offset") + F.col("length")).over(by_offset)
    fresh = last_end.isNull() | (F.col("offset") > last_end + gap) | (F.lag(step).over(by_offset) != step)
    return (index.withColumn("fresh", fresh.cast("int"))
            .withColumn("read", F.sum("fresh").over(by_offset))
            .groupBy("archive", "read")
            .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
                 F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places")))


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    end = END.encode()
    head, _, rest = record.partition(end)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if rest[len(block):] != end or len(block) != int(headers["Content-Length"]):
        raise ValueError("a record's length is wrong")
    payload = block.partition(end)[2] if headers["WARC-Type"] == "response" else b""
    if headers["WARC-Type"] == "response":
        found = hashlib.sha256(payload).hexdigest()
        if headers["WARC-Payload-Digest"] != f"sha256:{found}":
            raise ValueError("a payload does not fit its digest")
    return headers, payload


def _name(urn: str | None) -> str | None:
    return (urn[len("<urn:page:"):-1] or None) if urn else None


_READ = ("page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
         "refers_to string")


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The selected records, read from the archives and checked against their digests.

    The index is small beside the archives, so tasks follow the bytes to read, not its rows.
    """
    schema = _READ + (", payload binary" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(frames):
        for frame in frames:
            for path, start, end, places in zip(frame["path"], frame["start"], frame["end"], frame["places"]):
                with reader(path) as file:
                    data = file.read_at(end - start, start)
                out, held = [], 0
                for place in places:
                    at = place["offset"] - start
                    headers, payload = parsed(gzip.decompress(data[at:at + place["length"]]))
                    row = [_name(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"),
                           int(headers["WARC-Identified-Payload-Length"]),
                           headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                           headers["WARC-Type"], _name(headers.get("WARC-Refers-To"))]
                    if headers["WARC-Type"] == "response" and row[2] != len(payload):
                        raise ValueError("a payload's length is wrong")
                    out.append((*row, payload) if with_payload else tuple(row))
                    held += len(payload) if with_payload else 0
                    if held > READ_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
                yield pd.DataFrame(out, columns=columns)

    n = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // ARCHIVE_BYTES))
    reads = byte_ranges(index).withColumn("path", _path(folder)).repartition(n, "path", "start")
    return reads.select("path", "start", "end", "places").mapInPandas(read, schema)
