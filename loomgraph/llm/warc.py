"""WARC files: written, indexed, and read by coalesced byte ranges.

Writing. Each partition writes its own files of about ``FILE_BYTES``, a gzip member a record. Rows that
name the files are written to the shared folder last, so a task that ran twice leaves an unnamed file behind, no
duplicate.

Index first. Every file is scanned once, by one task, for (file, offset, length, id, url, digest) of each
record; the index is a table of its own, and records are selected by it alone.

Reading. The selected records are sorted by file and offset; those less than ``GAP_BYTES`` apart,
within one stretch of ``RANGE_BYTES``, are read by one byte-range request.

Files may be on any file system that pyarrow knows by its URI. Plain and gzipped files are read. Scans and reads
are spread over a number of tasks that follows the bytes of the files and the number of ranges.

Defined results: a null payload is a record of type metadata without content and with a header of its own that has it read
as null, an empty one as empty; null ids and urls have no header and are read as null; rows alike are records
each; an empty table gives no files and empty results; line breaks in a url are written as spaces, other spaces stay; other
columns are not written. Of the records of one digest that of the least id is the first, then of the least url (nulls last). A
file that ends within a record fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans import scratch

FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
ID_HEADER = "X-Page-Id"
URL_HEADER = "WARC-Target-URI"
NULL_HEADER = "X-Page-Null"
#: Bytes of files that a task scans, and ranges that a task reads, about.
SCAN_BYTES = 128 << 20
TASK_RANGES = 16
_CHUNK = 1 << 16


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(id_: int | None, url: str | None, payload: bytes | None, date: str = DATE) -> bytes:
    """One record, not compressed."""
    body = payload or b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{id_} {url} {digest(body)}")
    lines = ["WARC/1.0", f"WARC-Type: {'metadata' if payload is None else 'resource'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        lines.append(f"{URL_HEADER}: " + url.replace("\r", " ").replace("\n", " "))
    if id_ is not None:
        lines.append(f"{ID_HEADER}: {id_}")
    if payload is None:
        lines.append(f"{NULL_HEADER}: true")
    else:
        lines.append(f"WARC-Payload-Digest: {digest(body)}")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:] if x)}
    return {k: v if k == URL_HEADER.lower() else v.strip(" ") for k, v in fields.items()}


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and payload of a record, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    end = data.index(b"\r\n\r\n")
    header = _header(data[:end])
    body = data[end + 4 : end + 4 + int(header["content-length"])]
    if len(body) != int(header["content-length"]):
        raise ValueError("a record is cut off")
    return header, body


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def scan(stream) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header of each record of a binary stream."""
    held, offset = b"", 0

    def more() -> bool:
        nonlocal held
        data = stream.read(_CHUNK)
        held += data
        return bool(data)

    while held or more():
        if len(held) < 2:
            more()
        if held[:2] == b"\x1f\x8b":
            unpack, data, used = zlib.decompressobj(31), [], 0
            part = held
            while True:
                data.append(unpack.decompress(part))
                if unpack.eof:
                    break
                used += len(part)
                part = stream.read(_CHUNK)
                if not part:
                    raise ValueError("a record is cut off")
            held = unpack.unused_data
            length = used + len(part) - len(held)
            yield offset, length, parse(b"".join(data))[0]
        else:
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not more():
                    raise ValueError("a record is cut off")
            header = _header(held[:end])
            length = end + 8 + int(header["content-length"])
            while len(held) < length:
                if not more():
                    raise ValueError("a record is cut off")
            held = held[length:]
            yield offset, length, header
        offset += length


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compress: bool = True) -> DataFrame:
    """Write the pages into the folder; (file, records, bytes) of its files."""
    base = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        stream, done = None, []

        def close() -> None:
            nonlocal stream
            if stream:
                stream[0].close()
                done.append(stream[1:])
                stream = None

        for batch in batches:
            for id_, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    stream = [fs.open_output_stream(f"{path}/{name}", compression=None), f"{folder.rstrip('/')}/{name}", 0, 0]
                data = record(id_, url, None if html is None else html.encode("utf-8", "replace"))
                if compress:
                    pack = zlib.compressobj(6, wbits=31)
                    data = pack.compress(data) + pack.flush()
                stream[0].write(data)
                stream[2] += 1
                stream[3] += len(data)
                if stream[3] >= FILE_BYTES:
                    close()
        close()
        names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return scratch.materialize(base.mapInArrow(run, "file string, records bigint, bytes bigint"), "files")


def _tasks(spark: SparkSession, count: int, least: float) -> int:
    """Tasks for ``count`` equal pieces of work: ``least`` or, of fewer, enough for all cores, but none without work."""
    return max(1, min(count, max(math.ceil(least), 4 * spark.sparkContext.defaultParallelism)))


def index(files: DataFrame) -> DataFrame:
    """(file, offset, length, id, url, digest) of every record of the files, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _filesystem(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = [(name, at, n, int(h[ID_HEADER.lower()]) if ID_HEADER.lower() in h else None, h.get(URL_HEADER.lower()), h.get("warc-payload-digest")) for at, n, h in scan(stream)]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "length", "id", "url", "digest"])

    count, size = files.agg(F.count("*"), F.sum("bytes")).first()
    spread = files.select("file").repartition(_tasks(files.sparkSession, count, (size or 0) / SCAN_BYTES))
    return scratch.materialize(spread.mapInArrow(run, "file string, offset bigint, length bigint, id bigint, url string, digest string"), "index")


def first_of_digest(index_: DataFrame) -> DataFrame:
    """Of the records of one digest, that of the least id and url; records without a digest are alike."""
    place = F.struct(F.col("id").isNull(), "id", F.col("url").isNull(), "url", "file", "offset", "length")
    return index_.groupBy("digest").agg(F.min(place).alias("p")).select("p.file", "p.offset", "p.length")


def ranges(selected: DataFrame) -> DataFrame:
    """(file, start, end, records): the byte ranges to read, and the (offset, length) of the records in each."""
    by = Window.partitionBy("file").orderBy("offset")
    before = F.lag("offset").over(by)
    apart = (F.col("offset") - before - F.lag("length").over(by) > GAP_BYTES) | (F.floor(F.col("offset") / RANGE_BYTES) != F.floor(before / RANGE_BYTES))
    cut = selected.select("file", "offset", "length", F.coalesce(apart, F.lit(True)).cast("int").alias("new"))
    numbered = cut.withColumn("range", F.sum("new").over(by))
    records = F.sort_array(F.collect_list(F.struct("offset", "length")))
    return numbered.groupBy("file", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), records.alias("records")).select("file", "start", "end", "records")


def read(selected: DataFrame) -> DataFrame:
    """(id, url, digest, html) of the selected (file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for name, start, end, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _filesystem(name)
                with fs.open_input_file(path) as file:
                    data = file.read_at(end - start, start)
                rows = []
                for r in records:
                    at = r["offset"] - start
                    h, body = parse(data[at : at + r["length"]])
                    rows.append((int(h[ID_HEADER.lower()]) if ID_HEADER.lower() in h else None, h.get(URL_HEADER.lower()), h.get("warc-payload-digest"), None if NULL_HEADER.lower() in h else body.decode("utf-8", "replace")))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "url", "digest", "html"])

    spans = scratch.materialize(ranges(selected), "ranges")
    count = spans.count()
    return spans.repartition(_tasks(spans.sparkSession, count, count / TASK_RANGES)).mapInArrow(run, "id bigint, url string, digest string, html string")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html) of the first page of each payload: written, indexed, selected by digest and read back."""
    files = write(pages, scratch.scratch_path(spark, "warc"), id_col, url_col, html_col)
    back = read(first_of_digest(index(files)))
    return back.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("html").alias(html_col))
