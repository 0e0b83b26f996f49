"""Operator 7: WARC archives with a monolithic-gzip normaliser.

* ``deduplicated`` marks the rows of equal payloads: the smallest id keeps the
  payload, the others refer to it (one partial aggregation over digests; the hot
  digest's rows are never brought together).
* ``write`` puts the rows of a partition into archives of about ``ROTATE`` bytes,
  each one single gzip stream, as many crawlers leave them.
* ``normalise`` inflates such a file once, front to back, holding one record and
  one chunk at a time, writes every record as a gzip member of its own and, beside
  it, an index of JSON lines (offset, length, id, type, digest).  It takes any list
  of archives, also of several members or not compressed at all.
* ``read`` reaches every record through the index, by offset.

A response's block is an HTTP header and the payload in UTF-8; a revisit has the
header only and names digest and length of the full payload.  A file's name holds
its task attempt, and only files that Spark has committed to the manifest count.

Defined results: a null payload is empty; payloads below ``SMALLEST`` bytes are always
responses; repeated rows of the smallest id are all responses; rows without an id
may be revisits and are referred to by none; control characters and non-ASCII
characters of a URL are percent-encoded in the header, a null URL is empty; extra
columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written
from .files import opened, own_name

SMALLEST = 100
ROTATE = 64 << 20
CHUNK = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

ROWS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
INDEX = "archive string, offset long, length long, record_id string, record_type string, digest string"


def deduplicated(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to) of each row."""
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                     text.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = (rows.where(F.col("payload_bytes") >= SMALLEST).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = written(again, "warc-digests")
    rows = rows.join(again, "digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(page_id, url, payload: str, size: int, digest: str, refers_to) -> bytes:
    """One WARC record."""
    revisit = refers_to is not None
    block = HTTP % size + (b"" if revisit else payload.encode())
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=SAFE)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "") + "%"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def write(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of ``deduplicated`` as archives of one gzip stream each; (path, records)."""
    folder = folder or shared_path(df.sparkSession, "warc-raw")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, squeeze, n, size, number = None, "", None, 0, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{own_name('pages', number, '.warc.gz')}"
                    out, squeeze, n, size = opened(path, "w"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                raw = record(*row)
                out.write(squeeze.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= ROTATE:
                    out.write(squeeze.flush())
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": n}])
                    out, number = None, number + 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n}])

    rows = df.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
    return written(rows.mapInArrow(archives, "path string, records long"), "warc-manifest")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a file, inflated if it is gzip (one member or several)."""
    chunk = source.read(CHUNK)
    if chunk[:2] != b"\x1f\x8b":
        while chunk:
            yield chunk
            chunk = source.read(CHUNK)
        return
    tool, inside = zlib.decompressobj(31), False
    while chunk:
        yield tool.decompress(chunk, 4 * CHUNK)
        inside = not tool.eof
        if tool.eof:
            chunk = tool.unused_data.lstrip(b"\0") or source.read(CHUNK)
            tool = zlib.decompressobj(31)
        else:
            chunk = tool.unconsumed_tail or source.read(CHUNK)
    if inside:
        raise ValueError("the stream ends early")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records (with their ending) and their fields from a stream of bytes."""
    held, at = bytearray(), 0
    for chunk in chunks:
        del held[:at]
        at = 0
        held += chunk
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            named = fields(bytes(held[at:end]))
            stop = end + 4 + int(named["content-length"]) + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop]), named
            at = stop
    if len(held) > at:
        raise ValueError("the last record is cut off")


def normalise(files: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Rewrite each archive of ``files`` (path) record by record; the manifest (path,
    index, records) of the new archives and the folder of their indexes."""
    spark = files.sparkSession
    folder = folder or shared_path(spark, "warc")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = own_name("pages", number, "")
                path, index, number = f"{folder}/data/{name}.warc.gz", f"{folder}/index/{name}.json", number + 1
                at, n = 0, 0
                with opened(source, "r") as f, opened(path, "w") as out, opened(index, "w") as beside:
                    for raw, named in records(inflated(f)):
                        tool = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = tool.compress(raw) + tool.flush()
                        out.write(member)
                        beside.write(json.dumps({
                            "archive": path, "offset": at, "length": len(member),
                            "record_id": named.get("warc-record-id", ""), "record_type": named.get("warc-type", ""),
                            "digest": named.get("warc-payload-digest", "")}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pylist([{"path": path, "index": index, "records": n}])

    paths = files.select("path")
    paths = paths.repartition(max(1, min(files.count(), 20_000)))
    made = written(paths.mapInArrow(rewrite, "path string, index string, records long"), "warc-normalised")
    return made, f"{folder}/index"


def read(made: DataFrame, index: str) -> DataFrame:
    """The records of the archives in the manifest, each fetched by its index entry."""
    spark = made.sparkSession
    n = made.count()
    entries = spark.read.schema(INDEX).json(index) if n else spark.createDataFrame([], INDEX)
    entries = entries.join(made.select(F.col("path").alias("archive")), "archive", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        path, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != path:
                    path, source = archive, opened(archive, "r")
                raw = zlib.decompress(source.read_at(length, offset), 31)
                end = raw.index(b"\r\n\r\n")
                named = fields(raw[:end])
                block = raw[end + 4:end + 4 + int(named["content-length"])]
                page = named["warc-record-id"].removeprefix("<urn:page:").rstrip(">")
                refers = named.get("warc-refers-to", "").removeprefix("<urn:page:").rstrip(">")
                rows.append((
                    int(page) if page else None, named["warc-target-uri"], named["warc-type"],
                    int(refers) if refers else None, int(named["warc-payload-length"]),
                    named["warc-payload-digest"].removeprefix("sha256:"), block[block.index(b"\r\n\r\n") + 4:]))
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    entries = entries.select("archive", "offset", "length")
    if n:
        entries = entries.repartition(min(n, 20_000), "archive").sortWithinPartitions("archive", "offset")
    return entries.mapInArrow(fetch, ROWS)
