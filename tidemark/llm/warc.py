"""Web archives: writing WARC files from tables of pages, and reading chosen records back.

Method: *index first*. Tasks write their pages as WARC/1.1 records, each a gzip
member of its own, and hand on one index row for each: file, offset, length, URL,
digest, type. The index is a Parquet table, so choosing records is a query on it
that opens no archive. Reading sorts the chosen rows by file and offset within
stretches of a file and joins byte ranges that lie next to each other (or nearly)
into one read. Archives are read and written through ``pyarrow.fs``, by the URI of
their folder, wherever that lies.

Pages with equal payloads (of ``least_bytes`` or more) are stored once: that of the
largest id is a ``response``, the others are ``revisit`` records which refer to
it and hold no payload. They have the HTTP header of the whole payload, whose
Content-Length reading gives back as the payload's size. Who refers to whom is
settled on digests before anything is written: rows meet the heads of their payload
(one row for each distinct payload) on digest *and* id, so a payload that a third
of all pages share is dealt out evenly; digests that many pages share are found by
their counts and handed to all tasks, at most ``HOT`` of them.

A file belongs to one attempt of one task, under a name that no other attempt uses, and
is found only through the index, which Spark commits: what a lost executor leaves
behind is never read. Files are closed at ``FILE_BYTES``, and a page is in memory for
itself, however long.

Edge cases: a null payload is empty; a null URL is left out of the record and null when
read; white space and control characters in URLs are percent-encoded in the record and
whole in the index; a row without an id is lower than all others: it refers to
one with an id where there is one, and is a response otherwise; rows that repeat the
largest id are responses all; an empty table gives an empty index; other columns aren't
looked at.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, remove, session_of, shared_folder

#: Bytes after which a task begins a new file, and compression level of records.
FILE_BYTES, LEVEL = 256_000_000, 4
#: Stretches of a file that are read by one task; gaps that are read over; bytes in one read (a longer record is one by itself).
STRETCH_BYTES, GAP_BYTES, READ_BYTES = 32_000_000, 64_000, 8_000_000
#: Payloads that are handed to all tasks at most, by the number of pages that share them.
HOT = 1000
#: The time in all records, unless another is given (pages of a table needn't have one).
DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, page string, url string, digest string, payload_bytes long, record_type string, refers_to string"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI."""
    # Hadoop writes file:/a for file:///a.
    at = folder.removeprefix("file:").removeprefix("//") if folder.startswith("file:") else folder
    return pafs.FileSystem.from_uri(at if "://" in at else f"file://{at}")


# --- records ---------------------------------------------------------------------


def _identity(page: str | None) -> str:
    return f"<urn:page:{'' if page is None else quote(page, safe='')}>"


def _address(url: str) -> str:
    """A URL without white space and control characters, which a header line can't hold."""
    return "".join(quote(c) if c <= " " or c == "\x7f" or c.isspace() else c for c in url)


def record(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit where ``payload`` is None. ``digest`` is hexadecimal SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_identity(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_address(url)}")
    if payload is None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_identity(refers_to)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def parsed(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """(header fields, size of the whole payload, payload or None for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = memoryview(rest)[: int(fields["content-length"])].tobytes().partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    return fields, size, None if fields["warc-type"] == "revisit" else payload


# --- writing ---------------------------------------------------------------------


def revisits(sized: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(heads, revisits)`` of ``(id, sha, bytes, ...)`` rows: who keeps its payload, and who refers to whom."""
    shared = sized.where(F.col("bytes") >= least_bytes).groupBy(F.col("sha").alias("head_sha"))
    heads = materialise(shared.agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null"))
    common = heads.orderBy(F.desc("n"), "head_sha").limit(HOT)
    rows = sized.where(F.col("bytes") >= least_bytes)
    own = F.col("sha") == F.col("head_sha")
    lower = F.col("id").isNull() | (F.col("id") < F.col("head"))
    first = rows.join(F.broadcast(common), own, "left")
    hot = first.where(F.col("head").isNotNull() & lower)
    cold = first.where("head is null").drop("head", "head_sha", "n")
    cold = cold.join(heads.join(F.broadcast(common.select("head_sha")), "head_sha", "left_anti"), own).where(lower)
    return heads, hot.unionByName(cold).select(*sized.columns, "head")


def write_warc(
    pages: DataFrame, folder: str, least_bytes: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE
) -> DataFrame:
    """Archives of pages in ``folder``/archives and their index in ``folder``/index, which is returned.

    The index has ``(file, offset, length, page, url, digest, payload_bytes, record_type, refers_to)``;
    ids are text in it, as they are in records.
    """
    spark = session_of(pages)
    body = F.coalesce(column(payload).cast("binary"), F.lit(b""))
    every = pages.select(column(key).alias("id"), column(url).alias("url"), body.alias("body"))
    sha, size = F.unhex(F.sha2("body", 256)), F.octet_length("body").cast("long")
    # Payloads stay behind here: the rows are small.
    sized = materialise(every.select("id", "url", sha.alias("sha"), F.sha1("body").alias("digest"), size.alias("bytes")))
    heads, again = revisits(sized, least_bytes)
    again = materialise(again)
    # A page is written as a whole unless it is one of the revisits; digest and id tell which.
    other = again.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("r_id"), F.col("sha").alias("r_sha")).distinct()
    known = every.withColumn("sha", sha).withColumn("text_id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    whole = known.join(other, (F.col("sha") == F.col("r_sha")) & (F.col("text_id") == F.col("r_id")), "left_anti")
    whole = whole.select(
        F.col("id").cast("string").alias("page"), "url", "body", size.alias("bytes"), F.sha1("body").alias("digest"), F.lit(None).cast("string").alias("refers_to")
    )
    short = again.select(
        F.col("id").cast("string").alias("page"), "url", F.lit(None).cast("binary").alias("body"), "bytes", "digest", F.col("head").cast("string").alias("refers_to")
    )
    archives = f"{folder.rstrip('/')}/archives"
    store, path = opened(archives)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(archives)
        out, name, at, rows = None, "", 0, []
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, body, size, digest, refers = (batch.column(c)[k].as_py() for c in range(6))
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, body, size, digest, refers, date)) + packer.flush()
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)  # members are compressed already
                    out.write(member)
                    kind = "response" if refers is None else "revisit"
                    rows.append((name, at, len(member), page, url, digest, size, kind, refers))
                    at += len(member)
                yield from _index_rows(rows)
                rows = []
        finally:
            if out is not None:
                out.close()

    whole.unionByName(short).mapInArrow(run, INDEX).write.parquet(f"{folder.rstrip('/')}/index")
    return read_index(spark, folder)


_ARROW_INDEX = pa.schema(
    [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))]
)


def _index_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_INDEX.types)], schema=_ARROW_INDEX)


# --- reading ---------------------------------------------------------------------


def read_index(spark, folder: str) -> DataFrame:
    """The index of the archives in a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/index")


def joined_ranges(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads ``(file, begin, end, its records' ranges)`` for ranges sorted by file and offset."""
    name, begin, end, held = "", 0, 0, []
    for file, offset, length in ranges:
        near = file == name and 0 <= offset - end <= GAP_BYTES and offset + length - begin <= READ_BYTES
        if held and not near:
            yield name, begin, end, held
            held = []
        if not held:
            name, begin = file, offset
        held.append((offset, length))
        end = offset + length
    if held:
        yield name, begin, end, held


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``(page, url, record_type, refers_to, digest, payload_bytes, payload)`` of the records that index rows name.

    Everything is taken from the records themselves. A revisit has no payload; that of the
    page it refers to is the same. Index rows that repeat give their record once for each.
    """
    session_of(index)
    archives = f"{folder.rstrip('/')}/archives"
    wanted = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / STRETCH_BYTES))
    sorted_rows = wanted.repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(archives)
        ranges = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        name, source = "", None
        try:
            for file, begin, end, held in joined_ranges(ranges):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{path}/{file}")
                data = memoryview(source.read_at(end - begin, begin))
                rows, size = [], 0
                for offset, length in held:
                    rows.append(_row(zlib.decompress(data[offset - begin : offset - begin + length], 31)))
                    size += len(rows[-1][-1] or b"")
                    if size > READ_BYTES:  # records unpack to more than was read
                        yield _record_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _record_rows(rows)
        finally:
            if source is not None:
                source.close()

    return sorted_rows.mapInArrow(
        run, "page string, url string, record_type string, refers_to string, digest string, payload_bytes long, payload binary"
    )


def _row(raw: bytes) -> tuple:
    from urllib.parse import unquote

    fields, size, payload = parsed(raw)
    page = lambda uri: unquote(uri.removeprefix("<urn:page:").removesuffix(">")) or None
    refers = fields.get("warc-refers-to")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    return page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], page(refers) if refers else None, digest, size, payload


_NAMES = ["page", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
_TYPES = [pa.string()] * 5 + [pa.int64(), pa.binary()]


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def round_trip(pages: DataFrame, least_bytes: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` of every page, from archives that are written, read and deleted.

    A response's size and digest are those of the payload that was read; a revisit's are in its headers.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_warc(pages, folder, least_bytes, key, url, payload)
    kind = pages.select(column(key)).schema[0].dataType
    read = read_records(index, folder)
    digest: Column = F.coalesce(F.sha1("payload"), F.col("digest"))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    out = materialise(
        read.select(
            F.col("page").cast(kind).alias(key), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
            F.col("refers_to").cast(kind).alias("refers_to"),
        )
    )
    remove(spark, folder)
    return out


#: Sizes, digests and references straight from the table.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS head FROM p
), r AS (
  SELECT *, payload_bytes >= 1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head AS again FROM h
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN head END AS refers_to
FROM r
"""
