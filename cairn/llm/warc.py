"""WARC archives: a writer of whole-file gzip streams, a normaliser to one member a record, a reader.

write_archives packs records into monolithic .gz streams, as plain `gzip file.warc` makes them. normalise
inflates each such stream once, rewrites every record as its own gzip member and writes a sidecar index
(.cdx rows: record id, type, offset, length). read_records scans the members; read_at fetches one record by
its index row without inflating anything else.

Files go through Spark's text and binaryFile connectors, so they work in any store and a repeated task
replaces its files. The text sink's row separator is an empty gzip member, which inflates to nothing.

Null html counts as empty, null url leaves the target header out, null page ids are stored as such and count
as smallest. Of rows with equal payloads of at least `least` bytes those with the largest id are responses (all
of them, if that id is repeated) and the others revisits. Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from posixpath import basename

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import drop_path, made_so_far, scratch_path, ship, staged, tidy

EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
PIECE = 8 << 20  # compressed bytes of a normalised archive
STREAM = 16 << 20  # bytes of records in a monolithic stream
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record's bytes: headers, HTTP block, closing line breaks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = None if url is None else re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        *([] if target is None else [f"WARC-Target-URI: {target}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]),
        *([] if page_id is None else [f"X-Page: {page_id}"]), f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 5) -> bytes:
    """A gzip member with no name and no time."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def inflate(raw: bytes | memoryview, chunk: int = 1 << 20, feed: int = 1 << 14) -> Iterator[bytes]:
    """The inflated bytes of all members of a gzip file, in chunks. The file is fed in slices, so its length counts once."""
    view, at = memoryview(raw), 0
    while at < len(view):
        d = zlib.decompressobj(31)
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                if at >= len(view):
                    raise ValueError("the gzip stream ends early")
                part = view[at : at + feed]
                at += len(part)
            if out := d.decompress(part, chunk):
                yield out
        at -= len(d.unused_data)


def headers_of(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated bytes into whole records."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            at = held.find(b"\r\n\r\n")
            if at < 0:
                need = len(held) + 1
                break
            need = at + 8 + int(headers_of(bytes(held[:at]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the last record is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = headers_of(head)
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _write_text(df: DataFrame, path: str, *by: str) -> None:
    """Write the binary column `raw` row by row, followed by empty members, in directories by `by`."""
    out = df.select(F.col("raw").cast("string").alias("value"), *by).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    (out.partitionBy(*by) if by else out).text(path)


def mark_revisits(pages: DataFrame, least: int = 1000, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, html and refers_to (the response's id, for revisits).

    Only digests that occur twice or more are joined; they are staged, so the join can be broadcast when small
    and have its hot digests split by AQE when not.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.when(F.octet_length(body) >= least, F.sha2(body, 256)).alias("digest"))
    groups = staged(keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top"), "warc-digests")
    joined = keyed.join(groups, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(marked: DataFrame, path: str) -> None:
    """Write marked pages as monolithic gzip streams."""
    ship(marked.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()
        deflate, parts, held = None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if deflate is None:
                        deflate, held = zlib.compressobj(4, zlib.DEFLATED, 31), 0
                        parts = [deflate.compress(info)]
                    record = make_record(page_id, url, html.encode(), refers_to)
                    parts.append(deflate.compress(record))
                    held += len(record)
                    if held >= STREAM:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, deflate.flush()])], pa.binary())], names=["raw"])
                        deflate = None
        if deflate is not None:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, deflate.flush()])], pa.binary())], names=["raw"])

    _write_text(marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "raw binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite monolithic archives so that every record is its own member, with a sidecar index of offsets.

    Below `target`, archive=<name>/kind=warc holds the members and archive=<name>/kind=cdx the index, itself
    gzipped: a line for each record with record id, type, offset, length of the member.
    """
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                name, piece = basename(path.as_py()).split(".")[0], 0
                members, lines, at = [], [], 0

                def rows() -> pa.RecordBatch:
                    raw = [b"".join(members), member("".join(lines).encode())]
                    return pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([f"{name}-{piece}"] * 2), pa.array(["warc", "cdx"])], names=["raw", "archive", "kind"])

                for record in records(inflate(content.as_buffer())):
                    headers, _ = parse(record)
                    members.append(member(record))
                    lines.append(f"{headers['warc-record-id']} {headers['warc-type']} {at} {len(members[-1])}\n")
                    at += len(members[-1])
                    if at >= PIECE:
                        yield rows()
                        members, lines, at, piece = [], [], 0, piece + 1
                if members:
                    yield rows()

    _write_text(_files(spark, source).select("path", "content").mapInArrow(run, "raw binary, archive string, kind string"), target, "archive", "kind")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in records(inflate(content.as_buffer())):
                    headers, payload = parse(record)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    response = headers["warc-type"] == "response"
                    stored = base64.b32decode(headers["warc-payload-digest"][5:]).hex()
                    digest = hashlib.sha1(payload).hexdigest() if response else stored
                    if digest != stored:
                        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                    number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                    rows.append((number("x-page"), len(payload) if response else number("x-payload-length"), digest, headers["warc-type"], number("x-refers-to-page")))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return _files(spark, path).where("kind = 'warc'").select("content").mapInArrow(run, schema) if _any(spark, path) else spark.createDataFrame([], schema)


def _any(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds any archive (an empty table makes none)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(x.isDirectory() for x in hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index: archive, record_id, record_type, offset, length."""
    text = spark.read.option("compression", "gzip").format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("kind = 'cdx'")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*batch.columns, strict=True):
                rows = [line.split(" ") for line in b"".join(inflate(content.as_py())).decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive.as_py()] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([int(r[2]) for r in rows], pa.int64()), pa.array([int(r[3]) for r in rows], pa.int64())],
                    names=["archive", "record_id", "record_type", "offset", "length"],
                )

    ship(spark)
    return text.select(F.col("archive").cast("string"), "content").mapInArrow(run, "archive string, record_id string, record_type string, offset bigint, length bigint")


def read_at(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of an archive's bytes by its index row."""
    (record,) = records(inflate(content[offset : offset + length]))
    return parse(record)


def round_trip(pages: DataFrame, least: int = 1000, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise them, drop the monoliths, and read the result back."""
    spark = pages.sparkSession
    mark, raw, path = made_so_far(), scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(mark_revisits(pages, least, id_column, url, html), raw)
    normalise(spark, raw, path)
    drop_path(spark, raw)
    tidy(spark, mark)
    return read_records(spark, path)


