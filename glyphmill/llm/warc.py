"""WARC archives: written as one gzip stream each, normalised to a member for every record with an offset index, read back."""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import staged

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Bytes inflated at a time.
INFLATE_BYTES = 1 << 18
#: A payload of more than one in this many rows is common; so fewer than this many are.
COMMON = 1000
LEVEL = 1
GZIP = 31
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive_id long, data binary"
NORMALISED = "archive_id long, data binary, index array<struct<record_id:string,offset:long,length:long>>, complete boolean"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive_id long, offset long, intact boolean"


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    last = record_id.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def _header_value(text: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in text or "") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Payload-Digest: sha1:{b32encode(sha1(payload).digest()).decode()}",
        f"WARC-Block-Digest: sha1:{b32encode(sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}


def _inflate(data: bytes) -> Iterator[bytes]:
    """Inflated bytes of one or more gzip members, a bounded piece at a time; stops where the stream breaks."""
    rest = data
    while rest:
        z = zlib.decompressobj(GZIP)
        while not z.eof:
            try:
                out = z.decompress(rest, INFLATE_BYTES)
            except zlib.error:
                return
            rest = z.unconsumed_tail
            if out:
                yield out
            elif not z.eof and not rest:
                return
        rest = z.unused_data


def split_records(data: bytes) -> Iterator[bytes | None]:
    """Whole records of a gzip stream, inflated once from start to end; None last if it ends within a record."""
    held = bytearray()
    need = -1
    for piece in _inflate(data):
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = _headers(bytes(held[:end])).get("content-length", "")
                if not held.startswith(b"WARC/") or not size.isdigit():
                    yield None
                    return
                need = end + 4 + int(size) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        yield None


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    made, z, parts, size = 0, None, [], 0

    def close() -> pa.RecordBatch:
        nonlocal z, parts, size, made
        data = b"".join([*parts, z.flush()])
        out = pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([data], type=pa.binary())], names=["archive_id", "data"])
        made, z, parts, size = made + 1, None, [], 0
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html, response_id = (batch.column(k)[i].as_py() for k in range(4))
            raw = record(page_id, url, html.encode("utf-8"), response_id, response_id is not None and response_id != page_id)
            z = z or zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            parts.append(z.compress(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield close()
    if z:
        yield close()


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive_id, data): the rows of pages as WARC archives, each one gzip stream.

    Of rows with equal payloads (null html is the empty payload) that with the largest page_id is written as
    response, the others as revisits of it; rows repeated under that page_id are responses too, and where all
    page_ids are null all rows are responses; a null page_id beside others is a revisit. Rows of common payloads get
    their response from a broadcast of bounded size and are spread over all tasks; only the others meet by payload.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    with_sha = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    copied = staged(with_sha.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1"), "warc-copies")
    rows = own.count()
    common = copied.filter(F.col("n") > rows / COMMON).select("sha", F.struct("response_id").alias("common"))  # fewer than COMMON rows
    rare = copied.filter(F.col("n") <= rows / COMMON).select(F.col("sha").alias("key"), F.col("response_id").alias("rare_id"))
    marked = with_sha.join(F.broadcast(common), "sha", "left")
    spread = F.when(F.col("common").isNull(), F.col("sha")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    joined = marked.withColumn("key", spread).join(rare, "key", "left")
    return joined.select("page_id", "url", "html", F.coalesce("common.response_id", "rare_id").alias("response_id")).mapInArrow(_write, ARCHIVES)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index_type = pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        for i in range(batch.num_rows):
            members, index, at, complete = [], [], 0, True
            for raw in split_records(batch.column(1)[i].as_py() or b""):
                if raw is None:
                    complete = False
                    break
                member = _member(raw)
                head = _headers(raw[: raw.find(b"\r\n\r\n")])
                index.append({"record_id": head.get("warc-record-id", ""), "offset": at, "length": len(member)})
                members.append(member)
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([b"".join(members)], type=pa.binary()), pa.array([index], type=index_type), pa.array([complete])],
                names=["archive_id", "data", "index", "complete"],
            )


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Archives (archive_id, data) with every record as a gzip member of its own, and the sidecar index.

    Each stream is inflated once, in bounded pieces. Where a stream breaks off or holds no record, the whole
    records before that stay and complete is false; null or empty data give no records. Repeated archives stay
    repeated; other columns are ignored.
    """
    return archives.select(F.col("archive_id").cast("long").alias("archive_id"), "data").mapInArrow(_normalise, NORMALISED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            archive_id, data, rows = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), []
            for entry in batch.column(2)[i].as_py():
                raw = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], GZIP)
                end = raw.find(b"\r\n\r\n")
                head = _headers(raw[:end])
                block = raw[end + 4 : end + 4 + int(head["content-length"])]
                cut = block.find(b"\r\n\r\n")
                http, payload = _headers(block[:cut]), block[cut + 4 :]
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                size = int(http["content-length"])
                intact = kind == "revisit" or (size == len(payload) and digest == b32encode(sha1(payload).digest()).decode())
                refers = _page_id(head["warc-refers-to"]) if kind == "revisit" else None
                rows.append((_page_id(head["warc-record-id"]), size, digest, kind, refers, archive_id, entry["offset"], intact))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)


def read_records(normalised: DataFrame) -> DataFrame:
    """One row per record, each read from its own member at its indexed offset.

    payload_bytes and payload_digest are those of the full payload, which a revisit names in its headers;
    intact says whether a response's payload has the length and digest that its headers name.
    """
    return normalised.select("archive_id", "data", "index").mapInArrow(_read, RECORDS)


def op7_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = staged(write_archives(pages), "warc")
    records = read_records(staged(normalise_archives(archives), "warc-normalised"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS response_id,
         array_to_string(list_transform(range(40), lambda i: [
           '0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'
         ][strpos('0123456789abcdef', substr(hex, i + 1, 1))]), '') AS bits
  FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
           + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM response_id AND response_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response_id AND response_id IS NOT NULL THEN response_id END AS refers_to
FROM placed
"""
