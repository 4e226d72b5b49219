"""WARC archives: records written with Spark's own file writer, read back, segments reassembled by origin, order and
total length verified, chunked transfer framing decoded, revisits resolved."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, shared_root, stage, unstage

#: Fixed by the WARC 1.1 standard.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NO_ID = -(1 << 63)
#: Bytes of records in one file, before compression.
FILE_BYTES = 64 << 20

PARSED = "kind string, record_id string, origin string, segment int, total bigint, page_id bigint, refers_to string, digest string, block binary, payload_bytes bigint, payload_digest string"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, row: int) -> str:
    """A row's own name: rows equal in page_id and payload are records of their own."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}:{row}>"


def page_of(record: str) -> int | None:
    number = record.split(":")[2]
    return int(number) if number else None


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(kind: str, own: str, block: bytes, **fields: object) -> bytes:
    """A record without the line breaks that end it."""
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block


def records(page_id: int | None, row: int, url: str | None, payload: bytes, owner: tuple[int, int] | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit if another page's row (page_id, row) owns the payload, else a response."""
    digest = sha1(payload)
    own = record_id(page_id, digest, row)
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if owner is not None:
        yield record("revisit", own, HTTP, Target_URI=uri, Payload_Digest=f"sha1:{digest}", Profile=PROFILE, Refers_To=record_id(owner[0], digest, owner[1]))
        return
    block = HTTP + chunked(payload, chunk)
    if len(block) <= segment:
        yield record("response", own, block, Target_URI=uri, Payload_Digest=f"sha1:{digest}")
        return
    n = -(-len(block) // segment)
    for k in range(1, n + 1):
        part = block[(k - 1) * segment : k * segment]
        if k == 1:
            yield record("response", own, part, Target_URI=uri, Payload_Digest=f"sha1:{digest}", Segment_Number=1)
        else:
            total = len(block) if k == n else None
            yield record("continuation", f"{own[:-1]}:{k}>", part, Target_URI=uri, Segment_Origin_ID=own, Segment_Number=k, Segment_Total_Length=total)


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10) -> None:
    """Write a record for each page: of pages with equal payloads those with the largest page_id are responses, the
    others revisit it. Pages are written once with an arrival number; digests are shuffled alone, and the pages then meet
    the list of revisits by that number, which no two rows share."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID))
    held = pages.select(own.alias("_id"), F.monotonically_increasing_id().alias("_at"), F.sha2(body, 256).alias("_h"), F.octet_length(body).cast("bigint").alias("_n"), F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("html"))
    held = stage(held, "warc-pages")
    known = held.select("_id", "_at", "_h")
    total, size = held.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    owners = known.groupBy("_h").agg(F.count("*").alias("_copies"), F.max(F.struct("_id", "_at")).alias("_owner")).filter("_copies > 1")
    revisits = stage(hot_join(known, stage(owners, "warc-owners"), "_h", "_copies", total).filter("_id < _owner._id").select("_at", "_owner"), "warc-revisits")
    rows = held.join(revisits.hint("merge"), "_at", "left").select("page_id", "_at", "url", "html", F.col("_owner._id").alias("_owner"), F.col("_owner._at").alias("_owner_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page, at, url, html, owner, owner_at in zip(*(batch.column(i) for i in range(6)), strict=True):
                owned = (owner.as_py(), owner_at.as_py()) if owner.is_valid else None
                for one in records(page.as_py(), at.as_py(), url.as_py(), html.as_py(), owned, segment_bytes, chunk_bytes):
                    held.append(one)
                    size += len(one)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    each = max(1, FILE_BYTES * total // max(size, 1))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", each).text(folder)
    unstage(held, revisits)


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := file.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) != size or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives (gzip or plain) in a folder. Blocks of segmented records are kept, others decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                rows, size = [], 0
                for head, block in parse(file):
                    kind, own = head["warc-type"], head["warc-record-id"]
                    segment = int(head["warc-segment-number"]) if "warc-segment-number" in head else None
                    total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
                    payload = payload_of(block) if kind == "response" and segment is None else None
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((kind, own, head.get("warc-segment-origin-id", own), segment, total, page_of(own), head.get("warc-refers-to"), digest, block if segment else None, None if payload is None else len(payload), None if payload is None else sha1(payload)))
                    size += len(block) if segment else 200
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, PARSED)


def assemble(parts: list[dict]) -> tuple[int, bytes]:
    """How often the record occurs, and its block: segments in order, complete, and as long as the last one says."""
    by_number: dict[int, dict] = {}
    for part in parts:
        by_number.setdefault(part["segment"], part)
    order = sorted(by_number)
    block = b"".join(by_number[k]["block"] for k in order)
    if order != list(range(1, len(order) + 1)) or by_number[order[-1]]["total"] != len(block):
        raise ValueError(f"segments {order[:20]} hold {len(block)} bytes; the last one says {by_number[order[-1]]['total']}")
    return sum(part["segment"] == 1 for part in parts), block


def reassembled(parsed: DataFrame) -> DataFrame:
    """Payload length and digest of each segmented record. A group is the segments of one record, and each row that
    write_archives() was given has a record of its own, so it's no larger than one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                times, block = assemble(parts.as_py())
                payload = payload_of(block)
                rows += [{"record_id": origin, "page_id": page_of(origin), "payload_bytes": len(payload), "payload_digest": sha1(payload)}] * times
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

    groups = parsed.filter("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    return groups.mapInArrow(run, "record_id string, page_id bigint, payload_bytes bigint, payload_digest string")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page in the archives.

    Null html is an empty payload; a null page_id stays null and counts as the smallest; pages equal in page_id and
    payload each keep a row; of such rows with the largest id all are responses. Broken archives (missing segments, a
    wrong total, a cut record, a revisit whose response isn't there) raise an error. An empty folder's table gives no rows; only page_id, url and html of the
    pages are read, so further columns don't matter.
    """
    parsed = stage(read_archives(spark, folder), "warc-parsed")
    whole = parsed.filter("kind = 'response' and segment is null").select("record_id", "page_id", "payload_bytes", "payload_digest")
    responses = stage(whole.unionByName(reassembled(parsed)), "warc-responses")
    revisits = parsed.filter("kind = 'revisit'").select("page_id", "refers_to", F.col("digest").alias("payload_digest"))
    sought = revisits.groupBy("refers_to").count()
    # the response that is referred to has the payload's length
    lengths = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", F.col("page_id").alias("_response")).dropDuplicates(["refers_to"])
    missing = F.raise_error(F.concat(F.lit("no response in the archives for the revisit of "), "refers_to"))
    found = stage(sought.join(lengths, "refers_to", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", missing.cast("bigint"))), "warc-referred")
    met = hot_join(revisits, found, "refers_to", "count", parsed.count())
    out = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return out.unionByName(met.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("_response").alias("refers_to")))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE CAST(owner AS BIGINT) END AS refers_to
FROM o
"""


def op3_segments(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/lanewise/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return payloads(spark, folder)
