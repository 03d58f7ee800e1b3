"""WARC archives: segmented records with chunked transfer framing, written and read back.

A page is one record.  A record whose block is longer than SEGMENT bytes is
written as a first segment and continuation records that name its id.  Reading
groups the segments by that id, orders them by segment number, verifies the total
length and decodes the chunked framing.  A payload seen before is a revisit.

Every record is a gzip member of its own, and files are members one after the other; each task
writes its own through Spark's text writer.  A member ends in the size of its record, whose highest byte
is 0 for records under 16 MB: that byte is the writer's line separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import bounded_batches, scratch_dir, small, store

#: Bytes of a segment's block, of a transfer chunk, and records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 32_768, 8_192, 1_024
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """`payload` in chunked transfer framing."""
    parts = [payload[at : at + CHUNK] for at in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """What `chunked` framed; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked framing without an end")
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk of another length than it says")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def member(record: bytes) -> list[bytes]:
    """`record` as gzip members without their last byte, which is 0; one member but for records of 8 MB and more."""
    out = []
    for at in range(0, max(len(record), 1), 8_000_000):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append((packer.compress(record[at : at + 8_000_000]) + packer.flush())[:-1])
    return out


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members that stand one after the other, piece by piece; a broken end or anything else between them raises."""
    view, opened = memoryview(data), None
    for at in range(0, len(view), 1 << 16):
        left = bytes(view[at : at + (1 << 16)])
        while left:
            opened = opened or zlib.decompressobj(31)
            try:
                piece = opened.decompress(left)
            except zlib.error as wrong:
                raise ValueError("not a gzip member") from wrong
            left = opened.unused_data
            if opened.eof:
                opened = None
            if piece:
                yield piece
    if opened is not None:
        raise ValueError("a gzip member without an end")


def _head(kind: str, record_id: str, length: int, more: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in more if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, serial: int) -> Iterator[bytes]:
    """The records of a page."""
    record_id = str(uuid.UUID(bytes=hashlib.md5(f"{serial}".encode()).digest()))
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    page = None if page_id is None else str(page_id)
    about = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Page-Id", page)]
    if revisit:
        block = _HTTP
        about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-Id", None if refers_to is None else str(refers_to))]
        yield _head("revisit", record_id, len(block), [*about, ("Content-Type", "application/http; msgtype=response")]) + block + b"\r\n\r\n"
        return
    block = _HTTP + chunked(payload)
    about.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= SEGMENT:
        yield _head("response", record_id, len(block), about) + block + b"\r\n\r\n"
        return
    for k, at in enumerate(range(0, len(block), SEGMENT), 1):
        part = block[at : at + SEGMENT]
        last = at + SEGMENT >= len(block)
        if k == 1:
            yield _head("response", record_id, len(part), [*about, ("WARC-Segment-Number", "1")]) + part + b"\r\n\r\n"
        else:
            own = str(uuid.UUID(bytes=hashlib.md5(f"{serial}/{k}".encode()).digest()))
            total = str(len(block)) if last else None
            yield _head("continuation", own, len(part), [("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)]) + part + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write the pages as archives in `folder`.

    Of pages with equal payloads of at least `least` bytes the smallest
    page_id is a response and the others revisit it; rows that repeat that id are
    responses as well, and so are all rows of payloads whose ids are all null.
    A null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    many = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    rows = rows.join(small(store(many)), "sha", "left")
    rows = rows.select("page_id", "url", "payload", "first", F.expr("first IS NOT NULL AND NOT (page_id <=> first)").alias("revisit"), F.monotonically_increasing_id().alias("serial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, body, first, revisit, serial in zip(*(c for c in batch.columns), strict=True):
                body = body.as_py()
                for record in records(page_id.as_py(), url.as_py(), body, digest(body), first.as_py(), revisit.as_py(), serial.as_py()):
                    out += member(record)
                    held += len(record)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a stream; only the record that is being read is held."""
    held = bytearray()
    ended = False

    def fill(wanted: int) -> bool:
        nonlocal ended
        while len(held) < wanted and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= wanted

    while fill(1):
        looked, end = 0, -1
        while end < 0:
            end = held.find(b"\r\n\r\n", max(looked - 3, 0))
            looked = len(held)
            if end < 0 and not fill(looked + 1):
                raise ValueError("a record without an end of its head")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        n = int(head["content-length"])
        if not fill(end + 8 + n) or held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record of another length than it says")
        yield head, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 8 + n]


_FIELDS = "record_id string, kind string, page_id long, refers_to long, declared string, segment int, total_length long, block binary"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload) per record of the archives in `folder`.

    Files hold gzip members, any number of records in each.  Segments are reassembled; a wrong number, length, framing or digest raises.
    A revisit has no payload and keeps the digest that it declares.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda head, key: int(head[key]) if key in head else None
        schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for head, block in _parsed(unpacked(content.as_py())):
                    out.append((head.get("warc-segment-origin-id", head["warc-record-id"]), head["warc-type"], number(head, "page-id"), number(head, "refers-to-page-id"), head.get("warc-payload-digest", "")[5:], number(head, "warc-segment-number"), number(head, "warc-segment-total-length"), block))
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        if pdf["segment"].tolist() != list(range(1, len(pdf) + 1)):
            raise ValueError(f"segments of {pdf['record_id'].iloc[0]} are missing or repeated")
        block = b"".join(pdf["block"])
        if pd.isna(pdf["total_length"].iloc[-1]) or len(block) != int(pdf["total_length"].iloc[-1]):
            raise ValueError(f"the segments of {pdf['record_id'].iloc[0]} are not of their total length")
        whole = pdf.iloc[:1].copy()
        whole["block"] = [block]
        return whole

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, declared = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            payloads: list[bytes | None] = []
            for kind, said, block in zip(kinds, declared, batch.column(7), strict=True):
                if kind == "revisit":
                    payloads.append(None)
                    continue
                _, _, body = block.as_py().partition(b"\r\n\r\n")
                payloads.append(dechunked(body))
                if digest(payloads[-1]) != said:
                    raise ValueError("a payload of another digest than its record says")
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), batch.column(3), batch.column(4), pa.array(payloads, pa.binary())], ["page_id", "record_type", "refers_to", "payload_digest", "payload"])

    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(parse, _FIELDS)
    segmented = parsed.where("segment IS NOT NULL").groupBy("record_id").applyInPandas(joined, _FIELDS)
    whole = parsed.where("segment IS NULL").unionByName(segmented)
    return whole.mapInArrow(decode, "page_id long, record_type string, refers_to long, payload_digest string, payload binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the pages after a round trip through archives.

    One row per row of `pages`.  A revisit takes its length from the response
    it refers to.  A payload of any length comes back whole, in segments; null html and null ids are written as they are.  An empty table gives an empty one; columns other than
    page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = f"{scratch_dir(spark).rstrip('/')}/lodestone/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    read = read_archives(spark, folder)
    read = store(read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
    responses = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    revisits = read.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("of_response"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
