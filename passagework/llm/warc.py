"""WARC records as a chunked record table, written, deduplicated by payload and read back.

An archive is a table of (archive, record_id, chunk_no, last, data, digest_so_far): the bytes of a record, header
first, cut into chunks of at most ``CHUNK`` bytes, so that neither the writer nor the reader holds a record. The
digest of a chunk's row is the SHA-256 of the payload up to and with that chunk; a reader checks each against its
own running digest and so finds a lost, repeated or damaged chunk where it happens.

Records with equal payloads of at least ``MIN_REVISIT`` bytes have one response, that of the smallest page_id; the
others are revisits, which carry headers only. Smaller payloads are always responses.

Nulls and odd cases: a null payload is empty; a null url gives a record without a target. A null page_id is kept
and is a response of its own. Rows that repeat a page_id each give a record; of equal payloads with the same
smallest page_id, all are responses. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_REVISIT = 100
#: Digests of repeated payloads are broadcast up to so many (some 100 bytes each), else joined by a shuffle.
BROADCAST_DIGESTS = 100_000
CHUNK = 1 << 16
#: Bytes of chunk rows held before they are sent on.
HELD = 1 << 22
CHUNKS = "archive int, record_id string, page_id long, chunk_no int, last boolean, data binary, digest_so_far string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response) of each row."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    given = given.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = given.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = scratch.save(first, "repeated")
    small = first.count() <= BROADCAST_DIGESTS
    joined = given.join(F.broadcast(first) if small else first, "payload_digest", "left")
    return joined.select("page_id", "url", F.when(F.col("first_id") < F.col("page_id"), F.lit(None)).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))


def header(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, record_id: str) -> bytes:
    """A WARC/1.1 header; a revisit's Content-Length is 0 and its payload's size has a field of its own."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None and ("\r" in url or "\n" in url):
        # a line can't hold it as it is
        lines += ["WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"), "Target-URI-Escaped: yes"]
    elif url is not None:
        lines.append("WARC-Target-URI: " + url)
    if refers_to is not None:
        # the response's record may be in any archive; it is the one with this Page-ID
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if refers_to is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_chunks(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Chunk rows of planned records. A payload is cut in place; no record is built whole."""
    from pyspark import TaskContext

    archive, n = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            page_id, url, size, digest, refers = (column[c][i].as_py() for c in ("page_id", "url", "payload_bytes", "payload_digest", "refers_to"))
            record_id = f"urn:warc:{archive}:{n}"
            n += 1
            head = header(page_id, url, size, digest, refers, record_id)
            payload = memoryview(column["payload"][i].as_buffer()) if refers is None and size else memoryview(b"")
            running = hashlib.sha256()
            rows.append((archive, record_id, page_id, 0, not len(payload), head if len(payload) else head + b"\r\n\r\n", running.hexdigest()))
            held += len(head)
            if held > HELD or len(rows) >= 4096:  # records without a payload too
                yield out()
                rows, held = [], 0
            for k, at in enumerate(range(0, len(payload), chunk), 1):
                piece = payload[at : at + chunk]
                running.update(piece)
                last = at + chunk >= len(payload)
                rows.append((archive, record_id, page_id, k, last, bytes(piece) + b"\r\n\r\n" * last, running.hexdigest()))
                held += len(piece)
                if held > HELD or len(rows) >= 4096:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of chunk rows sorted by record and chunk number; a broken record raises."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    record, fields, expect, running, got = None, {}, 0, hashlib.sha256(), 0
    for batch in batches:
        ids, numbers, last, data, so_far = (batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "chunk_no", "last", "data", "digest_so_far"))
        for i in range(batch.num_rows):
            record_id, number, ends = ids[i].as_py(), numbers[i].as_py(), last[i].as_py()
            piece = memoryview(data[i].as_buffer())
            if number == 0:
                if record is not None:
                    raise ValueError(f"{record} has no last chunk")
                record, expect, running, got = record_id, 0, hashlib.sha256(), 0
                head = bytes(piece).partition(b"\r\n\r\n")[0].decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in head[1:])
                if head[0] != "WARC/1.1" or fields["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"{record_id} has no WARC header")
            else:
                body = piece[: len(piece) - 4] if ends else piece
                running.update(body)
                got += len(body)
            if record_id != record or number != expect or running.hexdigest() != so_far[i].as_py():
                raise ValueError(f"{record_id}: chunk {number} is missing, repeated or damaged")
            expect += 1
            if ends:
                size, digest, kind = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response":
                    if got != size or running.hexdigest() != digest or int(fields["Content-Length"]) != got:
                        raise ValueError(f"{record_id}: the payload isn't what the header says")
                    size, digest = got, running.hexdigest()
                refers, url = fields.get("Refers-To-Page-ID"), fields.get("WARC-Target-URI")
                if "Target-URI-Escaped" in fields:
                    url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                rows.append((int(fields["Page-ID"]) if "Page-ID" in fields else None, url, size, digest, kind, int(refers) if refers else None))
                record = None
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
    if record is not None:
        raise ValueError(f"{record} has no last chunk")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archives(pages: DataFrame, scratch: Scratch, name: str = "warc", min_revisit: int = MIN_REVISIT, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of ``pages``, in the shared folder."""
    return scratch.save(plan_records(pages, scratch, min_revisit).mapInArrow(lambda it: write_chunks(it, chunk), CHUNKS), name)


def read_archives(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table. A record's chunks meet in one task, in order, a batch of chunks at a time."""
    return chunks.drop("page_id", "archive").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(read_chunks, RECORDS)


def pages_to_warc(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read from the archives."""
    return read_archives(write_archives(pages, scratch)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
