"""WARC as a chunked record table: long payloads are rows of (archive, record, chunk), never one long value.

Writing: each task makes one archive. A record's header is in its first chunk; every chunk carries the SHA-256 of the
payload up to its own end, so a reader knows at any chunk whether it is still right. A chunk that is lost, repeated or out of place is an error,
as is a record without its end. The bytes of an archive's chunks
in order are a valid WARC 1.1 file. Reading parses the chunks back: a record of one chunk is read where it lies, and only
the chunks of longer records are shuffled, by record and in order, and hashed one by one.

Of records with equal payloads of at least ``SMALL`` bytes, the one with the smallest page_id is a response and the others
revisit it. Rows that repeat that page_id with that payload are responses too; a null page_id is never the smallest, and where
all ids are null all are responses. A null html is empty, a null url is replaced by the record's own id, and control characters in a url are escaped.
Ids are percent-encoded in headers, so ids of any text come back. The html value itself is one Spark string; its chunk rows, and whatever reads them, never hold a
whole record. An empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import staged

SMALL = 100
CHUNK_BYTES = 64 << 10
BROADCAST_BYTES = 64 << 20
#: Bytes of chunks in one Arrow batch.
BATCH_BYTES = 4 << 20
CHUNKS = "archive int, record long, chunk int, last boolean, digest string, bytes binary"
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
#: Fixed value: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:strandlake:page:"


def _header(kind: str, page: str, url: str, digest: str, size: int, refers: str | None, at: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{page}>"), ("WARC-Date", at), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{URN}{quote(refers, safe='')}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(http) + (size if kind == "response" else 0))))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def planned(pages: DataFrame) -> DataFrame:
    """page_id (as text), url, html, digest and the page that a revisit refers to.

    Only digests and ids are grouped. The texts are shuffled only if the repeated digests are too many to broadcast.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("page"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    light = rows.filter(F.octet_length("html") >= SMALL).select("digest", "page_id")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = staged(firsts.select(F.col("digest").alias("key"), "first"), "firsts")
    side = F.broadcast(firsts) if firsts.count() * 100 <= BROADCAST_BYTES else firsts
    joined = rows.join(side, rows.digest == F.col("key"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return joined.select("page", "url", "html", "digest", refers.alias("refers"))


def write(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The chunk table of the pages' archives, in the shared folder."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record = TaskContext.get().partitionId(), 0
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "record", "chunk", "last", "digest", "bytes"])

        for batch in batches:
            for page, url, html, digest, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                payload = memoryview(html.as_buffer())
                own = f"{URN}{quote(page, safe='')}" if page is not None else f"urn:strandlake:row:{archive}-{record}"
                lead = _header("revisit" if refers is not None else "response", own, _clean(url) if url is not None else own, digest, len(payload), refers, at)
                body = payload if refers is None else payload[:0]
                seen, done, chunk, last = hashlib.sha256(), 0, 0, False
                while not last:
                    take = body[done : done + max(1, chunk_bytes - len(lead))]
                    seen.update(take)
                    done += len(take)
                    last = done == len(body)
                    data = b"".join((lead, take, b"\r\n\r\n" if last else b""))
                    out.append((archive, record, chunk, last, seen.hexdigest(), data))
                    held, lead, chunk = held + len(data), b"", chunk + 1
                    if held >= BATCH_BYTES:
                        yield flush()
                        out, held = [], 0
                record += 1
        if out:
            yield flush()

    return staged(planned(pages).mapInArrow(apply, CHUNKS), "warc")


class Reader:
    """Parses a record from its chunks; holds no more than one chunk."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.seen = hashlib.sha256()
        self.size = self.left = 0

    def feed(self, chunk: int, last: bool, digest: str, data: memoryview) -> tuple[str | None, int, str, str, str | None] | None:
        if chunk == 0:
            raw = bytes(data)
            head = raw.index(b"\r\n\r\n") + 4
            lines = raw[: head - 4].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            body = raw.index(b"\r\n\r\n", head) + 4
            http = dict(line.split(": ", 1) for line in raw[head : body - 4].decode().split("\r\n")[1:])
            self.size, self.left = int(http["Content-Length"]), int(self.fields["Content-Length"]) - (body - head)
            data = memoryview(raw)[body:]
        take = data[: self.left]
        self.seen.update(take)
        self.left -= len(take)
        if self.seen.hexdigest() != digest:
            raise ValueError(f"{self.fields['WARC-Record-ID']}: chunk {chunk} is damaged")
        if not last:
            return None
        kind, stated = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.left or bytes(data[len(take) :]) != b"\r\n\r\n" or kind == "response" and digest != stated:
            raise ValueError(f"{self.fields['WARC-Record-ID']}: the record is damaged")
        page = self.fields["WARC-Record-ID"][1:-1]
        refers = unquote(self.fields.get("WARC-Refers-To", "<>")[1:-1].removeprefix(URN))
        return unquote(page.removeprefix(URN)) if page.startswith(URN) else None, self.size, stated, kind, refers or None


def read(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a chunk table (ids as text)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, record, due = Reader(), None, 0  # the record that is read and the chunk that it must go on with; 0 is none
        for batch in batches:
            out = []
            for archive, number, chunk, last, digest, data in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if due and record != (archive, number):
                    raise ValueError(f"archive {record[0]}, record {record[1]}: chunk {due} is missing")
                if chunk != due:
                    raise ValueError(f"archive {archive}, record {number}: chunk {chunk} in place of {due}")
                if chunk == 0:
                    reader, record = Reader(), (archive, number)
                found = reader.feed(chunk, last, digest, memoryview(data.as_buffer()))
                due = 0 if last else chunk + 1
                if found:
                    out.append(found)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if due:
            raise ValueError(f"archive {record[0]}, record {record[1]}: chunk {due} is missing")

    whole = F.expr("chunk = 0 AND last")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = chunks.filter(~whole).repartition(parts, "archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return chunks.filter(whole).mapInArrow(apply, READ).union(long.mapInArrow(apply, READ))


def archive_stream(chunks: DataFrame, archive: int) -> Iterator[bytes]:
    """The bytes of one archive, chunk by chunk, as a WARC file has them."""
    for row in chunks.filter(F.col("archive") == archive).orderBy("record", "chunk").select("bytes").toLocalIterator():
        yield bytes(row["bytes"])


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the pages' archives, reads them back, and returns what was read, one row for each page."""
    kind = pages.schema["page_id"].dataType
    rows = read(write(pages, chunk_bytes))
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
