"""One file from many tasks: parts beside it, put together behind a header on commit, and named when it is complete.

``df.write.format("strandlake-file").mode("overwrite").option("header", ...).save(path)`` takes rows of one string column; the order of the tasks is the order of the
file, so a sorted table gives a sorted file. Each task writes a part under a name of its own, and only what a successful attempt reports is put together. The
driver copies the parts in small pieces, compares the CRC32 and the length of each with what its task has stated, moves the file to its name in one step, and leaves a
manifest (``<path>.manifest.json``). A failed job leaves neither parts nor file, and an older file as it was. With ``compression`` bgzf the parts are
blocks of BGZF, which are copied as they are.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandlake.sources.stores import deleted, moved, opened

COPIED_BYTES = 8 << 20
#: Bytes of text in a block of BGZF.
BLOCK_BYTES = 0xFF00
#: Fixed value: the empty block that ends a BGZF file.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf(data: bytes) -> bytes:
    """Blocks of BGZF."""
    out = []
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written."""

    partition: int
    name: str
    lines: int
    bytes: int
    crc32: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.header, self.packed = options.get("header", ""), options.get("compression", "none") == "bgzf"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        store, at = opened(self.path)
        self.there = store.get_file_info(at).type != pf.FileType.NotFound
        if self.there and not overwrite:
            raise FileExistsError(f"{self.path} is there; use mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        part = TaskContext.get().partitionId()
        name = f"{self.folder}/part-{part:06}-{uuid.uuid4().hex}"
        store, at = opened(name)
        store.create_dir(opened(self.folder)[1], recursive=True)
        lines = size = crc = 0
        with store.open_output_stream(at) as f:
            for batch in iterator:
                rows = [v for v in batch.column(0).to_pylist() if v is not None]
                if not rows:
                    continue
                raw = ("\n".join(rows) + "\n").encode()
                raw = bgzf(raw) if self.packed else raw
                f.write(raw)
                lines, size, crc = lines + len(rows), size + len(raw), zlib.crc32(raw, crc)
        return Part(part, name, lines, size, crc)

    def commit(self, messages: list[Part | None]) -> None:
        """Puts the parts together; whatever goes wrong, nothing is left but what was there."""
        own = f"{self.path}.new-{uuid.uuid4().hex}"
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        try:
            head = (self.header.rstrip("\n") + "\n").encode() if self.header else b""
            head = bgzf(head) if self.packed else head
            store, at = opened(own)
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            crc, size = zlib.crc32(head), len(head)
            with store.open_output_stream(at) as out:
                out.write(head)
                for m in parts:
                    seen, n = 0, 0
                    with store.open_input_stream(opened(m.name)[1]) as f:
                        while data := f.read(COPIED_BYTES):
                            out.write(data)
                            seen, n, crc = zlib.crc32(data, seen), n + len(data), zlib.crc32(data, crc)
                    if (n, seen) != (m.bytes, m.crc32):
                        raise OSError(f"{m.name} has {n} bytes of CRC32 {seen} in place of {m.bytes} of {m.crc32}")
                    size += n
                if self.packed:
                    out.write(LAST_BLOCK)
                    crc, size = zlib.crc32(LAST_BLOCK, crc), size + len(LAST_BLOCK)
            listing = {"bytes": size, "crc32": crc, "lines": sum(m.lines for m in parts), "parts": [{k: v for k, v in asdict(m).items() if k != "name"} for m in parts]}
            with store.open_output_stream(f"{at}.manifest") as f:
                f.write(json.dumps(listing).encode())
            moved(own, self.path)
            moved(f"{own}.manifest", f"{self.path}.manifest.json")
        finally:
            for left in (own, f"{own}.manifest", self.folder):
                deleted(left)

    def abort(self, messages: list[Part | None]) -> None:
        deleted(self.folder)


class FileSink(DataSource):
    """Rows of one string column as the lines of one file."""

    @classmethod
    def name(cls) -> str:
        return "strandlake-file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("rows of one string column are written")
        return _Writer(dict(self.options), overwrite)


def write_file(lines: DataFrame, path: str, header: str = "", compression: str = "none") -> None:
    """The lines (one string column, in the order of the tasks) as one file."""
    lines.sparkSession.dataSource.register(FileSink)
    lines.write.format("strandlake-file").mode("overwrite").option("header", header).option("compression", compression).save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """partition, lines, bytes, crc32 of the parts of a file, and what all of it has, as its manifest states."""
    rows = spark.read.schema("bytes long, crc32 long, lines long, parts array<struct<partition: int, lines: long, bytes: long, crc32: long>>").json(f"{path}.manifest.json")
    return rows.select(F.col("bytes").alias("file_bytes"), F.col("crc32").alias("file_crc32"), F.col("lines").alias("file_lines"), F.inline("parts"))


def verified(path: str) -> bool:
    """Whether a file still has the length and the CRC32 of its manifest."""
    store, at = opened(path)
    with store.open_input_stream(opened(f"{path}.manifest.json")[1]) as f:
        stated = json.loads(f.read())
    crc = size = 0
    with store.open_input_stream(at) as f:
        while data := f.read(COPIED_BYTES):
            crc, size = zlib.crc32(data, crc), size + len(data)
    return (size, crc) == (stated["bytes"], stated["crc32"])
