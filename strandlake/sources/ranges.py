"""FASTA and FASTQ in ranges of bytes, as a batch source and as a stream.

Plain files and those of block gzip (BGZF) are cut into ranges, and a record belongs to the range in which its header line begins. A range
finds the first of its own: by '>' in FASTA, in FASTQ by the phase of the four lines (a line with '@' whose second next has '+'; a quality that
begins with '@' never has, as a sequence follows its name). Other gzip files are one range. What is asked of ``source``, ``contig`` and ``length``
is asked in the reader, where ``spark.sql.python.filterPushdown.enabled`` allows it; files that ``source`` rules out are not opened.

As a stream, files are read once, when they have arrived. A log in a shared folder gives each discovery a number: the ranges that it found. An
offset is such a number, so a batch that is replayed after a failure reads the same ranges, and a restart goes on behind the last one. A file must be
complete when it gets its name (written elsewhere and moved), as with Spark's own file stream.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from strandlake.sources.stores import listed, opened

SCHEMA = "source string, contig string, seq string, quality string, length long, ordinal long"
#: Bytes of a range, of one read, and of an Arrow batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
#: How a block of BGZF begins (gzip with an extra field BC of two bytes), and the longest such block.
GZIP, BLOCK, LONGEST = b"\x1f\x8b", b"\x1f\x8b\x08\x04", 1 << 16


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes of a file: ``kind`` is plain, bgzf or gzip."""

    path: str
    start: int
    end: int
    size: int
    kind: str

    @property
    def value(self) -> str:
        return self.path


def _block_size(head: bytes) -> int:
    """The bytes of the BGZF block that begins with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != BLOCK:
        return 0
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def ranges(files: list[tuple[str, int]], most: int = RANGE_BYTES) -> list[Range]:
    """The ranges of files; of names that end in .gz or .bgz the first bytes tell the kind."""
    out = []
    for path, size in files:
        kind = "plain"
        if path.endswith((".gz", ".bgz")) and size:
            store, at = opened(path)
            with store.open_input_file(at) as f:
                head = f.read(64)
            kind = "bgzf" if _block_size(head) else "gzip" if head[:2] == GZIP else "plain"
        step = size if kind == "gzip" else most
        out += [Range(path, a, min(size, a + step), size, kind) for a in range(0, size, max(1, step))]
    return out


def _plain(f: pa.NativeFile, r: Range) -> Iterator[tuple[bytes, bool, int]]:
    at = r.start
    f.seek(at)
    while at < r.size:
        data = f.read(min(READ_BYTES, r.end - at) if at < r.end else READ_BYTES // 16)
        if not data:
            raise OSError(f"{r.path} ends at {at} in place of {r.size}")
        yield data, at < r.end, at
        at += len(data)


def _gzip(f: pa.NativeFile, r: Range) -> Iterator[tuple[bytes, bool, int]]:
    unpack, at, rest = zlib.decompressobj(31), 0, b""
    while True:
        raw = rest or f.read(READ_BYTES)
        if not raw:
            if at and not unpack.eof:
                raise OSError(f"{r.path} ends inside a gzip member")
            return
        if unpack.eof:  # the next member
            unpack = zlib.decompressobj(31)
        data = unpack.decompress(raw)
        rest = unpack.unused_data
        if data:
            yield data, True, at
        at += len(data)


def _bgzf(f: pa.NativeFile, r: Range) -> Iterator[tuple[bytes, bool, int]]:
    at = r.start
    if at:  # the first block that begins in the range, and which another one or the end follows
        f.seek(at)
        near = f.read(2 * LONGEST + 64)
        k = near.find(BLOCK)
        while k >= 0:
            n = _block_size(near[k : k + 64])
            if n and (at + k + n == r.size or near[k + n : k + n + 4] == BLOCK):
                break
            k = near.find(BLOCK, k + 1)
        if k < 0 or at + k >= r.end:
            return
        at += k
    while at < r.size:
        f.seek(at)
        raw = f.read(LONGEST + 64)
        n = _block_size(raw[:64])
        if not n or len(raw) < n:
            raise OSError(f"{r.path} has no block at {at}")
        data = zlib.decompress(raw[:n], 31)
        if data:
            yield data, at < r.end, at << 16
        at += n


def lines(r: Range) -> Iterator[tuple[bytes, int, bool]]:
    """The lines from a range's start on, up to as many behind its end as are asked: each without its end, its place, and whether it is the range's own.

    A line that begins exactly at the end belongs to the range too, and so the one at the start to the range before.
    """
    store, path = opened(r.path)
    with store.open_input_file(path) as f:
        held: list[bytes] = []
        place, own, fresh, after = 0, False, True, r.start == 0  # fresh: a line begins with the next piece; after: that line is the range's own
        for data, inside, base in {"plain": _plain, "gzip": _gzip, "bgzf": _bgzf}[r.kind](f, r):
            at = 0
            if fresh:
                place, own, fresh = base, after, False
            while (end := data.find(b"\n", at)) >= 0:
                yield b"".join([*held, data[at:end]]).removesuffix(b"\r"), place, own
                held, at = [], end + 1
                place, own = base + at, inside
            if at < len(data):
                held.append(data[at:])
            else:
                fresh, after = True, inside
        if held:
            yield b"".join(held).removesuffix(b"\r"), place, own


def _name(line: bytes) -> str:
    return (line[1:].decode("utf-8", "replace").split() or [""])[0]


def _fasta(rows: Iterator[tuple[bytes, int, bool]]) -> Iterator[tuple[str, str, None, int]]:
    name, parts, place = None, [], 0
    for number, (line, at, own) in enumerate(rows):
        beyond = number and not own  # a line behind the range ends the search, but not a record
        if line.startswith(b">"):
            if name and parts:
                yield name, b"".join(parts).decode("ascii", "replace"), None, place
            name, parts, place = (_name(line), [], at) if own else (None, [], 0)
        elif name is not None and (stripped := line.strip()):
            parts.append(stripped)
        if beyond and name is None:
            return
    if name and parts:
        yield name, b"".join(parts).decode("ascii", "replace"), None, place


def _fastq(rows: Iterator[tuple[bytes, int, bool]], whole: bool) -> Iterator[tuple[str, str, str, int]]:
    if not whole:  # the first line belongs to the range before; the phase shows within six more
        next(rows, None)
        ahead = [x for _, x in zip(range(6), rows)]
        start = next((k for k in range(len(ahead) - 2) if ahead[k][0].startswith(b"@") and ahead[k + 2][0].startswith(b"+")), None)
        if start is None:
            return
        rows = (x for part in (ahead[start:], rows) for x in part)
    for line, at, own in rows:
        if whole and not line and at == 0:
            continue
        if not own:
            return
        seq, _, quality = (next(rows, (b"", 0, False))[0] for _ in range(3))
        if seq and (name := _name(line)):
            yield name, seq.decode("ascii", "replace"), quality.decode("latin-1"), at


def records(r: Range) -> Iterator[tuple[str, str, str | None, int]]:
    """name, sequence, quality and place of the records of a range; those without a name or a sequence are left out."""
    head = b""
    for line, _, _ in lines(Range(r.path, 0, r.size, r.size, r.kind)):
        head = line
        if line:
            break
    if head.startswith(b"@"):
        rows = lines(r)
        if r.start == 0:  # blank lines may lead
            rows = _without_leading_blanks(rows)
        return _fastq(rows, r.start == 0)
    return _fasta(lines(r))


def _without_leading_blanks(rows: Iterator[tuple[bytes, int, bool]]) -> Iterator[tuple[bytes, int, bool]]:
    leading = True
    for row in rows:
        leading = leading and not row[0]
        if not leading:
            yield row


#: What a filter asks of a value.
ASKED = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x),
}


@dataclass
class Filters:
    """Conditions on source, contig and length that the reader takes over."""

    taken: list[tuple[str, type, object]] = field(default_factory=list)

    def push(self, filters: list) -> Iterator:
        for f in filters:
            at = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in ASKED and at in ("source", "contig", "length"):
                self.taken.append((at, type(f), f.value))
            elif not (isinstance(f, IsNotNull) and at in ("source", "contig", "length", "seq")):  # these never are null
                yield f

    def hold(self, column: str, value: object) -> bool:
        return all(ASKED[kind](value, x) for at, kind, x in self.taken if at == column)


def _source(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def batches(r: Range, filters: Filters) -> Iterator[pa.RecordBatch]:
    """The records of a range as Arrow batches."""
    kinds = [pa.string()] * 4 + [pa.int64()] * 2
    rows, size, source = [], 0, _source(r.path)

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["source", "contig", "seq", "quality", "length", "ordinal"])

    for name, seq, quality, at in records(r):
        if filters.hold("contig", name) and filters.hold("length", len(seq)):
            rows.append((source, name, seq, quality, len(seq), at))
            size += 2 * len(seq)
        if size > BATCH_BYTES or len(rows) == 10_000:
            yield taken()
            rows, size = [], 0
    if rows:
        yield taken()


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.filters = path, most, Filters()

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  Spark's name
        return self.filters.push(filters)

    def partitions(self) -> list[Range]:
        files = [f for f in listed(self.path) if self.filters.hold("source", _source(f[0]))]
        return ranges(files, self.most) or [Range("", 0, 0, 0, "none")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.filters) if partition.size else iter(())


class Log:
    """Numbered discoveries of files in a shared folder: a file of JSON for each, which gets its name when it is complete."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        store, at = opened(self.folder)
        store.create_dir(at, recursive=True)
        self.known: set[str] = set()
        self.last = 0
        for path, _ in listed(f"{self.folder}/entry-*.json"):
            self.known |= {e[0] for e in self._read(path)}
            self.last = max(self.last, int(path.rsplit("-", 1)[-1].removesuffix(".json")))

    def _read(self, path: str) -> list[list]:
        store, at = opened(path)
        with store.open_input_stream(at) as f:
            return json.loads(f.read())

    def entry(self, number: int) -> list[list]:
        """(path, bytes) of one discovery."""
        return self._read(f"{self.folder}/entry-{number:09}.json")

    def discover(self, path: str) -> int:
        """Notes the files that are new, if any, and gives the last number."""
        new = [f for f in listed(path) if f[0] not in self.known]
        if new:
            store, at = opened(self.folder)
            own = f"{at}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(json.dumps(new).encode())
            store.move(own, f"{at}/entry-{self.last + 1:09}.json")
            self.last += 1
            self.known |= {f[0] for f in new}
        return self.last


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, log: str, most: int):
        self.path, self.folder, self.most, self._log = path, log, most, None

    @property
    def log(self) -> Log:
        if self._log is None:
            self._log = Log(self.folder)
        return self._log

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_log": None}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entry": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"entry": self.log.discover(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = [(p, n) for e in range(start["entry"] + 1, end["entry"] + 1) for p, n in self.log.entry(e)]
        return ranges(files, self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition, Filters())

    def commit(self, end: dict) -> None:
        """Nothing to do: what was read stays in the log, so that no file is taken for a new one."""


class RangeSource(DataSource):
    """``spark.read`` or ``spark.readStream`` of ``format("strandlake-ranges")``: option ``path``, and ``rangeBytes``; a stream needs ``log``, a shared folder of its own."""

    @classmethod
    def name(cls) -> str:
        return "strandlake-ranges"

    def schema(self) -> str:
        return SCHEMA

    def _most(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._most())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"], self.options["log"], self._most())


def read_ranges(spark: SparkSession, path: str, most: int = RANGE_BYTES) -> DataFrame:
    """source, contig, seq, quality (null in FASTA), length, ordinal (rising in a file) of FASTA and FASTQ files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RangeSource)
    return spark.read.format("strandlake-ranges").option("rangeBytes", str(most)).load(path)


def stream_ranges(spark: SparkSession, path: str, log: str, most: int = RANGE_BYTES) -> DataFrame:
    """The same of files as they arrive under ``path``; ``log`` belongs to one stream, like its checkpoint."""
    spark.dataSource.register(RangeSource)
    return spark.readStream.format("strandlake-ranges").option("rangeBytes", str(most)).option("log", log).load(path)


def fastq_lines(contig: str, seq: str, quality: str) -> Column:
    """The four lines of a FASTQ record, without the last line's end."""
    return F.concat(F.lit("@"), F.col(contig), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(quality))
