"""AVI motion-JPEG columns: a text as grey frames, read back through the RIFF index, with shots from histogram differences.

A payload byte is one flat 8x8 block of a baseline JPEG whose quantiser divides the DC term by exactly eight, so any
decoder gives the byte back. The Huffman table gives DC category s a code of 9 - s bits, which with its s extra bits makes nine
bits for every block; with one bit for the end of the block, a frame of 16 x 12 blocks is 240 bytes before stuffing. Coding and
decoding are therefore table look-ups over all frames of a text at once.

A shot ends where the difference of two frames' 16-bin histograms exceeds the mean of the differences before it
by ``SHARP`` standard deviations (over a trailing window), and ``LEAST`` of the samples.

``video_clips`` takes any AVI files with motion-JPEG: frames are found through the RIFF index (or, without one and in AVIX segments, in the order of the movie list), and each baseline
frame is decoded with its own tables. Frames written here take a shorter way, which needs no Huffman decoding bit by bit.

A null text is empty and gives one frame of blanks. Repeated rows and null ids are kept, an empty table gives no row, and other
columns are ignored. A text's media is about 2.2 times its length and must stay under RIFF's 4 GiB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.jpeg import luma

WIDE, HIGH = 16, 12
FRAME = WIDE * HIGH
RATE = 25
BINS = 16
WINDOW, LEAST_WINDOW, SHARP, LEAST = 12, 4, 3.0, 0.25
#: Frames handled at once.
SLAB = 1 << 13


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    dc = bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, dc),
        _segment(0xC4, ac),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


HEAD, TAIL = _jpeg_head(), b"\xff\xd9"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The ten bits of each DC difference (from -255), and the difference of each nine bits."""
    bits, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        nine = (((1 << (9 - s)) - 2) << s) | (diff if diff > 0 else diff + (1 << s) - 1)
        bits[diff + 255] = nine << 1
        back[nine] = diff
    return bits, back


BITS, BACK = _tables()


def _encode(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded scans of frames (n x FRAME samples)."""
    level = samples.astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    v = BITS[diff + 255].reshape(-1, 4)
    out = np.empty((len(v), 5), np.uint8)
    out[:, 0] = v[:, 0] >> 2
    out[:, 1] = (v[:, 0] & 3) << 6 | v[:, 1] >> 4
    out[:, 2] = (v[:, 1] & 15) << 4 | v[:, 2] >> 6
    out[:, 3] = (v[:, 2] & 63) << 2 | v[:, 3] >> 8
    out[:, 4] = v[:, 3] & 255
    raw, step = out.tobytes(), FRAME * 10 // 8
    return [raw[at : at + step].replace(b"\xff", b"\xff\x00") for at in range(0, len(raw), step)]


def _decode(scans: list[bytes]) -> np.ndarray:
    """The samples of frames from their scans."""
    raw = b"".join(s.replace(b"\xff\x00", b"\xff") for s in scans)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 5).astype(np.uint16)
    v = np.empty((len(b), 4), np.uint16)
    v[:, 0] = b[:, 0] << 2 | b[:, 1] >> 6
    v[:, 1] = (b[:, 1] & 63) << 4 | b[:, 2] >> 4
    v[:, 2] = (b[:, 2] & 15) << 6 | b[:, 3] >> 2
    v[:, 3] = (b[:, 3] & 3) << 8 | b[:, 4]
    if (v & 1).any():
        raise ValueError("a block has AC terms")
    diff = BACK[v >> 1].reshape(-1, FRAME)
    return (np.cumsum(diff, axis=1, dtype=np.int16) + 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a multiple of ``FRAME``."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    frames = [HEAD + scan + TAIL for at in range(0, len(samples), SLAB) for scan in _encode(samples[at : at + SLAB])]
    n, most = len(frames), max(map(len, frames))
    width, height = WIDE * 8, HIGH * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4h", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.fromiter(map(len, frames), np.int64, n)
    step = 8 + sizes + (sizes & 1)
    index = np.empty(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(step) - step, sizes
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def _scan(frame: bytes) -> bytes | None:
    """The entropy-coded part of a frame that was written here, else nothing."""
    return frame[len(HEAD) : -2] if frame.startswith(HEAD) and frame.endswith(TAIL) else None


def _listed(media: bytes, base: int, end: int) -> list[tuple[int, int]]:
    """Where the video frames of a movie list are, by its own chunks."""
    places, at = [], base + 4
    while at + 8 <= min(end, len(media)):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name[2:] in (b"dc", b"db"):
            places.append((at + 8, at + 8 + size))
        at += 12 if name == b"LIST" else 8 + size + (size & 1)
    return places


def parsed(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """Where an AVI file's video frames are (start and end), and its frames a second.

    The frames of further RIFF segments (AVIX) follow in the order of their movie lists.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, lists, index, rate = 12, [], None, float(RATE)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"RIFF":  # the next segment
            at += 12
            continue
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            lists.append((at + 8, at + 8 + size))
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            head = media.find(b"strh", at, at + 8 + size)
            if head >= 0:
                scale, ticks = struct.unpack("<II", media[head + 28 : head + 36])
                rate = ticks / scale if scale and ticks else rate
        elif name == b"idx1" and len(lists) == 1:
            index = np.frombuffer(media, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if not lists:
        raise ValueError("an AVI file without frames")
    more = [p for x in lists[1:] for p in _listed(media, *x)]
    base = lists[0][0]
    if index is None:
        return _listed(media, *lists[0]) + more, rate
    index = index[np.isin(index["id"], [b"00dc", b"00db"])]
    # offsets count from the movie list, or from the file's start
    first = int(index["at"][0]) if len(index) else 0
    shift = base if len(index) and media[base + first : base + first + 4] == index["id"][0] else 0
    starts = index["at"].astype(np.int64) + shift + 8
    return list(zip(starts.tolist(), (starts + index["size"]).tolist(), strict=True)) + more, rate


def read_avi(media: bytes) -> Iterator[np.ndarray]:
    """The samples of an AVI file that was written here, in slabs of frames."""
    places, _ = parsed(media)
    for k in range(0, len(places), SLAB):
        scans = [_scan(media[s:e]) for s, e in places[k : k + SLAB]]
        if any(s is None for s in scans):
            raise ValueError("a frame that was not written here")
        yield _decode(scans)


def histograms_of(media: bytes) -> tuple[np.ndarray, float]:
    """A histogram of luma (shares of the samples) of each frame of any motion-JPEG AVI file, and its frames a second."""
    places, rate = parsed(media)
    out = []
    for s, e in places:
        frame = media[s:e]
        own = _scan(frame)
        samples = _decode([own])[0] if own is not None else luma(frame).ravel()
        out.append(np.bincount(samples >> 4, minlength=BINS) / max(1, len(samples)))
    return np.array(out).reshape(-1, BINS), rate


def differences(histograms: np.ndarray) -> np.ndarray:
    """Half the L1 distance of each frame's histogram to the one before, as a share of the samples."""
    return np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2.0 * FRAME)


def shot_starts(diff: np.ndarray) -> np.ndarray:
    """The first frames of the shots: 0, and each frame whose difference exceeds the adaptive threshold."""
    n = len(diff)
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    i = np.arange(n)
    low = np.maximum(0, i - WINDOW)
    k = np.maximum(1, i - low)
    mean = (s1[i] - s1[low]) / k
    spread = np.sqrt(np.maximum(0, (s2[i] - s2[low]) / k - mean * mean))
    cut = (diff > np.maximum(LEAST, np.where(i - low >= LEAST_WINDOW, mean + SHARP * spread, LEAST)))
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The length in bytes of a text, and its bytes with blanks up to a positive multiple of ``FRAME``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


class Stored:
    """What is read back from the stored form of a text."""

    def __init__(self, text: str | None):
        self.n_bytes, payload = payload_of(text)
        self.media = write_avi(payload)
        sha, self.size, tail, histograms, total = hashlib.sha256(), 0, b"", [], 0
        for samples in read_avi(self.media):
            data = samples.tobytes()
            sha.update(data)
            self.size += len(data)
            tail = data[-16:]
            total += int(samples.sum(dtype=np.int64))
            frames = len(samples)
            histograms.append(np.bincount((np.arange(frames)[:, None] * BINS + (samples >> 4)).ravel(), minlength=frames * BINS).reshape(frames, BINS))
        self.payload_sha256, self.tail_crc32 = sha.hexdigest(), zlib.crc32(tail)
        self.diff = differences(np.concatenate(histograms))
        self.frames, self.starts = self.size // FRAME, shot_starts(self.diff)
        self.mean = total / self.size

    def feature(self) -> str:
        lengths = np.diff(np.append(self.starts, self.frames))
        return f"frames={self.frames};shots={len(self.starts)};longest={int(lengths.max())};luma={self.mean:.3f};change={float(self.diff.mean()) if len(self.diff) else 0.0:.4f}"


def _apply(docs: DataFrame, fields: str, rows_of) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                owners, out = [], []
                for k, text in enumerate(batch.column(1).slice(at, 256)):
                    for row in rows_of(Stored(text.as_py())):
                        owners.append(at + k)
                        out.append(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(types))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, {fields}")


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document: sizes and digests of payload and media as read back, and a feature string."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _apply(docs, fields, lambda s: [(s.n_bytes, s.size, s.payload_sha256, s.tail_crc32, len(s.media), hashlib.sha256(s.media).hexdigest(), s.feature())])


def video_clips(files: DataFrame) -> DataFrame:
    """One row for each shot of each AVI file (doc_id, media): its number, frames and times, and its mean change.

    A null, empty or damaged file, or one whose frames are not baseline motion-JPEG, gives one row with the reason in ``error``.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for k, media in enumerate(batch.column(1)):
                rows: list[tuple] = []
                try:
                    found, rate = histograms_of(media.as_py() or b"")
                    diff = np.abs(np.diff(found, axis=0)).sum(axis=1) / 2
                    starts = shot_starts(diff) if len(found) else np.zeros(0, np.int64)
                    for n, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True)):
                        rows.append((n, a, b, a / rate, b / rate, float(diff[a : b - 1].mean()) if b - a > 1 else 0.0, None))
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows = [(None,) * 6 + (str(e) or type(e).__name__,)]
                owners += [k] * len(rows)
                out += rows
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "change", "error"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "media").mapInArrow(apply, f"doc_id {kind}, clip long, first_frame long, end_frame long, start_s double, end_s double, change double, error string")


def clips(docs: DataFrame) -> DataFrame:
    """One row for each shot: its number, frames and times, and its mean change."""

    def rows(s: Stored) -> list[tuple]:
        ends = np.append(s.starts[1:], s.frames)
        return [(k, int(a), int(b), a / RATE, b / RATE, float(s.diff[a : b - 1].mean()) if b - a > 1 else 0.0) for k, (a, b) in enumerate(zip(s.starts, ends, strict=True))]

    return _apply(docs, "clip long, first_frame long, end_frame long, start_s double, end_s double, change double", rows)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of each document."""
    return _apply(docs, "media binary", lambda s: [(s.media,)])
