"""The frame decoder: on frames written here, and on colour frames with AC terms, subsampling and restarts made by a small encoder."""

import struct

import numpy as np
import pytest
from strandlake.llm import avi_mjpeg, jpeg


class Writer:
    def __init__(self):
        self.bits, self.out = "", bytearray()

    def put(self, value, size):
        self.bits += format(value, f"0{size}b") if size else ""

    def value(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        self.out += b"".join(bytes([b]) + (b"\x00" if b == 255 else b"") for b in (int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8)))
        self.bits = ""


DC = list(range(12))  # codes of four bits
AC = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]  # codes of eight bits
QUANT = [3 + i // 4 for i in range(64)]


def encoded(planes, wide, high, factors, interval):
    """A JPEG of planes of blocks' terms ((rows, columns, 64), zigzag); factors are (h, v) of each."""
    table = lambda kind, length, symbols: bytes([kind, *[len(symbols) if k == length else 0 for k in range(1, 17)], *symbols])
    segment = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    n = len(planes)
    head = b"\xff\xd8" + segment(0xE0, b"x") + segment(0xDB, bytes([0, *QUANT])) + segment(0xC4, table(0, 4, DC) + table(0x10, 8, AC))
    head += segment(0xC0, struct.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    head += segment(0xDD, struct.pack(">H", interval)) + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    w, before = Writer(), [0] * n
    columns = planes[0].shape[1] // factors[0][0]
    units = columns * (planes[0].shape[0] // factors[0][1])
    for unit in range(units):
        if interval and unit and unit % interval == 0:
            w.flush()
            w.out += bytes([255, 0xD0 + (unit // interval - 1) % 8])
            before = [0] * n
        for i, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    terms = planes[i][unit // columns * v + y, unit % columns * h + x].tolist()
                    diff, before[i] = terms[0] - before[i], terms[0]
                    w.put(DC.index(abs(diff).bit_length()), 4)
                    w.value(diff)
                    run = 0
                    last = max((k for k in range(1, 64) if terms[k]), default=0)
                    for k in range(1, last + 1):
                        if not terms[k]:
                            run += 1
                            continue
                        while run > 15:
                            w.put(AC.index(0xF0), 8)
                            run -= 16
                        w.put(AC.index(run << 4 | abs(terms[k]).bit_length()), 8)
                        w.value(terms[k])
                        run = 0
                    if last < 63:
                        w.put(AC.index(0), 8)
    w.flush()
    return head + bytes(w.out) + b"\xff\xd9"


def plain(terms, wide, high):
    """The samples of a plane by the definition of the transform."""
    rows, columns, _ = terms.shape
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    c = lambda u: 0.5**0.5 if u == 0 else 1.0
    basis = {(u, v): np.array([[c(u) * c(v) / 4 * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for x in range(8)] for y in range(8)]) for u, v in order}
    out = np.zeros((rows * 8, columns * 8))
    for r in range(rows):
        for k in range(columns):
            out[r * 8 : r * 8 + 8, k * 8 : k * 8 + 8] = sum(int(t) * q * basis[p] for t, q, p in zip(terms[r, k], QUANT, order) if t)
    return np.clip(np.rint(out + 128), 0, 255)[:high, :wide]


def terms(r, rows, columns):
    out = np.zeros((rows, columns, 64), int)
    out[:, :, 0] = r.integers(-100, 100, (rows, columns))
    for y in range(rows):
        for x in range(columns):
            for k in r.choice(np.arange(1, 64), r.integers(0, 12), replace=False):
                out[y, x, k] = r.integers(-9, 10)
    return out


@pytest.mark.parametrize("factors,interval", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 0)])
def test_foreign_frames(factors, interval):
    r = np.random.default_rng(len(factors) * 10 + interval)
    planes = [terms(r, 2 * v, 3 * h) for h, v in factors]
    wide, high = 3 * 8 * factors[0][0] - 5, 2 * 8 * factors[0][1] - 3
    found = jpeg.luma(encoded(planes, wide, high, factors, interval))
    assert found.shape == (high, wide) and np.abs(found.astype(int) - plain(planes[0], wide, high)).max() <= 1


def test_frames_written_here():
    payload = bytes(range(192))
    media = avi_mjpeg.write_avi(payload)
    (start, end), = avi_mjpeg.parsed(media)[0]
    found = jpeg.luma(media[start:end])
    assert found.shape == (96, 128) and (found == np.frombuffer(payload, np.uint8).reshape(12, 16).repeat(8, 0).repeat(8, 1)).all()


def test_frames_that_are_refused():
    good = encoded([np.zeros((1, 1, 64), int)], 8, 8, [(1, 1)], 0)
    for bad in (b"", good[:20], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, struct.error)):
            jpeg.luma(bad)


def test_clips_of_foreign_files(spark):
    r = np.random.default_rng(8)
    flat = lambda v: np.concatenate([np.full((2, 2, 1), v), np.zeros((2, 2, 63), int)], axis=2)
    frames = [encoded([flat(v)], 16, 16, [(1, 1)], 0) for v in [-200] * 8 + [150] * 6]
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)
    strh = b"vidsMJPG" + struct.pack("<IHHIII", 0, 0, 0, 0, 1, 10) + bytes(28)
    head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", strh)))
    movie = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    media = chunk(b"RIFF", b"AVI " + head + movie)  # without an index
    own = avi_mjpeg.write_avi(bytes([65] * 192 * 5 + [200] * 192 * 3))
    rows = [(1, media), (2, own), (3, None), (4, b"RIFFxxxxAVI "), (5, media[:-40])]
    found = avi_mjpeg.video_clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    got = {d: [(x["first_frame"], x["end_frame"], x["start_s"]) for x in found if x["doc_id"] == d] for d in range(1, 6)}
    assert got[1] == [(0, 8, 0.0), (8, 14, 0.8)] and got[2] == [(0, 5, 0.0), (5, 8, 0.2)]
    assert all(x["error"] for x in found if x["doc_id"] in (3, 4)) and len(got[3]) == len(got[4]) == 1


def test_frames_without_tables(spark):
    """The typical tables are those that the JVM has, and a frame that it encodes by them is decoded without its own."""
    jvm = spark.sparkContext._jvm
    java = jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for kind, table in ((0x00, java.StdDCLuminance), (0x10, java.StdACLuminance), (0x01, java.StdDCChrominance), (0x11, java.StdACChrominance)):
        own = jpeg._huffman(bytes([kind, *table.getLengths(), *[0] * (16 - len(table.getLengths())), *[v & 255 for v in table.getValues()]]))[kind]
        assert all((a == b).all() for a, b in zip(own, jpeg.typical()[kind], strict=True))
    r = np.random.default_rng(3)
    image = jvm.java.awt.image.BufferedImage(37, 21, 5)
    for y in range(21):
        for x in range(37):
            image.setRGB(x, y, int(r.integers(0, 1 << 24)))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    frame, at, bare = bytes(out.toByteArray()), 2, b"\xff\xd8"
    while frame[at + 1] != 0xDA:
        n = 2 + struct.unpack(">H", frame[at + 2 : at + 4])[0]
        bare += b"" if frame[at + 1] == 0xC4 else frame[at : at + n]
        at += n
    bare += frame[at:]
    assert len(bare) < len(frame) and (jpeg.luma(bare) == jpeg.luma(frame)).all()


def test_segments_beyond_the_first():
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)
    first = avi_mjpeg.write_avi(bytes([65] * 192 * 3))
    flat = np.concatenate([np.full((2, 2, 1), 99), np.zeros((2, 2, 63), int)], axis=2)
    more = [encoded([flat], 16, 16, [(1, 1)], 0)] * 2
    media = first + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in more)))
    places, _ = avi_mjpeg.parsed(media)
    assert len(places) == 5 and [media[a:b] for a, b in places[3:]] == more
    assert len(avi_mjpeg.histograms_of(media)[0]) == 5
