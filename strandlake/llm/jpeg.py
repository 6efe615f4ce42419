"""A decoder of baseline JPEG frames to their luma plane: quantisation and Huffman tables, AC terms, subsampling, restarts.

Frames without Huffman tables, as motion-JPEG files have them, are decoded by the tables that the JPEG standard gives as typical.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed value: the order in which a block's coefficients are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINE = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """The bits of a scan's piece between restarts."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek(self, count: int) -> int:
        while self.n < count:  # beyond the end there are ones
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        return (self.held >> (self.n - count)) & ((1 << count) - 1)

    def take(self, count: int) -> int:
        value = self.peek(count) if count else 0
        self.n -= count
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        code = self.peek(16)
        size = int(table[1][code])
        if not size:
            raise ValueError("a code that the table lacks")
        self.take(size)
        return int(table[0][code])

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _huffman(body: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Tables by class and number: the symbol and length of each 16-bit prefix."""
    out, at = {}, 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        symbol, size, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, at + 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                low, high = code << (16 - length), (code + 1) << (16 - length)
                symbol[low:high], size[low:high] = body[k], length
                code, k = code + 1, k + 1
            code <<= 1
        out[kind], at = (symbol, size), k
    return out


def _typical() -> bytes:
    """The tables of a frame that brings none, as the body of a segment."""
    every = sorted([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
    # Codes of each length, and the symbols that do not come in rising order at the end, of DC and AC terms of luma and then chroma.
    tables = [
        (0x00, "00010501010101010100000000000000", ""),
        (0x10, "0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
        (0x01, "00030101010101010101010000000000", ""),
        (0x11, "00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
    ]
    out = b""
    for kind, counts, first in tables:
        head = bytes.fromhex(first)
        out += bytes([kind]) + bytes.fromhex(counts) + (head + bytes(s for s in every if s not in head) if kind & 0x10 else bytes(range(12)))
    return out


@lru_cache(maxsize=1)
def typical() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return _huffman(_typical())


def _block(bits: _Bits, dc: tuple, ac: tuple, quantiser: np.ndarray, before: int) -> tuple[np.ndarray, int]:
    """The samples of the next block (before the shift by 128), and its DC term."""
    terms = np.zeros(64)
    before += bits.signed(bits.symbol(dc))
    terms[0] = before
    k = 1
    while k < 64:
        both = bits.symbol(ac)
        if not both & 15:
            if both != 0xF0:
                break
            k += 16
            continue
        k += both >> 4
        if k > 63:
            raise ValueError("a block has too many terms")
        terms[k] = bits.signed(both & 15)
        k += 1
    square = np.zeros(64)
    square[ZIGZAG] = terms * quantiser
    return _COSINE.T @ square.reshape(8, 8) @ _COSINE, before


def luma(frame: bytes) -> np.ndarray:
    """The luma plane of a baseline frame; other kinds of frames are an error."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quantisers, tables, parts, size, interval, at = {}, dict(typical()), [], None, 0, 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame without a scan")
        marker, n = frame[at + 1], struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                quantisers[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(float)
                k += 1 + 64 * (2 if wide else 1)
        elif marker == 0xC4:
            tables |= _huffman(body)
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of other than 8 bits")
            size = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("a frame that is not baseline")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if size is None or not parts or {p[0] for p in parts} != set(chosen):
        raise ValueError("a scan that does not hold all components")
    (high, wide), most_h, most_v = size, max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a single component is not interleaved
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    columns, rows = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    name, h, v, _ = parts[0]
    plane = np.zeros((rows * v * 8, columns * h * 8))
    scan, pieces, start, k = frame[at:], [], 0, 0
    while True:  # pieces end at restart markers, the last one at any other marker
        k = scan.find(b"\xff", k)
        if k < 0 or k + 1 >= len(scan):
            pieces.append(scan[start:])
            break
        if scan[k + 1] == 0:
            k += 2
        elif 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[start:k])
            start = k = k + 2
        else:
            pieces.append(scan[start:k])
            break
    bits, before = _Bits(pieces[0]), dict.fromkeys(chosen, 0)
    for unit in range(columns * rows):
        if interval and unit and unit % interval == 0:
            bits, before = _Bits(pieces[unit // interval]), dict.fromkeys(chosen, 0)
        for part, ph, pv, q in parts:
            dc, ac = tables[chosen[part] >> 4], tables[0x10 | chosen[part] & 15]
            for y in range(pv):
                for x in range(ph):
                    block, before[part] = _block(bits, dc, ac, quantisers[q], before[part])
                    if part == name:
                        top, left = (unit // columns * pv + y) * 8, (unit % columns * ph + x) * 8
                        plane[top : top + 8, left : left + 8] = block
    plane = np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)
    if (h, v) != (most_h, most_v):
        plane = plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
    return plane[:high, :wide]
