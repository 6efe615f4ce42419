"""Fill in the middle: documents are cut at two line boundaries, which succinct bit vectors find.

A block of texts has two bit vectors over its bytes, packed into 64-bit words: the last byte of each line, and the first
byte of each code point. A directory keeps the ones before every block of 512 bits and, inside it, before every word. The
total of a text's boundary bits is its number of lines n; the two cuts, drawn from the document's id, are found by select
on the ranks of the boundaries, and lengths in code points by rank on the other vector.

A null text is empty and stays plain, as does one that holds a marker. A null id is drawn like an empty one. Repeated rows
give repeated results, an empty table gives none, other columns are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.text import blocks

SEED = 7
#: Of 100 documents, so many are transformed, and of those so many in the order suffix, prefix, middle.
RATE, SPM_RATE = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
WORDS = 8


class Bits:
    """A packed bit vector with rank and select, each for arrays of arguments."""

    def __init__(self, mask: np.ndarray):
        n = -(-max(1, len(mask)) // (64 * WORDS)) * WORDS
        raw = np.zeros(n * 8, np.uint8)
        packed = np.packbits(mask, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, WORDS)
        inner = np.cumsum(counts, axis=1, dtype=np.uint16)
        #: Ones before each block (and in all), and inside a block before each word.
        self.before = np.concatenate([[0], np.cumsum(inner[:, -1], dtype=np.int64)])
        self.inside = np.concatenate([np.zeros((len(inner), 1), np.uint16), inner[:, :-1]], axis=1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, bit = np.minimum(at >> 6, len(self.words) - 1), at & 63
        bit = np.where(at >> 6 < len(self.words), bit, 64)
        low = np.where(bit == 64, ~np.uint64(0), (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word // WORDS] + self.inside[word // WORDS, word % WORDS] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th one, from 1."""
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        word = (self.inside[block] < left[:, None]).sum(axis=1) - 1
        left = left - self.inside[block, word]
        bits = np.unpackbits(self.words[block * WORDS + word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * WORDS + word) * 64 + np.argmax(np.cumsum(bits, axis=1) == left[:, None], axis=1)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the last byte of each line; a text's last line may lack its line feed."""
    mask = data == 10
    mask[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return mask


def draws(doc_id: Column | str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the documents with their middles moved to the end."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in range(4)])
            for row, end, data, offsets in blocks(batch):
                lines, points = Bits(boundaries(data, offsets)), Bits((data & 0xC0) != 0x80)
                at = lines.rank(offsets)
                n = np.diff(at)
                a, b = h[0, row:end] % (n + 1), h[1, row:end] % (n + 1)
                a, b = np.minimum(a, b), np.maximum(a, b)
                # of no lines the cut is the text's start, of k lines it is behind the k-th boundary
                first, second = (np.where(k > 0, lines.select(np.maximum(1, at[:-1] + k)) + 1, offsets[:-1]) for k in (a, b))
                chars = [points.rank(x) for x in (offsets[:-1], first, second)]
                view = memoryview(np.ascontiguousarray(data))
                forms, outputs = [], []
                for s, p, m, e, h2, h3 in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), h[2, row:end].tolist(), h[3, row:end].tolist(), strict=True):
                    whole = bytes(view[s:e])
                    if not whole or h2 % 100 >= rate or any(x in whole for x in marks):
                        forms.append("plain")
                        outputs.append(whole)
                        continue
                    prefix, middle, suffix = view[s:p], view[p:m], view[m:e]
                    forms.append("spm" if h3 % 100 < spm_rate else "psm")
                    parts = (marks[1], suffix, marks[0], prefix) if forms[-1] == "spm" else (marks[0], prefix, marks[1], suffix)
                    outputs.append(b"".join((*parts, marks[2], middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                sizes = [pa.array(x, pa.int64(), mask=plain) for x in (chars[1] - chars[0], chars[2] - chars[1])]
                columns = [batch.column("doc_id").slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(draws("doc_id", seed))))
    return rows.mapInArrow(apply, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts lie between the markers, which no part holds."""

    def between(left: str, right: str | None) -> Column:
        after = F.substring_index(output, left, -1)
        return F.substring_index(after, right, 1) if right else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """What ``transform`` gives, with the digests of the output and of the text that is rebuilt from it in place of the output."""
    rows = transform(docs, **options)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
