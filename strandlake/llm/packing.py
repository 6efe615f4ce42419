"""Packing: token streams are concatenated and cut into fixed windows.

Pass one tokenises each document, and writes its ids together with its running offset inside its partition;
the totals of the partitions (one number each) are summed into the partitions' global offsets. Pass two
adds the two and cuts every document at the multiples of the window: a document that crosses windows leaves one
boundary record for each. All sequences but the last are full, so only that one needs padding.

A null text is empty and has the closing id alone. Repeated rows are packed one by one, a null doc_id is kept, an
empty table gives no piece, and other columns are ignored. A text of any length is tokenised word by word.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.session import staged

WINDOW = 2048
END_ID = 1
#: Words and runs of words whose ids a generation remembers; two are kept, and the older one goes when the newer one is full.
REMEMBERED = 500_000
#: Fixed value: the letters by which byte-level models write bytes; those that aren't signs of Latin 1 get letters from 256 on.
_SIGNS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SIGNS)}
#: Characters that Python's split takes for blanks and the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed value: the blanks of the tokenizer's pattern.
SEPARATED = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Bytes of ids in one Arrow batch.
BATCH_BYTES = 8 << 20


class WordIds:
    """The tokenizer's ids of a text as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins tokens over it, so the ids of a text are those of its words;
    the ids of a word of Latin letters, digits and ASCII signs are those of its runs of letters, digits and signs.
    """

    #: The runs into which the tokenizer's own pattern cuts such a word once it is in lower case.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^0-9a-z\xdf-\xf6\xf8-\xff]+")
    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")

    #: What the tokenizer must do with runs for its model to be asked alone.
    TRIED = ("the", "abracadabraesque", "x", "7", "!?", "'s", "'", "\xe9t\xe9", "\xd7\xf7--", "na\xefvet\xe9stra\xdfe")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Words and the runs into which words are cut: a run has the ids that it has as a word.
        self.words: dict[str, bytes] = {}
        #: What was remembered before the present generation: frequent words come back from there.
        self.old: dict[str, bytes] = {}
        self.alone = all(self._by_model(p) == self._whole([p])[0] for p in self.TRIED)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _by_model(self, run: str) -> bytes:
        """The ids of a run by the tokenizer's model alone: it is in lower case and has no mark to compose, so all that is left of the steps before is the alphabet of bytes."""
        text = run if run.isascii() else run.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _run(self, run: str) -> bytes:
        known = self.words
        found = known.get(run)
        if found is None:
            found = known[run] = self.old.get(run) or (self._by_model(run) if self.alone else self._whole([run])[0])
        return found

    def _learn(self, words: set[str]) -> None:
        known, old, run, whole = self.words, self.old, self._run, []
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w.isascii() and w.isalpha():  # nearly all words: one run of letters
                known[w] = run(w.lower())
            elif self.PLAIN.fullmatch(w) and "<|" not in w:
                known[w] = b"".join(map(run, self.PARTS.findall(w.lower())))
            else:
                whole.append(w)
        for at in range(0, len(whole), 20_000):
            some = whole[at : at + 20_000]
            known.update(zip(some, self._whole(some), strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.words, self.old = {}, self.words
        split = [SEPARATED.split(t) if t and SEPARATORS.search(t) else (t or "").split() for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.words.get, words))
        if None in found:
            missing = [i for i, f in enumerate(found) if f is None]
            self._learn({words[i] for i in missing})
            known = self.words
            for i in missing:
                found[i] = known[words[i]]
        end, at, out = np.array([END_ID], "<u4").tobytes(), 0, []
        for own in split:
            out.append(b"".join(found[at : at + len(own)]) + end)
            at += len(own)
        return out


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own encoder, kept from task to task."""
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = WordIds(path)
    return _made[path]


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, part, start_in_part, ids: each partition's documents with their running token offset."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, part = word_ids(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            row = 0
            while row < len(batch):
                end, size = row, 0
                taken = []
                while end < len(batch) and (not taken or size < BATCH_BYTES // 4):
                    taken.append(texts[end].as_py())
                    size += len(taken[-1] or "")
                    end += 1
                found = words.ids(taken)
                starts = total + np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])])
                total = int(starts[-1])
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(np.full(len(found), part, np.int32)), pa.array(starts[:-1], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "part", "start_in_part", "ids"])
                row = end

    return docs.select("doc_id", "text").mapInArrow(apply, docs.select("doc_id").schema.add("part", "integer").add("start_in_part", "long").add("ids", "binary"))


def cut(stream: DataFrame, bases: dict[int, int], window: int) -> DataFrame:
    """One row for each piece of a document in a window."""
    shared = stream.sparkSession.sparkContext.broadcast(bases)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            docs, columns = [], [[] for _ in range(6)]
            for row, (part, start, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                ids = ids.as_buffer()
                view, n, at = memoryview(ids), ids.size // 4, base[part] + start
                done = 0
                while done < n:
                    length = min(n - done, window - (at + done) % window)
                    docs.append(row)
                    for column, value in zip(columns, (done, length, zlib.crc32(view[4 * done : 4 * (done + length)]), n, (at + done) // window, (at + done) % window), strict=True):
                        column.append(value)
                    done += length
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = stream.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return stream.select("doc_id", "part", "start_in_part", "ids").mapInArrow(apply, schema)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: where each token of each document goes."""
    stream = staged(tokenised(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")), "packing")
    totals = stream.groupBy("part").agg(F.max(F.col("start_in_part") + (F.octet_length("ids") / 4).cast("long")).alias("n")).collect()
    bases, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        bases[part], at = at, at + n
    return cut(stream, bases, window)
