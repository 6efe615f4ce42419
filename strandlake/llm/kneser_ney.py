"""Interpolated modified Kneser-Ney trigram model: counted in Spark, stored as sorted arrays, memory-mapped for scoring.

The model is built in the shared folder by jobs that sort, sum and pack what a task has before the shuffle:

1. word counts by ranges of the 64-bit hash. A word's number is its rank in them;
2. trigram counts by ranges of (first, second word). The edges follow the words' counts and cut a frequent first word by its second
   one, so that no shard grows with one word. A shard keeps the trigrams seen twice or more, and of their contexts the totals and the
   numbers of followers seen once, twice and more often;
3. for each (second, third word), the number of distinct first words, by ranges of the same edges;
4. for each word, the same statistics of its followers, and the number of distinct words before it, by ranges of its number.

Trigrams seen once are counted everywhere (in totals, discounts and lower orders) but not stored: their mass goes to the bigram
level, as is usual when models are pruned. What is stored grows with the corpus.

Workers map the files and look the distinct n-grams of a million tokens up in sorted order, so these touch each file once, from front to
back. Only counts of counts, array lengths and the frequent words that cut the shards reach the driver.

A null text is empty, and has the end token alone. Repeated rows count and are scored as often as they come; a null doc_id is scored but
not learnt from. Without training rows N and V are 0. An empty table gives no row, and other columns are ignored. Words are told apart by
64-bit hashes; more than 2**32 - 2 distinct words are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrays import BLOBS, GATHERED, Gathered, blobs, by_shard, counted, hash_edges, heads, mapped, new_folder, pack, ranges, save, sliced, summed, unpack
from strandlake.llm.langid import held_out
from strandlake.llm.text import LOWER, NOT_BLANK, blocks, prefix_hash, runs, span_hash
from strandlake.session import staged, temporary

#: Hash of the end token; words' hashes are mixed, so that none is kept apart.
END = np.uint64(0x5EED0E0D5EED0E0D)
#: Keys that a shard of the model should have at most.
SHARD_KEYS = 2_000_000
#: A word is cut by its followers if it is more than this share of a shard.
HOT_SHARE = 0.25
#: Trigrams of a context beyond which its statistics are stored.
COUNTED = 32
#: Occurrences from which on a trigram is stored; with 1 all are.
STORED = 1
#: Bytes of text that are read at once.
READ_BYTES = 1 << 20
#: Tokens that are looked up at once. Each time all shards are visited, whose number grows with the corpus, so these are many.
TOKENS = 1_000_000
#: Rows of statistics that are gathered at once.
ROWS = 1 << 16
SHIFT = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's tokens with each text's end token, and the first token of each text (n+1)."""
    low = LOWER[data]
    starts, ends, first = runs(NOT_BLANK[low], offsets)
    hashes = span_hash(prefix_hash(low), starts, ends)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows of ``TOKENS`` tokens or a little more: pieces of batches, the hashes of their tokens, and the first token of each row (n+1)."""
    pieces: list[pa.RecordBatch] = []
    hashes: list[np.ndarray] = []
    first, size = [np.zeros(1, np.int64)], 0
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for row, end, data, offsets in blocks(batch, most=READ_BYTES):
            own, starts = tokens(data, offsets)
            pieces.append(rest.slice(row, end - row))
            hashes.append(own)
            first.append(starts[1:] + size)
            size += len(own)
            if size >= TOKENS:
                yield pieces, np.concatenate(hashes), np.concatenate(first)
                pieces, hashes, first, size = [], [], [np.zeros(1, np.int64)], 0
    if pieces:
        yield pieces, np.concatenate(hashes), np.concatenate(first)


@dataclass(frozen=True)
class Vocabulary:
    """Where the words' files are: the shards' lower ends, the number of the first word of each, and the frequent words."""

    folder: str
    edges: np.ndarray
    base: np.ndarray
    totals: np.ndarray
    hot: dict[int, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return int(self.base[-1])

    @property
    def total(self) -> int:
        return int(self.totals.sum())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted hashes; unknown ones get the number -1 and the count 0."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for k, a, b in ranges(hashes, self.edges):
            size = int(self.base[k + 1] - self.base[k])
            if size:
                known = mapped(self.folder, f"words-{k}", size)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), size - 1)
                hit = known[at] == hashes[a:b]
                number[a:b][hit] = at[hit] + self.base[k]
                count[a:b][hit] = mapped(self.folder, f"counts-{k}", size)[at[hit]]
        return number, count

    def pair_edges(self, shards: int, documents: int) -> np.ndarray:
        """Lower ends of ranges of (number << 32 | number) with about as many tokens each; a frequent word is cut by what follows it.

        Word numbers are ranks of hashes, so that within a shard of the vocabulary all but the frequent words lie evenly.
        """
        points = [(int(b), 0.0) for b in self.base]  # (number, mass before it)
        mass = self.totals.astype(float)
        for number, n in self.hot.items():
            mass[int(np.searchsorted(self.base, number, side="right")) - 1] -= n
        numbers, before = [0], [0.0]
        events = sorted({p for p, _ in points} | set(self.hot) | {h + 1 for h in self.hot} | {self.size, self.size + 1})
        for low, high in zip(events[:-1], events[1:], strict=True):
            if low in self.hot and high == low + 1:
                own = float(self.hot[low])
            elif low >= self.size:
                own = 2.0 * documents
            else:
                k = int(np.searchsorted(self.base, low, side="right")) - 1
                own = mass[k] * (high - low) / max(1, int(self.base[k + 1] - self.base[k]))
            numbers.append(high)
            before.append(before[-1] + own)
        inner = np.interp(np.arange(1, shards) * before[-1] / shards, before, numbers) if before[-1] else np.zeros(shards - 1)
        whole = np.floor(inner).astype(np.uint64)
        rest = ((inner - np.floor(inner)) * max(1, self.size)).astype(np.uint64)
        return np.unique(np.concatenate([[np.uint64(0)], (whole << SHIFT) | rest]))


def count_words(docs: DataFrame, folder: str, shards: int) -> Vocabulary:
    """Job 1."""
    edges = hash_edges(shards)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for _, _, data, offsets in blocks(batch, most=READ_BYTES):
                held.add(*summed(tokens(data, offsets)[0]))
                if held.size > GATHERED:
                    held.add(*held.take())
                    if held.size > GATHERED // 2:
                        yield blobs(list(sliced(*held.take(), edges)))
        if held.size:
            yield blobs(list(sliced(*held.take(), edges)))

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, counts = counted(parts)
        save(folder, f"words-{shard}", keys)
        save(folder, f"counts-{shard}", counts.astype(np.int64))
        # words that are more than a share of this shard: at most 4 / HOT_SHARE of them
        often = np.flatnonzero(counts > counts.sum() * HOT_SHARE / 4)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([often.tolist()], pa.list_(pa.int64())), pa.array([counts[often].tolist()], pa.list_(pa.int64()))], names=["shard", "n", "total", "often", "times"])

    rows = by_shard(docs.select("text").mapInArrow(apply, BLOBS), shards, finish, "shard int, n long, total long, often array<long>, times array<long>").collect()
    sizes, totals = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    for r in rows:
        sizes[r["shard"]], totals[r["shard"]] = r["n"], r["total"]
    base = np.concatenate([[0], np.cumsum(sizes)])
    if int(base[-1]) >= 2**32 - 2:
        raise ValueError("more than 2**32 - 2 distinct words")
    hot = {int(base[r["shard"]]) + at: n for r in rows for at, n in zip(r["often"], r["times"], strict=True)}
    return Vocabulary(folder, edges, base, totals, hot)


def trigrams(vocabulary: Vocabulary, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of a block as (first << 32 | second) and third number, sorted, and their counts.

    Numbers grow with hashes, so ranks in the block sort as numbers do; two starts stand before a text, and have the largest rank.
    """
    distinct, rank = np.unique(hashes, return_inverse=True)
    number = np.append(vocabulary.find(distinct)[0], vocabulary.size).astype(np.uint64)
    earlier, before, token, _, counts = triples(rank, *preceding(rank, first, len(distinct)), len(distinct) + 1)
    return (number[earlier] << SHIFT) | number[before], number[token], counts


def triples(token: np.ndarray, before: np.ndarray, earlier: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Distinct (earlier, before, token) rows of ranks under ``n``, sorted, the row of each token, and the rows' counts."""
    if n <= 1 << 21:  # three ranks fit in one number; only a very long text has more words
        few, wide = np.uint64((1 << 21) - 1), np.uint64(21)
        keys, which, counts = np.unique((earlier.astype(np.uint64) << np.uint64(42)) | (before.astype(np.uint64) << wide) | token.astype(np.uint64), return_inverse=True, return_counts=True)
        return keys >> np.uint64(42), (keys >> wide) & few, keys & few, which, counts.astype(np.uint64)
    pair = (earlier.astype(np.uint64) << SHIFT) | before.astype(np.uint64)
    order = np.lexsort((token, pair))
    pair, token = pair[order], token[order].astype(np.uint64)
    head = heads(pair, token)
    counts = np.diff(np.append(head, len(pair)))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(head)), counts)
    return pair[head] >> SHIFT, pair[head] & LOW, token[head], which, counts.astype(np.uint64)


def preceding(token: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token of a block, and the one before that."""
    before = np.concatenate([[start], token[:-1]])
    before[first[:-1]] = start
    earlier = np.concatenate([[start], before[:-1]])
    earlier[first[:-1]] = start
    return before, earlier


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (pair, third) rows with summed counts."""
    pair, third, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((third, pair))
    pair, third, counts = pair[order], third[order], counts[order]
    head = heads(pair, third)
    return pair[head], third[head], np.add.reduceat(counts, head) if len(head) else counts


def save_small(folder: str, name: str, rows: np.ndarray) -> int:
    """Saves rows of numbers, nearly all small, in bytes: those with a number beyond have 255 there and are saved whole beside them, behind their places. Returns how many these are."""
    large = np.flatnonzero((rows >= 255).any(axis=1))
    save(folder, name, np.minimum(rows, np.uint64(255)).astype(np.uint8))
    save(folder, f"{name}-whole", np.column_stack([large.astype(np.uint64), rows[large]]))
    return len(large)


def small_rows(folder: str, name: str, n: int, large: int, places: np.ndarray) -> np.ndarray:
    """Rows of ``save_small``; ``n`` of all, ``large`` of those that are saved whole."""
    out = mapped(folder, name, n)[places].astype(np.uint64)
    over = np.flatnonzero((out == 255).any(axis=1))
    if len(over):
        whole = mapped(folder, f"{name}-whole", large)
        out[over] = whole[np.searchsorted(whole[:, 0], places[over].astype(np.uint64)), 1:]
    return out


def count_trigrams(docs: DataFrame, vocabulary: Vocabulary, edges: np.ndarray, least: int) -> DataFrame:
    """Job 2: files of contexts and trigrams; blobs of (second, third) pairs by shard, and numbers about the files under shard -1."""
    folder, start = vocabulary.folder, np.uint64(vocabulary.size)

    def send(parts: list) -> pa.RecordBatch:
        pair, third, counts = merged(parts)
        return blobs([(k, pack(pair[a:b], counts[a:b], third[a:b])) for k, a, b in ranges(pair, edges)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, hashes, first in gathered(batches):
            held.append(trigrams(vocabulary, hashes, first))
            size += len(held[-1][0])
            if size > 3 * GATHERED // 8:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        own, size, known = [], 0, 0
        while parts:
            pair, counts, third = unpack(parts.pop(), 3)
            own.append((pair, third, counts))
            size += len(pair)
            if size > 4 * GATHERED + known:
                own = [merged(own)]
                size = known = len(own[0][0])
        pair, third, counts = merged(own)
        del own
        head = heads(pair)
        fell = lambda x: np.add.reduceat(x.astype(np.uint64), head)
        total, once, twice, more = fell(counts), fell(counts == 1), fell(counts == 2), fell(counts > 2)
        often = counts >= least
        kept = np.add.reduceat(often.astype(np.int64), head)
        stored = kept > 0
        kept = kept[stored]
        save(folder, f"contexts-{shard}", pair[head][stored])
        save(folder, f"begin-{shard}", np.concatenate([[0], np.cumsum(kept)]).astype(np.uint32 if kept.sum() < 1 << 32 else np.uint64))
        # the statistics of a few trigrams are counted when they are asked for, if all are stored
        noted = np.flatnonzero((kept > COUNTED) | (least > 1))
        save(folder, f"stats-{shard}", np.column_stack([noted.astype(np.uint64), *(x[stored][noted] for x in (total, once, twice, more))]))
        large = save_small(folder, f"times-{shard}", counts[often][:, None])
        save(folder, f"next-{shard}", narrow(third[often]))
        numbers = [shard, int(stored.sum()), int(often.sum()), len(noted), large, *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
        keys, seen = summed((pair << SHIFT) | third)  # the high half of a pair, its first word, is shifted out
        yield blobs([*sliced(keys, seen, edges), (-1, np.array(numbers, np.int64).tobytes())])

    return by_shard(docs.select("text").mapInArrow(apply, BLOBS), len(edges), finish, BLOBS)


def count_pairs(sent: DataFrame, vocabulary: Vocabulary, edges: np.ndarray, onward: np.ndarray) -> DataFrame:
    """Job 3: files of (second, third) pairs; blobs of words' statistics by shard of ``onward``, and numbers under shard -1."""
    folder = vocabulary.folder

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, seen = counted(parts)
        second = keys >> SHIFT
        head = heads(second)
        save(folder, f"firsts-{shard}", second[head])
        save(folder, f"from-{shard}", np.append(head, len(keys)))
        save(folder, f"seconds-{shard}", (keys & LOW).astype(np.uint32))
        save(folder, f"seen-{shard}", np.minimum(seen, 2**32 - 1).astype(np.uint32))
        fell = lambda x: np.add.reduceat(x.astype(np.uint64), head) if len(head) else second
        stats = np.column_stack([fell(seen), fell(seen == 1), fell(seen == 2), fell(seen > 2)])
        word, times = summed(keys & LOW)
        out = [(k, b"f" + second[head][a:b].tobytes() + stats[a:b].tobytes()) for k, a, b in ranges(second[head], onward)]
        out += [(k, b"b" + blob) for k, blob in sliced(word, times, onward)]
        numbers = [shard, len(head), len(keys), *(int((seen == k).sum()) for k in (1, 2, 3, 4))]
        yield blobs([*out, (-1, np.array(numbers, np.int64).tobytes())])

    return by_shard(sent, len(edges), finish, BLOBS)


def count_followers(sent: DataFrame, vocabulary: Vocabulary, onward: np.ndarray) -> DataFrame:
    """Job 4: dense files of each word's statistics; rows of sums."""
    folder = vocabulary.folder
    upto = np.append(onward[1:], np.uint64(vocabulary.size + 1)).astype(np.int64)

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        low = int(onward[shard])
        stats, times = np.zeros((int(upto[shard]) - low, 4), np.uint64), np.zeros(int(upto[shard]) - low, np.uint64)
        for part in parts:
            if part[:1] == b"f":
                rows = np.frombuffer(part[1:], np.uint64)
                n = len(rows) // 5
                stats[rows[:n].astype(np.int64) - low] += rows[n:].reshape(n, 4)
            else:
                word, n = unpack(part[1:])
                times[word.astype(np.int64) - low] += n
        save(folder, f"followers-{shard}", stats)
        save(folder, f"continued-{shard}", np.minimum(times, 2**32 - 1).astype(np.uint32))
        found = [shard, int(times.sum()), *(int((times == k).sum()) for k in (1, 2, 3, 4)), int((times > 2).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()) for f in found], names=["shard", "total", "n1", "n2", "n3", "n4", "more"])

    return by_shard(sent, len(onward), finish, "shard long, total long, n1 long, n2 long, n3 long, n4 long, more long")


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and 3 or more from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.clip(d, [0.01, 0.02, 0.03], [0.99, 1.99, 2.99])


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits, in three bytes each if they are small enough."""
    values = np.ascontiguousarray(values.astype("<u4"))
    return values.view(np.uint8).reshape(-1, 4)[:, :3] if not len(values) or values.max() < 1 << 24 else values


def numbers_at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The numbers at some places of an array, which may be a ``narrow`` one."""
    own = values[places]
    return own if own.ndim == 1 else own[:, 0].astype(np.uint64) | own[:, 1].astype(np.uint64) << np.uint64(8) | own[:, 2].astype(np.uint64) << np.uint64(16)


def bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked value in its own sorted run of ``values``, -1 where the run lacks it."""
    low, end = low.copy(), high
    high = high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = numbers_at(values, middle) < asked[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    inside = np.flatnonzero(low < end)
    out = np.full(len(low), -1, np.int64)
    hit = inside[numbers_at(values, low[inside]) == asked[inside]]
    out[hit] = low[hit]
    return out


def share(count: np.ndarray, stats: np.ndarray, d: np.ndarray, pruned: bool) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram's own share of its context, and the weight of the lower order (1 without a context)."""
    total, n = stats[:, 0].astype(float), stats[:, 1:].astype(float)
    own = np.where(count > 0, count - d[np.clip(count, 1, 3).astype(np.int64) - 1], 0.0)
    # the whole mass of n-grams that are not stored goes to the lower order
    rest = n @ (np.array([1.0, d[1], d[2]]) if pruned else d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, own / total, 0.0), np.where(total > 0, rest / total, 1.0)


@dataclass(frozen=True)
class Model:
    """All that a worker needs beside the files: edges, array lengths by shard, discounts of the three orders, and sums."""

    vocabulary: Vocabulary
    edges: np.ndarray
    onward: np.ndarray
    contexts: np.ndarray
    pairs: np.ndarray
    three: np.ndarray
    two: np.ndarray
    one: np.ndarray
    one_total: int
    one_rest: float
    pruned: bool

    def _files(self, kind: tuple[str, str], k: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mapped(self.vocabulary.folder, f"{kind[0]}-{k}", int(sizes[k, 0])), mapped(self.vocabulary.folder, f"{kind[1]}-{k}", int(sizes[k, 0]) + 1)

    def word(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted word numbers: the lowest order's probability, and the statistics of the followers. Unknown words (-1) have the uniform share."""
        times, stats = np.zeros(len(number)), np.zeros((len(number), 4), np.uint64)
        upto = np.append(self.onward[1:], np.uint64(self.vocabulary.size + 1)).astype(np.int64)
        known = np.flatnonzero(number >= 0)
        for k, a, b in ranges(number[known].astype(np.uint64), self.onward):
            own, low = known[a:b], int(self.onward[k])
            n = int(upto[k]) - low
            times[own] = mapped(self.vocabulary.folder, f"continued-{k}", n)[number[own] - low]
            stats[own] = mapped(self.vocabulary.folder, f"followers-{k}", n)[number[own] - low]
        uniform = 1.0 / (self.vocabulary.size + 1)
        if not self.one_total:
            return np.full(len(number), uniform), stats
        cut = np.where(times > 0, self.one[np.clip(times, 1, 3).astype(np.int64) - 1], 0.0)
        return (times - cut) / self.one_total + self.one_rest * uniform, stats

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """The number of distinct words before each of the sorted (second, third) pairs."""
        out = np.zeros(len(keys))
        for k, a, b in ranges(keys, self.edges):
            if not self.pairs[k, 0]:
                continue
            first, begin = self._files(("firsts", "from"), k, self.pairs)
            at = np.minimum(np.searchsorted(first, keys[a:b] >> SHIFT), len(first) - 1)
            hit = np.flatnonzero(first[at] == keys[a:b] >> SHIFT)
            n = int(self.pairs[k, 1])
            place = bisect(mapped(self.vocabulary.folder, f"seconds-{k}", n), begin[at[hit]], begin[at[hit] + 1], (keys[a:b] & LOW)[hit])
            found = place >= 0
            out[a + hit[found]] = mapped(self.vocabulary.folder, f"seen-{k}", n)[place[found]]
        return out

    def _statistics(self, k: int, places: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, noted: int, large: int) -> np.ndarray:
        """Of contexts at sorted places of a shard: the sum of the counts of their trigrams, and how many have one, two and more."""
        out = np.zeros((len(places), 4), np.uint64)
        known = mapped(self.vocabulary.folder, f"stats-{k}", noted)
        at = np.minimum(np.searchsorted(known[:, 0], places.astype(np.uint64)), noted - 1) if noted else np.zeros(len(places), np.int64)
        hit = known[at, 0] == places.astype(np.uint64) if noted else np.zeros(len(places), bool)
        if hit.any():
            out[hit] = known[at[hit], 1:]
        rest = np.flatnonzero(~hit)
        if len(rest):  # each has a trigram at least
            size = (high - low)[rest]
            first = np.cumsum(size) - size
            count = small_rows(self.vocabulary.folder, f"times-{k}", n, large, np.arange(int(size.sum())) + np.repeat(low[rest] - first, size))[:, 0]
            out[rest] = np.column_stack([np.add.reduceat(x.astype(np.uint64), first) for x in (count, count == 1, count == 2, count > 2)])
        return out

    def triple(self, pair: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of trigrams sorted by pair: their own shares of their contexts, and the weights of the lower order."""
        own_share, rest = np.zeros(len(pair)), np.ones(len(pair))
        for k, a, b in ranges(pair, self.edges):
            if not self.contexts[k, 0]:
                continue
            known, begin = self._files(("contexts", "begin"), k, self.contexts)
            at = np.minimum(np.searchsorted(known, pair[a:b]), len(known) - 1)
            hit = np.flatnonzero(known[at] == pair[a:b])
            if not len(hit):
                continue
            n, *large = (int(x) for x in self.contexts[k, 1:])
            own, back = np.unique(at[hit], return_inverse=True)
            low, high = begin[own].astype(np.int64), begin[own + 1].astype(np.int64)
            stats = self._statistics(k, own, low, high, n, *large)[back]
            place, count = bisect(mapped(self.vocabulary.folder, f"next-{k}", n), low[back], high[back], third[a:b][hit]), np.zeros(len(hit))
            found = place >= 0
            if found.any():
                count[found] = small_rows(self.vocabulary.folder, f"times-{k}", n, large[1], place[found])[:, 0]
            own_share[a + hit], rest[a + hit] = share(count, stats, self.three, self.pruned)
        return own_share, rest

    def log_probability(self, distinct: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token of a block, given the two before it; ``distinct`` are the numbers of the ranks, in order."""
        low, followers = self.word(np.append(distinct, self.vocabulary.size))
        # unknown words get a number that no file has
        number = np.append(np.where(distinct < 0, int(LOW), distinct), self.vocabulary.size).astype(np.uint64)
        earlier, before, token, which, _ = triples(rank, *preceding(rank, first, len(distinct)), len(distinct) + 1)
        pairs, of_pair = np.unique((before << SHIFT) | token, return_inverse=True)
        second, third = pairs >> SHIFT, pairs & LOW
        pairs = (number[second] << SHIFT) | number[third]
        order = np.argsort(pairs, kind="stable")
        count = np.zeros(len(pairs))
        count[order] = self.pair(pairs[order])
        lower = np.empty(len(pairs))
        for a in range(0, len(pairs), ROWS):  # some rows of statistics at a time
            rows = slice(a, a + ROWS)
            own, rest = share(count[rows], followers[second[rows]], self.two, False)
            lower[rows] = own + rest * low[third[rows]]
        lower = lower[of_pair]
        del pairs, of_pair, second, third, count
        contexts, token = (number[earlier] << SHIFT) | number[before], number[token]
        del earlier, before
        order = np.argsort(contexts, kind="stable")
        own, rest = self.triple(contexts[order], token[order])
        del contexts, token
        out = np.empty(len(order))
        out[order] = np.log10(own + rest * lower[order])
        return out[which]


def _noted(sent: DataFrame, shards: int, lengths: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Array lengths by shard, and the sums of the counts of counts, from the rows under shard -1 (one for each shard)."""
    sizes, n = np.zeros((shards, lengths), np.int64), np.zeros(4, np.int64)
    for r in sent.filter("shard = -1").collect():
        shard, *numbers = np.frombuffer(r["blob"], np.int64).tolist()
        sizes[shard] = numbers[:lengths]
        n += numbers[lengths:]
    return sizes, n


def train(docs: DataFrame, least: int = STORED) -> Model:
    """Learns from all rows of ``docs``; trigrams seen less than ``least`` times (1 or 2) are counted but not stored."""
    if least not in (1, 2):
        raise ValueError("trigrams are stored from one or two occurrences on")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = count_words(docs, new_folder(spark, "lm"), parts)
    edges = vocabulary.pair_edges(max(parts, vocabulary.total // SHARD_KEYS + 1), docs.count())
    onward = np.unique((np.arange(parts) * (vocabulary.size + 1) // parts).astype(np.uint64))
    with temporary(spark):  # the files stay, the tables between the jobs don't
        sent = staged(count_trigrams(docs, vocabulary, edges, least), "trigrams")
        contexts, three = _noted(sent, len(edges), 4)
        sent = staged(count_pairs(sent.filter("shard >= 0"), vocabulary, edges, onward), "pairs")
        pairs, two = _noted(sent, len(edges))
        rows = {r["shard"]: r for r in count_followers(sent.filter("shard >= 0"), vocabulary, onward).collect()}
    if vocabulary.total and len(rows) < len(onward):  # a shard without a blob still needs its files
        for k in set(range(len(onward))) - set(rows):
            n = int(np.append(onward[1:], np.uint64(vocabulary.size + 1))[k] - onward[k])
            save(vocabulary.folder, f"followers-{k}", np.zeros((n, 4), np.uint64))
            save(vocabulary.folder, f"continued-{k}", np.zeros(n, np.uint32))
    sums = {k: sum(r[k] for r in rows.values()) for k in ("total", "n1", "n2", "n3", "n4", "more")}
    if not vocabulary.total:
        onward = np.zeros(0, np.uint64)
    one = discounts(np.array([sums["n1"], sums["n2"], sums["n3"], sums["n4"]]))
    rest = float(one @ np.array([sums["n1"], sums["n2"], sums["more"]])) / sums["total"] if sums["total"] else 1.0
    return Model(vocabulary, edges, onward, contexts, pairs, discounts(three), discounts(two), one, sums["total"], rest, least > 1)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, least: int = STORED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    model = train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % modulus != remainder), least)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, v = own.vocabulary.total, own.vocabulary.size
        for rows, hashes, first in gathered(batches):
            distinct, rank = np.unique(hashes, return_inverse=True)
            number, count = own.vocabulary.find(distinct)
            base = np.log10((count + 1) / (n + v + 1))
            known, base, whole = (np.add.reduceat(x, first[:-1]) for x in ((count > 0).astype(np.int64)[rank], base[rank], own.log_probability(number, rank, first)))
            kept = [pa.concat_arrays([r.column(name) for r in rows]) for name in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(whole)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select("doc_id", held_out(modulus, remainder).alias("held_out"), "text")
    schema = rows.select("doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(apply, schema)
