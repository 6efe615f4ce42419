"""Phrase collocations: n-gram counts from suffix arrays of word ids, shard by shard, and the phrases that cohere.

Words are counted first (a word belongs to its language, so all that follows is per language). Words of at least ``least``
occurrences get ids in shared storage. Each task reads its texts as runs of such words, builds the suffix array of a shard of
runs by prefix doubling, and takes the counts of all n-grams from the intervals of equal prefixes (LCP); the counts of all shards
are merged by key. A phrase is no more frequent than its parts, so what is left out loses nothing: two words are counted where both are
frequent, three to five where each pair is. Keys are the ids themselves, at most five of 32 bits, so no n-gram is told apart by a hash
(words are: 64 bits, with their language).

A null text is empty, a null language is ``und``. Repeated rows count each, a phrase never crosses a piece or a text, other columns are
ignored, an empty table gives no row. A text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.arrays import BLOBS, blobs, by_shard, heads, mapped, new_folder, planes, ranges, save
from strandlake.llm.text import LOWER, blocks, mix, prefix_hash, runs, span_hash
from strandlake.session import staged

LEAST, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one that holds it has at least this share (in hundredths) of its occurrences.
SHARE = 100
#: Words of a suffix array, bytes of text that are read at once, and words and phrases that a task gathers before it sends them on.
SHARD_WORDS, READ_BYTES, WORDS_HELD = 1 << 19, 1 << 20, 1 << 18
GATHERED = 1 << 20

#: Bytes between pieces, and between words.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[10:14] = True
WORD = ~BREAK
WORD[[9, 32]] = False


def language_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: its languages, its bytes in lower case, and of each word its start, end, key, piece and language's number."""
    langs, of = np.unique(np.array([x or "und" if x != "" else "" for x in batch.column("lang").to_pylist()], object), return_inverse=True)
    keys = np.array([language_key(x) for x in langs], np.uint64)
    for row, end, data, offsets in blocks(batch, most=READ_BYTES):
        low = LOWER[data]
        starts, ends, first = runs(WORD[low], offsets)
        text = np.repeat(np.arange(end - row), np.diff(first))
        lang = of[row:end][text] if len(text) else np.zeros(0, np.int64)
        piece = np.cumsum(BREAK[low])[starts] + text if len(text) else text  # rises from piece to piece and from text to text
        yield list(langs), low, starts, ends, mix(span_hash(prefix_hash(low), starts, ends) ^ keys[lang]), piece, lang


def _place(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _by_place(place: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each shard, in their own order."""
    order = np.argsort(place, kind="stable")
    return ((k, order[a:b]) for k, a, b in ranges(place[order].astype(np.uint64), np.arange(shards, dtype=np.uint64)))


def _squeezed(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    n = len(columns[0])
    return n.to_bytes(8, "little") + zstandard.compress(b"".join(planes(c.astype("<u8")) for c in columns) + tail, 1)


def _stretched(blob: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    n, raw = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:])
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * k).reshape(8, n).T).view("<u8").ravel().astype(np.uint64) for k in range(columns)], raw[8 * n * columns :]


class Words:
    """Where the ids of frequent words are: sorted keys by shard; an id is the place in all of them, from 1."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) + 1
        if self.base[-1] > 1 << 32:
            raise ValueError("more than 2**32 frequent words")

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key; 0 of one that is not frequent."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for k, mine in _by_place(_place(distinct, len(self.sizes)), len(self.sizes)):
            if self.sizes[k]:
                own = mapped(self.folder, f"words-{k}", self.sizes[k])
                at = np.minimum(np.searchsorted(own, distinct[mine]), len(own) - 1)
                out[mine] = np.where(own[at] == distinct[mine], at + self.base[k], 0)
        return out[back]


def count_words(docs: DataFrame, folder: str, shards: int, least: int) -> DataFrame:
    """shard, place, lang, word, a of frequent words, whose keys are saved; and for each language (of no place) its words in all."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, list]] = {}

        def taken() -> pa.RecordBatch:
            pairs = []
            for lang, own in held.items():
                keys = np.fromiter(own, np.uint64, len(own))
                counts, names = np.array([c for c, _ in own.values()], np.uint64), [w for _, w in own.values()]
                sizes = np.array(list(map(len, names)), np.uint64)
                for k, mine in _by_place(_place(keys, shards), shards):
                    mine = mine[np.argsort(keys[mine])]
                    head = lang.encode()
                    tail = len(head).to_bytes(4, "little") + head + b"".join(names[i] for i in mine.tolist())
                    pairs.append((k, _squeezed(keys[mine], counts[mine], sizes[mine], tail=tail)))
            held.clear()
            return blobs(pairs)

        many = 0
        for batch in batches:
            for langs, low, starts, ends, keys, _, lang in _words(batch):
                view = memoryview(low)
                for number in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == number)
                    distinct, first, counts = np.unique(keys[mine], return_index=True, return_counts=True)
                    own = held.setdefault(langs[number], {})
                    for key, at, n in zip(distinct.tolist(), mine[first].tolist(), counts.tolist(), strict=True):
                        if key in own:
                            own[key][0] += n
                        else:
                            own[key] = [n, bytes(view[starts[at] : ends[at]])]
                            many += 1
                if many > WORDS_HELD:
                    yield taken()
                    many = 0
        if held:
            yield taken()

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, counts, langs, names = [], [], [], []
        for blob in parts:
            (key, count, size), tail = _stretched(blob, 3)
            n = int.from_bytes(tail[:4], "little")
            keys.append(key)
            counts.append(count)
            langs.append((tail[4 : 4 + n].decode(), len(key)))
            names.append((tail, np.concatenate([[4 + n], 4 + n + np.cumsum(size.astype(np.int64))])))
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        first = heads(key[order])
        total = np.add.reduceat(count[order], first)
        often = np.flatnonzero(total >= least)
        save(folder, f"words-{shard}", key[order][first][often])
        edges = np.concatenate([[0], np.cumsum([n for _, n in langs])])
        rows = []
        for place, at in enumerate(often.tolist()):
            i = int(order[first[at]])
            part = int(np.searchsorted(edges, i, side="right")) - 1
            tail, cuts = names[part]
            rows.append((place, langs[part][0], tail[cuts[i - edges[part]] : cuts[i - edges[part] + 1]].decode("utf-8", "replace"), int(total[at])))
        every: dict[str, int] = {}
        for (lang, _), some in zip(langs, counts, strict=True):
            every[lang] = every.get(lang, 0) + int(some.sum())
        rows += [(None, lang, None, n) for lang, n in every.items()]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["shard", "place", "lang", "word", "a"])

    return by_shard(docs.mapInArrow(apply, BLOBS), shards, finish, "shard long, place long, lang string, word string, a long")


def word_runs(docs: DataFrame, words: Words) -> DataFrame:
    """Blobs of the ids of runs of two or more frequent words of one piece, 0 behind each run."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, keys, piece, _ in _words(batch):
                ids = words.ids(keys)
                own = pa.array([zstandard.compress(planes(parted(ids, piece).astype("<u4")), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([own], names=["run"])

    return docs.mapInArrow(apply, "run binary")


def parted(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The ids with a 0 behind each run of two or more that are not 0 and of one piece; others go."""
    joined = (ids[:-1] > 0) & (ids[1:] > 0) & (piece[:-1] == piece[1:]) if len(ids) else np.zeros(0, bool)
    return _joined_runs(ids, joined, 2)


def _joined_runs(ids: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """Runs of at least ``least`` words of which each is joined with the next, each with a 0 behind it."""
    if not len(joined):
        return np.zeros(0, ids.dtype)
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    size = ends - starts
    total = np.cumsum(size + 1)
    out = np.zeros(int(total[-1]) if len(total) else 0, ids.dtype)
    into = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[into] = ids[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)]
    return out


def suffix_array(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a shard's words by the ``longest`` words from there, and how many of those each has in common with the one before.

    ``ids`` has a 0 behind each run. Ranks by one word are doubled to ranks by two and four, and two of them that overlap give any other length.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)  # 0 stays the least
    rank = rank.astype(np.int64) if n and ids.min() == 0 else rank.astype(np.int64) + 1
    ranks = {1: rank}

    def widened(width: int, step: int) -> np.ndarray:
        """Ranks by ``width + step`` words, from ranks by ``width``; behind a run all is 0."""
        low, ahead = ranks[width], np.zeros(n, np.int64)
        ahead[: n - step] = ranks[width][step:] if step < n else 0
        both = np.where(ids > 0, low * (int(low.max(initial=0)) + 1) + ahead, 0)
        return np.unique(both, return_inverse=True)[1].astype(np.int64) + (0 if (ids == 0).any() else 1)

    width = 1
    while width < longest:
        step = min(width, longest - width)
        ranks[width + step] = widened(width, step)
        width += step
    order = np.argsort(ranks[longest], kind="stable")
    order = order[ids[order] > 0]
    common = np.zeros(len(order), np.int64)
    a, b = order[1:], order[:-1]
    same = np.ones(len(a), bool)
    for k in range(longest):  # beyond a run there are zeros
        x, y = (np.where(p + k < n, ids[np.minimum(p + k, n - 1)], 0) for p in (a, b))
        same &= (x == y) & (x > 0)
        common[1:] += same
    return order, common


def gram_counts(ids: np.ndarray, least_words: int, most_words: int) -> list[np.ndarray]:
    """Three columns of ids, two in each, and the counts of all n-grams of a shard of runs, from the intervals of its LCP array."""
    order, common = suffix_array(ids, most_words)
    end = np.zeros(len(ids), np.int64)
    zeros = np.flatnonzero(ids == 0)
    end = zeros[np.searchsorted(zeros, np.arange(len(ids)))] if len(zeros) else end
    left = end[order] - order
    out = [[] for _ in range(4)]
    for n in range(least_words, most_words + 1):
        first = np.flatnonzero(common < n)  # intervals of equal first n words
        if not len(first):
            continue
        whole = left >= n
        counts = np.add.reduceat(whole.astype(np.uint64), first)
        at = order[first[whole[first]]]
        counts = counts[whole[first]]
        w = [ids[at + k].astype(np.uint64) if k < n else np.zeros(len(at), np.uint64) for k in range(6)]
        for column, value in zip(out, [w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3], w[4], counts], strict=True):
            column.append(value)
    return [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in out]


def merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of keys (all but the last column) with the sums of the last one, sorted by key."""
    order = np.lexsort(columns[-2::-1])
    keys = [c[order] for c in columns[:-1]]
    first = heads(*keys)
    return [*(k[first] for k in keys), np.add.reduceat(columns[-1][order], first) if len(first) else np.zeros(0, np.uint64)]


def _grams(rows: DataFrame, cut, words: tuple[int, int], shards: int, finish, schema: str) -> DataFrame:
    """Counts of the n-grams of all runs, brought together by key; ``cut`` may cut a block's runs again."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, held, many = [], 0, [], 0

        def taken() -> pa.RecordBatch:
            rows = merged([np.concatenate(c) for c in zip(*held, strict=True)])
            held.clear()
            place = _place(mix(rows[0] ^ mix(rows[1] ^ mix(rows[2]))), shards)
            return blobs([(k, _squeezed(*(c[mine] for c in rows))) for k, mine in _by_place(place, shards)])

        def counted() -> int:
            held.append(gram_counts(np.concatenate(waiting), *words))
            waiting.clear()
            return len(held[-1][0])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
                ids = cut(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)) if len(raw) else np.zeros(0, np.int64)
                if len(ids):
                    waiting.append(ids)
                    size += len(ids)
                if size > SHARD_WORDS:
                    many, size = many + counted(), 0
                if many > GATHERED:
                    yield taken()
                    many = 0
        if waiting:
            counted()
        if held:
            yield taken()

    return by_shard(rows.mapInArrow(apply, BLOBS), shards, finish, schema)


class Pairs:
    """Where the frequent pairs of words are: sorted keys by shard."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes

    def cut(self, ids: np.ndarray) -> np.ndarray:
        """Runs again, in which each two words that follow each other are a frequent pair; of three words or more."""
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        keys, back = np.unique((ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64))[both], return_inverse=True)
        known = np.zeros(len(keys), bool)
        place = _place(mix(keys ^ mix(np.zeros(1, np.uint64) ^ mix(np.zeros(1, np.uint64)))), len(self.sizes))
        for k, mine in _by_place(place, len(self.sizes)):
            if self.sizes[k]:
                own = mapped(self.folder, f"pairs-{k}", self.sizes[k])
                known[mine] = own[np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)] == keys[mine]
        joined = np.zeros(len(both), bool)
        joined[np.flatnonzero(both)] = known[back]
        return _joined_runs(ids, joined, 3)


COUNTED = "shard long, k1 long, k2 long, k3 long, a long"


def _rows(shard: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), shard, np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["shard", "k1", "k2", "k3", "a"])


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, a), frequent phrases of two to five words (w: their ids, a), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select("text", "lang")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "phrases")
    found = staged(count_words(texts, folder, shards, least), "words")
    sizes = [0] * shards
    for r in found.filter("place IS NOT NULL").groupBy("shard").count().collect():
        sizes[r["shard"]] = r["count"]
    words = Words(folder, sizes)
    runs_of = staged(word_runs(texts, words), "runs")

    def kept(shard: int, parts: list[bytes]) -> list[np.ndarray]:
        held: list[list[np.ndarray]] = []
        while parts:
            held.append(_stretched(parts.pop(), 4)[0])
            if sum(len(h[0]) for h in held[1:]) > 4 * GATHERED:
                held = [merged([np.concatenate(c) for c in zip(*held, strict=True)])]
        rows = merged([np.concatenate(c) for c in zip(*held, strict=True)])
        return [c[rows[-1] >= least] for c in rows]

    def two(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = kept(shard, parts)
        save(folder, f"pairs-{shard}", rows[0])
        yield _rows(shard, rows)

    def more(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield _rows(shard, kept(shard, parts))

    pairs = staged(_grams(runs_of, lambda ids: ids, (2, 2), shards, two, COUNTED), "pairs")
    lengths = [0] * shards
    for r in pairs.groupBy("shard").count().collect():
        lengths[r["shard"]] = r["count"]
    longer = _grams(runs_of, Pairs(folder, lengths).cut, (3, LONGEST), shards, more, COUNTED)
    low = lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    w = F.filter(F.array(F.shiftrightunsigned("k1", 32), low("k1"), F.shiftrightunsigned("k2", 32), low("k2"), F.col("k3")), lambda x: x > 0)
    base = F.get(F.array(*[F.lit(int(b)) for b in words.base[:-1]]), F.col("shard").cast("int"))
    named = found.filter("place IS NOT NULL").select((F.col("place") + base).alias("id"), "lang", "word", "a")
    totals = found.filter("place IS NULL").groupBy("lang").agg(F.sum("a").alias("n"))
    return named, staged(pairs.unionByName(longer).select(w.alias("w"), "a"), "grams"), totals


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by the score of their weakest cut.

    A phrase of which a longer one has the ``share`` is left out; that is seen from those longer by one word, as what lies between the two is no rarer than the longer one.
    """
    words, grams, totals = phrases(docs, least)
    size = F.size("w")
    parent = grams.filter(size > 2)
    within = parent.select(F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"), "a").groupBy("w").agg(F.max("a").alias("_longer"))
    own = grams.join(within, "w", "left").filter(F.col("_longer").isNull() | (_exact("_longer") * 100 < _exact("a") * share)).select("w", "a")
    # every part of a frequent phrase is frequent
    parts = grams.filter(size < LONGEST).unionByName(words.select(F.array("id").alias("w"), "a"))
    cuts = own.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"_left": F.expr("slice(w, 1, k)"), "_right": F.expr("slice(w, k + 1, size(w) - k)")})
    cuts = cuts.join(parts.select(F.col("w").alias("_left"), F.col("a").alias("l")), "_left").join(parts.select(F.col("w").alias("_right"), F.col("a").alias("r")), "_right").select("w", "a", "k", "l", "r")
    at = F.get("w", F.lit(0))
    lang = words.select(F.col("id").alias("_first"), "lang").join(totals, "lang")
    scored = cuts.withColumn("_first", at).join(lang, "_first").withColumn("score", F.expr("(cast(1000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"))
    weakest = scored.groupBy("w").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "lang")).alias("_s")).select("w", "_s.*")
    text = weakest.select("w", F.posexplode("w").alias("_at", "id")).join(words.select("id", "word"), "id").groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.join(text, "w").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
