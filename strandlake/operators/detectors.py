"""Element detectors and annotators per sequence, as plain kernels behind Arrow-batched columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.calling import reverse_complement

#: Classes in which starships and RIP occur.
RIP_CLASSES = ("Sordariomycetes", "Dothideomycetes", "Eurotiomycetes", "Leotiomycetes")
YEAST_CLASSES = ("Saccharomycetes", "Schizosaccharomycetes")


def _bytes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode(), np.uint8)


def gc(seq: str) -> float:
    return sum(seq.count(b) for b in "GC") / len(seq) if seq else 0.0


def _mismatches(a: str, b: str) -> int:
    return int((_bytes(a) != _bytes(b)).sum())


def is_tandem(seq: str) -> bool:
    """Period 2 to 12, at least five copies and fifty bases."""
    x = _bytes(seq)
    for period in range(2, 13):
        if len(x) < max(50, 5 * period):
            continue
        same = np.concatenate([[False], x[period:] == x[:-period], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        if longest >= 4 * period and longest + period >= 50:
            return True
    return False


def is_ltr(seq: str) -> bool:
    """Ends of 50 bases repeat with a tenth of mismatches at most, and the middle half is not AT-rich."""
    n = len(seq)
    return n >= 100 and _mismatches(seq[:50], seq[-50:]) <= math.ceil(5.0) and gc(seq[n // 4 : n - n // 4]) >= 0.45


def is_tir(seq: str) -> bool:
    """Ends of 30 bases are inverted repeats with a tenth of mismatches at most."""
    return len(seq) >= 60 and _mismatches(seq[:30], reverse_complement(seq[-30:])) <= math.ceil(3.0)


def is_line(seq: str) -> bool:
    """AT-rich, at least 200 bases, with a run of ten A or ten T."""
    return len(seq) >= 200 and gc(seq) < 0.42 and ("A" * 10 in seq or "T" * 10 in seq)


def is_sine(seq: str) -> bool:
    """80 to 500 bases, not AT-rich, with nearly equal ends of 15 bases."""
    return 80 <= len(seq) <= 500 and gc(seq) >= 0.50 and _mismatches(seq[:15], seq[-15:]) <= 2


def _window_gc(seq: str, size: int, step: int) -> np.ndarray:
    x = _bytes(seq)
    sums = np.concatenate([[0], np.cumsum((x == 71) | (x == 67))])
    starts = np.arange(0, len(x) - size + 1, step)
    return (sums[starts + size] - sums[starts]) / size if len(starts) else np.zeros(0)


def is_starship(seq: str, clade_gc: float) -> bool:
    """An AT-rich hull around a GC-rich cargo window."""
    cargo = _window_gc(seq, 1000, 500)
    return gc(seq) < clade_gc - 0.10 and bool((cargo >= max(0.40, clade_gc - 0.02)).any())


def is_hgt_island(seq: str, clade_gc: float, deviation: float = 0.10) -> bool:
    """Three windows of 500 in a row deviate in GC, the more so the further the clade is from one half."""
    odd = np.abs(_window_gc(seq, 500, 250) - clade_gc) > deviation + 0.6 * abs(0.50 - clade_gc)
    return len(odd) >= 3 and bool((odd[:-2] & odd[1:-1] & odd[2:]).any())


def is_rip(seq: str) -> bool:
    """A window of 500 with the signature of repeat-induced point mutation."""
    for at in range(0, len(seq) - 499, 250):
        w = seq[at : at + 500]
        c = {p: w.count(p) for p in ("TA", "TG", "CA", "AC", "GT", "AT")}
        up = c["TA"] + c["TG"] + 1
        if c["TA"] >= 20 and up / (c["CA"] + 1) >= 1.5 and up / (c["AC"] + c["GT"] + c["AT"] + 1) >= 0.8:
            return True
    return False


def element_class(seq: str | None, clade_gc: float, tax_class: str | None = None) -> str:
    """The first class that fits: starship, SINE, TIR, LTR, LINE, HGT, RIP, tandem repeat; NONE below 50 bases."""
    s = (seq or "").upper()
    if len(s) < 50:
        return "NONE"
    tests = [
        ("STARSHIP", lambda: tax_class not in YEAST_CLASSES and is_starship(s, clade_gc)), ("TE_SINE", lambda: is_sine(s)), ("TE_TIR", lambda: is_tir(s)), ("TE_LTR", lambda: is_ltr(s)), ("TE_LINE", lambda: is_line(s)),
        ("HGT", lambda: is_hgt_island(s, clade_gc)), ("RIP", lambda: tax_class not in YEAST_CLASSES and is_rip(s)), ("TANDEM_REPEAT", lambda: is_tandem(s)),
    ]
    return next((name for name, test in tests if test()), "NONE")


@F.pandas_udf(T.StringType())
def element_class_of(seq: pd.Series, clade_gc: pd.Series, tax_class: pd.Series) -> pd.Series:
    return pd.Series([element_class(s, g, c) for s, g, c in zip(seq, clade_gc, tax_class, strict=True)])


def flank(left: str, right: str, most: int = 15, identity: float = 0.85) -> tuple[str, int, float]:
    """The longest target-site duplication or inverted repeat of two flanks: kind, length, identity."""
    for n in range(min(most, len(left), len(right)), 3, -1):
        direct = 1 - _mismatches(left[-n:], right[:n]) / n
        inverted = 1 - _mismatches(left[-n:], reverse_complement(right[:n])) / n
        if max(direct, inverted) >= identity:
            return ("TSD", n, direct) if direct >= inverted else ("TIR", n, inverted)
    return "NONE", 0, 0.0


def boundary(seq: str, host_gc: float, size: int = 200, step: int = 50) -> tuple[int, int]:
    """[start, end) of the longest run of windows whose GC deviates from the host's; the whole sequence if none does."""
    odd = np.abs(_window_gc(seq, size, step) - host_gc) > 0.10
    edges = np.flatnonzero(np.diff(np.concatenate([[0], odd.astype(np.int8), [0]])))
    if not len(edges):
        return 0, len(seq)
    k = int(np.argmax(edges[1::2] - edges[::2]))
    return int(edges[2 * k]) * step, min(len(seq), (int(edges[2 * k + 1]) - 1) * step + size)


_CODONS = {a + b + c: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def translated(seq: str, frame: int) -> str:
    return "".join(_CODONS.get(seq[i : i + 3], "X") for i in range(frame, len(seq) - 2, 3))


def open_frames(seq: str, least: int = 100) -> list[tuple[int, int, str]]:
    """(frame 0 to 5, first base, amino acids) of all stretches between stops in both strands."""
    out = []
    for strand, s in enumerate((seq, reverse_complement(seq))):
        for frame in range(3):
            at = frame
            for part in translated(s, frame).split("*"):
                if len(part) >= least:
                    out.append((3 * strand + frame, at, part))
                at += 3 * (len(part) + 1)
    return out


def recombinase_score(aa: str) -> float:
    """A quarter for each residue of the R..H..R..Y pattern of tyrosine recombinases found in order at plausible distances."""
    best = 0.0
    for r in (i for i, a in enumerate(aa) if a == "R"):
        score, at = 0.25, r
        for residue, low, high in (("H", 60, 180), ("R", 2, 4), ("Y", 20, 60)):
            found = next((j for j in range(at + low, min(len(aa), at + high + 1)) if aa[j] == residue), None)
            if found is None:
                break
            score, at = score + 0.25, found
        best = max(best, score)
        if best == 1.0:
            break
    return best


def captain(seq: str) -> tuple[bool, str, int, int, int, float]:
    """present, family, frame, first base, length and score of the best recombinase frame."""
    best = (False, "NONE", -1, -1, 0, 0.0)
    for frame, at, aa in open_frames(seq.upper()):
        score = recombinase_score(aa)
        if score >= 0.75 and score > best[5]:
            family = "DUF3435" if score >= 0.85 and at < 8000 and len(aa) >= 250 else "YR"
            best = (True, family, frame, at, len(aa), score)
    return best


def donor_and_age(element_gc: float, host_gc: float, signature: float, host_length: int) -> tuple[str, str]:
    """The donor class by GC, and the age of a transfer by GC and dinucleotide signature."""
    delta = abs(element_gc - host_gc)
    donor = "HOST_LIKE" if delta < 0.03 else "HIGHER_GC_DONOR" if element_gc > host_gc else "LOWER_GC_DONOR"
    if host_length < 200:
        signature = 0.0
    age = "NATIVE" if delta < 0.03 and signature < 40 else "RECENT" if delta >= 0.08 or signature >= 90 else "AMELIORATING" if delta >= 0.05 or signature >= 60 else "ANCIENT"
    return donor, age


def karlin(seq: str, host: str) -> float:
    """Mean absolute difference of dinucleotide odds ratios, times 1000."""

    def odds(s: str) -> np.ndarray:
        code = np.full(256, -1)
        code[[65, 67, 71, 84]] = range(4)
        x = code[_bytes(s)]
        single = np.bincount(x[x >= 0], minlength=4) / max(1, (x >= 0).sum())
        ok = (x[:-1] >= 0) & (x[1:] >= 0)
        pairs = np.bincount(4 * x[:-1][ok] + x[1:][ok], minlength=16) / max(1, ok.sum())
        expected = np.outer(single, single).ravel()
        return np.divide(pairs, expected, out=np.zeros(16), where=expected > 0)

    return float(np.abs(odds(seq) - odds(host)).sum() * 1000 / 16)


ANNOTATION = "element string, bound_start long, bound_end long, flank string, flank_length int, flank_identity double, captain boolean, family string, orf_length int, captain_score double, donor string, age string"


def annotated(rows, keep: list[str], seq: str, host: str, clade_gc: str):
    """The extended annotation of each row's element against its host sequence."""

    def apply(batches):
        names = [f.split()[0] for f in ANNOTATION.split(", ")]
        for pdf in batches:
            out = []
            for s, h, g in zip(pdf[seq].fillna(""), pdf[host].fillna(""), pdf[clade_gc], strict=True):
                s, h = s.upper(), h.upper()
                start, end = boundary(s, g)
                kind, n, same = flank(s[:start][-15:], s[end:][:15])
                found = captain(s)
                donor, age = donor_and_age(gc(s[start:end]), gc(h) if h else g, karlin(s[start:end], h) if len(h) >= 200 else 0.0, len(h))
                out.append((element_class(s, g), start, end, kind, n, same, found[0], found[1], found[4], found[5], donor, age))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, seq, host, clade_gc).mapInPandas(apply, f"{fields}, {ANNOTATION}")


def off_reference_windows(query: str, overlaps, least: int = 250, min_sv: int = 40, most: int | None = 256) -> list[tuple[int, int, float, str]]:
    """[start, end), overlap and tier of the windows that no reference explains; neighbours of one tier are merged, lone weak ones dropped.

    ``overlaps(window)`` gives the best overlap of a window with any reference. The first ``most`` windows are looked at; with None all are.
    """
    size = min(len(query), max(least, min_sv, 100))
    starts = list(range(0, max(1, len(query) - size + 1), max(1, size // 2)))[:most]
    out: list[list] = []
    for at in starts:
        ov = overlaps(query[at : at + size])
        tier = "NOVEL" if ov <= 0 else "NOVEL_WEAK" if ov < 0.05 else "DIVERGED" if ov < 0.20 else None
        if tier is None:
            continue
        if out and out[-1][3] == tier and at <= out[-1][1]:
            out[-1][1], out[-1][2], out[-1][4] = at + size, max(out[-1][2], ov), out[-1][4] + 1
        else:
            out.append([at, at + size, ov, tier, 1])
    return [tuple(o[:4]) for o in out if not (o[3] == "NOVEL_WEAK" and o[4] == 1)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType())])))
def open_syncmers(seqs: pd.Series) -> pd.Series:
    """Positions and hashes of the 21-mers whose smallest 11-mer (the last of equal ones) stands at offset 2."""
    from strandlake.functions.stats import fnv1a

    def one(seq: str, k: int = 21, s: int = 11, t: int = 2) -> list[tuple[int, int]]:
        seq = (seq or "").upper()
        n = len(seq) - k + 1
        if n < 1:
            return []
        small = fnv1a(pd.Series([seq[i : i + s] for i in range(len(seq) - s + 1)]))
        width = k - s + 1
        view = np.lib.stride_tricks.sliding_window_view(small, width)
        last = width - 1 - np.argmin(view[:, ::-1], axis=1)
        places = [i for i in np.flatnonzero(last == t).tolist() if set(seq[i : i + k]) <= set("ACGT")]
        hashes = fnv1a(pd.Series([min(seq[i : i + k], reverse_complement(seq[i : i + k])) for i in places])).view(np.int64) if places else []
        return [(p, int(h)) for p, h in zip(places, hashes, strict=True)]

    return seqs.map(one)


def minimizer_hashes(seq: str, k: int = 15, w: int = 100, most: int | None = 192) -> list[int]:
    """The hashes of the smallest canonical k-mer of each window of w: the ``most`` smallest ones, or all with None."""
    from strandlake.operators.calling import _seeds

    seq = (seq or "").upper()
    if len(seq) < k:
        return []
    forward, other = _seeds(_bytes(seq), k), _seeds(_bytes(reverse_complement(seq)), k)[::-1]
    code = np.minimum(forward, other).astype(np.uint64)
    h = code + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(31))) >> np.uint64(1)
    h = np.where(forward >= 0, h, np.uint64(1 << 63)).astype(np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(h, min(w, len(h))).min(axis=1)
    return np.unique(least[least < np.uint64(1 << 63)])[:most].astype(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def minimizers(seqs: pd.Series) -> pd.Series:
    """``minimizer_hashes`` of each read, at most 192."""
    return seqs.map(minimizer_hashes)


@F.pandas_udf(T.ArrayType(T.LongType()))
def all_minimizers(seqs: pd.Series) -> pd.Series:
    """``minimizer_hashes`` of each read, all of them."""
    return seqs.map(lambda s: minimizer_hashes(s, most=None))


def minimizer_postings(rows: DataFrame, name: str, seq: str) -> DataFrame:
    """(hash, name): the postings of all minimizers of each sequence."""
    return rows.select(F.explode(all_minimizers(F.col(seq))).alias("hash"), name)


def off_reference_intervals(sequences: DataFrame, name: str, seq: str, references: DataFrame, size: int = 250, k: int = 9, keep_digits: str = "0123456789abcdef") -> DataFrame:
    """name, start, end, overlap, tier: stretches of sequences that no reference (postings reference, h) explains.

    Windows of ``size`` by half of it are routed by their best containment; neighbours of one tier become one stretch, and lone weak windows are dropped.
    """
    from strandlake.functions.scores import novelty_tier
    from strandlake.functions.sequence import windows
    from strandlake.operators import sketch

    cut = sequences.select(name, F.explode(windows(F.col(seq), size, size // 2)).alias("w")).select(name, "w.start", "w.window")
    p = sketch.postings(cut.withColumn("_w", F.concat_ws(":", name, "start")), "_w", "window", k, keep_digits).withColumnRenamed("_w", "query")
    best = sketch.similarities(p, references).groupBy("query").agg(F.max("containment").alias("overlap"))
    held = cut.select(name, "start", F.concat_ws(":", name, "start").alias("query")).join(best, "query", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    tiers = held.withColumn("tier", novelty_tier(F.col("overlap"))).filter("tier != 'OFF_REF_KNOWN'")
    order = Window.partitionBy(name).orderBy("start")
    new = (F.lag("tier").over(order) != F.col("tier")) | (F.lag("start").over(order) + size < F.col("start"))
    island = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = tiers.withColumn("_island", island).groupBy(name, "_island", "tier").agg(F.min("start").alias("start"), (F.max("start") + size).alias("end"), F.max("overlap").alias("overlap"), F.count("*").alias("_n"))
    return found.filter("NOT (tier = 'NOVEL_WEAK' AND _n = 1)").select(name, "start", "end", "overlap", "tier")
