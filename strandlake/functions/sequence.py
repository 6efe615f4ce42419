"""Column functions on nucleotide and amino-acid strings; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in TCAG order.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def dna_projection(text: Column) -> Column:
    """Maps the ASCII letters of any text onto ACGT in turn, and drops all else; for tables without sequences."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26])


def sanitized(seq: Column) -> Column:
    """Upper case with all but ACGT as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """The other strand; letters other than ACGT become N."""
    return F.translate(F.reverse(sanitized(seq)), "ACGT", "TGCA")


def gc_content(seq: Column) -> Column:
    """The share of G and C, 0 for an empty sequence."""
    hits = F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", ""))
    return F.when(F.length(seq) > 0, hits / F.length(seq)).otherwise(0.0)


def _bytes_once(seq: Column, function) -> Column:
    """Applies ``function`` to the sequence's bytes, which are taken once: substrings of bytes cost their own length, those of strings the way there."""
    return F.element_at(F.transform(F.array(seq.cast("binary")), function), 1)


def _slice(data: Column, start: Column, size: int) -> Column:
    """``size`` bytes from the 1-based ``start``, as a string."""
    return F.substring(data, start, size).cast("string")


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k of an ASCII sequence, in order."""
    n = F.length(seq) - k + 1
    found = _bytes_once(seq, lambda b: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _slice(b, i, k)))
    return F.when(n >= 1, found).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def low_complexity(seq: Column) -> Column:
    """Shorter than 5, at most one distinct base, or under 4 distinct 5-mers."""
    few = F.size(F.array_distinct(F.split(seq, "(?!^)"))) <= 1
    return (F.length(seq) < 5) | few | (F.size(F.array_distinct(kmers(seq, 5))) < 4)


def windows(seq: Column, size: int, step: int) -> Column:
    """(start, window) structs of the whole windows; partial ones at the end are left out."""
    last = F.length(seq) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return _bytes_once(seq, lambda b: F.transform(starts, lambda s: F.struct(s.alias("start"), _slice(b, s + 1, size).alias("window"))))


def positional_windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of overlapping windows over a length, of which the last ends at n."""
    step = size - overlap
    return F.when(n <= size, F.array(F.lit(0)).cast("array<int>")).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step)), F.array(n - size)).cast("array<int>"))
    )


def dinucleotide(seq: Column, pair: str) -> Column:
    """How often two different letters follow each other (such pairs can't overlap themselves)."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(pair), F.lit("")))) / 2).cast("long")


def rip_indices(seq: Column) -> tuple[Column, Column]:
    """TA/AT and (CA+TG)/(AC+GT); null where the divisor is 0."""
    count = {p: dinucleotide(seq, p) for p in ("TA", "AT", "CA", "TG", "AC", "GT")}
    return F.try_divide(count["TA"], count["AT"]), F.try_divide(count["CA"] + count["TG"], count["AC"] + count["GT"])


def is_rip(window: Column) -> Column:
    """A window of 500 shows repeat-induced point mutation by two smoothed ratios and at least 20 TA."""
    c = {p: dinucleotide(window, p) for p in ("TA", "TG", "CA", "AC", "GT", "AT")}
    up = c["TA"] + c["TG"] + 1
    return (up / (c["CA"] + 1) >= 1.5) & (up / (c["AC"] + c["GT"] + c["AT"] + 1) >= 0.8) & (c["TA"] >= 20)


def translate_codons(seq: Column, frame: int = 0) -> Column:
    """The amino acids of a reading frame, X for codons with other letters and * for stops."""
    n = F.floor((F.length(seq) - frame) / 3).cast("int")

    def amino(b: Column, i: Column) -> Column:
        at = [F.instr(F.lit(BASES), _slice(b, i * 3 + frame + 1 + j, 1)) for j in range(3)]
        known = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), 16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2], 1)).otherwise("X")

    parts = _bytes_once(seq, lambda b: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: amino(b, i)))
    return F.when(n >= 1, F.array_join(parts, "")).otherwise("")


def codon_count(seq: Column, *codons: str) -> Column:
    """How many of the first frame's codons are among these: a blank goes behind each whole codon, and codons with their blanks are taken out; a lambda for each codon would take several times as long."""
    spaced = F.regexp_replace(seq, "(?s)(...)", "$1 ")
    return ((F.length(spaced) - F.length(F.regexp_replace(spaced, f"(?:{'|'.join(codons)}) ", ""))) / 4).cast("long")


def longest_orf(seq: Column, frame: int = 0) -> Column:
    """The length of the longest stretch of amino acids between stops."""
    return F.array_max(F.transform(F.split(translate_codons(seq, frame), r"\*"), lambda p: F.length(p)))


def gc3(seq: Column, frame: int) -> Column:
    """The share of G and C at third codon positions of a frame, null below 31 codons."""
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    thirds = _bytes_once(seq, lambda b: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _slice(b, i * 3 + frame + 3, 1)))
    return F.when(n > 30, F.size(F.filter(thirds, lambda b: b.isin("G", "C"))) / n)


def gc3_skew(seq: Column, host: Column) -> Column:
    """The largest distance of a frame's third-position GC from the host's, 0 where no frame is long enough."""
    return F.coalesce(F.greatest(*(F.abs(gc3(seq, f) - host) for f in range(3))), F.lit(0.0))


def karlin_distance(seq: Column, host: Column) -> Column:
    """Mean absolute difference of the 16 dinucleotide odds ratios of two sequences, times 1000."""

    def odds(s: Column, a: str, b: str) -> Column:
        n = F.length(s)
        single = lambda x: (n - F.length(F.replace(s, F.lit(x), F.lit("")))) / n
        pairs = F.regexp_count(s, F.lit(f"{a}(?={b})")) / F.nullif(n - 1, F.lit(0))
        return F.coalesce(F.try_divide(pairs, single(a) * single(b)), F.lit(0.0))

    total = sum((F.abs(odds(seq, a, b) - odds(host, a, b)) for a in "ACGT" for b in "ACGT"), F.lit(0.0))
    return total * 1000 / 16


def excerpt(seq: Column, most: int = 5000) -> Column:
    """The first letters of a variant sequence, sanitised."""
    return sanitized(F.substring(seq, 1, most))


def bounded_view(seq: Column, most: int = 1_500_000, part: int = 500_000) -> Column:
    """A long sequence's head, middle and tail; a shorter one as it is."""
    n = F.length(seq)
    middle = F.substring(seq, F.floor((n - part) / 2).cast("int") + 1, part)
    return F.when(n > most, F.concat(F.substring(seq, 1, part), middle, F.substring(seq, n - part + 1, part))).otherwise(seq)


def hamming(left: Column, right: Column) -> Column:
    """Mismatches of two strings over the shorter one's length."""
    n = F.least(F.length(left), F.length(right))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(left, i, 1) != F.substring(right, i, 1)))).otherwise(0)
