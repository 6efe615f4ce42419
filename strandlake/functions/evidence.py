"""Column functions of evidence, breakpoints, names and element labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import scores as S

#: The weights of an observation's terms.
BREAKPOINT_PER_ANCHOR, BREAKPOINT_CHAIN, BREAKPOINT_REARRANGED = 0.08, 0.25, 0.10
SPAN_FALLBACK, SPAN_NOVEL = 0.20, 0.15
ALT_ANCHOR, ALT_MAPQ, ALT_GQ, ALT_OVERLAP, REF_BASE = 0.18, 0.03, 0.03, 2.5, 0.85
#: Element classes that are another name for a class.
CLASS_NAMES = {"Class_I": "LTR", "Retrotransposon": "LTR", "Class_II": "DNA", "TIR": "DNA", "MITE": "DNA"}


def observation(c: dict[str, Column], overlap: Column, assembly_weight: Column, read_weight: Column) -> dict[str, Column]:
    """The terms of a call's observation: layer, depth, mapq, bp, span, alt and ref (log-likelihoods).

    ``c`` has svtype, mode, query_mode, anchors, mapq, gq, score, annotation, mate_contig.
    """
    anchors, mapq, gq = (F.greatest(F.lit(0), F.coalesce(c[k], F.lit(0))) for k in ("anchors", "mapq", "gq"))
    chain, fallback = F.contains(c["mode"], F.lit("mem_chain")), F.contains(c["mode"], F.lit("simple_length_fallback"))
    novel, moved = c["svtype"] == "OFF_REF", c["svtype"].startswith("TRA")
    layer = F.when(c["query_mode"] == "assembly", "ASM").when(c["query_mode"] == "long", "LR").otherwise("SR")
    weight = F.greatest(F.lit(0.25), F.when(layer == "ASM", assembly_weight).otherwise(read_weight))
    term = lambda holds, value: F.when(holds, F.lit(value)).otherwise(0.0)
    bp = S.clamp(BREAKPOINT_PER_ANCHOR * anchors + term(chain, BREAKPOINT_CHAIN) + term(moved | (c["svtype"] == "INV"), BREAKPOINT_REARRANGED), 0.0, 1.0)
    span = S.clamp(overlap + term(fallback, SPAN_FALLBACK) + term(novel, SPAN_NOVEL), 0.0, 1.0)
    # a translocation with a strong chain overlaps little by nature, and is not held to it
    strong = (c["svtype"] == "TRA") & (c["score"] >= 6) & (c["anchors"] >= 2)
    doubtful = c["svtype"].isin("INV", "DUP") | ((c["svtype"] == "TRA") & ~strong)
    homeless = (c["svtype"] == "TRA") & ~strong & (F.coalesce(c["mate_contig"], F.lit("")) == "") & (overlap < 0.10)
    weak = doubtful & (overlap < 0.10)
    base = F.log1p(F.greatest(F.lit(0.0), c["score"])) + ALT_ANCHOR * anchors + ALT_MAPQ * mapq + ALT_GQ * gq + ALT_OVERLAP * overlap
    alt_placed = term(chain, 0.45) + term(fallback, 0.25) - term(weak, 2.5) - term(homeless, 1.0)
    ref_placed = term(overlap < 0.02, 1.5) + term(doubtful & (overlap < 0.05), 0.75) + F.when(weak, 5.0 + (0.10 - overlap) * 20).otherwise(0.0) + term(homeless, 2.0)
    alt = base + F.when(novel, F.when(c["annotation"].isin("NOVEL", "NOVEL_WEAK"), 0.60).otherwise(0.25)).otherwise(alt_placed)
    ref = REF_BASE + F.when(novel, overlap * 2.2).otherwise(ref_placed)
    return {"layer": layer, "depth": F.greatest(F.lit(1.0), anchors.cast("double")) * weight, "mapq": mapq.cast("double"), "bp": bp, "span": span, "alt": alt, "ref": ref}


def breakpoints(c: dict[str, Column], recombined: bool = True) -> Column:
    """A call's breakpoints in words: type, place, and for translocations the mate's. ``c`` has svtype, ref_contig, pos, end, mate_contig, mate_pos, mate_end."""
    low = F.greatest(F.lit(1), c["pos"])
    span = F.concat(low.cast("string"), F.lit("-"), F.greatest(low, c["end"]).cast("string"))
    at = F.greatest(F.lit(1), F.coalesce(c["mate_pos"], F.lit(0)))
    mate = F.concat(F.coalesce(F.nullif(c["mate_contig"], F.lit("")), F.lit(".")), F.lit(":"), at.cast("string"), F.lit("-"), F.greatest(at, F.coalesce(c["mate_end"], F.lit(0))).cast("string"))
    moved = F.concat(F.lit("TRA:"), c["ref_contig"], F.lit(":"), span, F.lit("->"), mate)
    other = F.concat(c["svtype"], F.lit(":"), span)
    return F.when(c["svtype"] == "TRA", moved).when((c["svtype"] == "OFF_REF") & (not recombined), ".").otherwise(other)


def near_boundary(pos: Column, window: int, tolerance: int) -> Column:
    """Whether a position lies within the tolerance of a window's edge."""
    if window <= 0:
        return F.lit(False)
    rest = F.pmod(pos, F.lit(window))
    return (rest < tolerance) | (window - rest < tolerance)


def plain_contig(name: Column) -> Column:
    """A contig without the marks of planted variants and insertions."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"__sv_.*$", ""), r"_ins\d*$", "")


def path_safe(name: Column) -> Column:
    """A name that may be part of a path: letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def element_label(header: Column) -> Column:
    """(id, te_class, te_order, superfamily, labelled) of a header like ``name#class/order/superfamily ...``."""
    text = F.regexp_replace(header, "^>", "")
    tax = F.substring_index(F.regexp_extract(text, r"^[^#]*#(.*)$", 1), " ", 1)
    parts = F.filter(F.split(tax, "/"), lambda p: p != "")
    n = F.size(parts)
    first = F.get(parts, F.lit(0))
    name = first
    for old, new in CLASS_NAMES.items():
        name = F.when(first == old, new).otherwise(name)
    known = n > 0
    return F.struct(
        F.regexp_extract(text, r"^([^# ]*)", 1).alias("id"), F.when(known, name).alias("te_class"),
        F.when(n >= 3, F.get(parts, F.lit(1))).otherwise(F.when(known, "")).alias("te_order"), F.when(known, F.get(parts, n - 1)).alias("superfamily"), known.alias("labelled"),
    )


def centroid_name(label: Column) -> Column:
    """class/order/superfamily, or class/superfamily where the order is not known."""
    return F.when(label["te_order"] != "", F.concat_ws("/", label["te_class"], label["te_order"], label["superfamily"])).otherwise(F.concat_ws("/", label["te_class"], label["superfamily"]))


def ends_alike(x: str | None, y: str | None) -> float:
    """Common prefix and suffix (which do not overlap) over the longer length and the shorter of the two; 1 for equal texts, 0 with an empty one."""
    p, q = (np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in (x, y))
    n = min(len(p), len(q))
    if not n:
        return 0.0
    if len(p) == len(q) and (p == q).all():
        return 1.0
    head = int(np.argmin(np.append(p[:n] == q[:n], False)))
    tail = min(int(np.argmin(np.append(p[::-1][:n] == q[::-1][:n], False))), n - head)
    return (head + tail) / (max(len(p), len(q)) + min(head, tail))


@F.arrow_udf(T.DoubleType())
def end_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """``ends_alike`` of two columns; only one pair of texts at a time is taken out of Arrow."""
    return pa.array([ends_alike(x.as_py(), y.as_py()) for x, y in zip(left, right, strict=True)], pa.float64())


def _signature(hashes: list[int] | np.ndarray, take: int, start: int, factor: int) -> int:
    value, mask = start, (1 << 64) - 1
    for h in hashes[:take]:
        value ^= (int(h) + 0x9E3779B97F4A7C15 + (value << 6) + (value >> 2)) & mask
    return value ^ (len(hashes) * factor & mask)


@F.pandas_udf(T.LongType())
def route_signature(hashes: pd.Series) -> pd.Series:
    """A sketch's signature from its first 8 hashes and its size, as a signed long; null for null."""
    out = [None if h is None else _signature(h, 8, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9) for h in hashes]
    return pd.Series([None if v is None else v - (1 << 64) if v >> 63 else v for v in out], dtype="Int64")


def centroid_signature(hashes: list[int], top: int) -> int:
    """The signature under which answers for a centroid are remembered: its first 16 hashes, its size, and how many answers are asked for."""
    return _signature(hashes, 16, 1469598103934665603 ^ top, 1)


def may_share(a: Column, b: Column, buckets: int = 64) -> Column:
    """Whether two arrays of longs can have a common value, by bit maps of their remainders: false is certain, true is not."""

    def bits(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(F.expr("1L") if buckets == 1 else F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(buckets)).cast("int"))))

    return bits(a).bitwiseAND(bits(b)) != 0


def letter_rank(seq: Column, letter: str, upto: Column) -> Column:
    """How often a letter occurs among the first ``upto``."""
    head = F.substring(seq, F.lit(1), upto)
    return F.length(head) - F.length(F.replace(head, F.lit(letter), F.lit("")))


def has_letters(seq: Column, word: Column) -> Column:
    """Whether every letter of a word occurs in a sequence: what can't hold the word is known by that."""
    return F.forall(F.filter(F.array_distinct(F.split(word, "")), lambda c: c != ""), lambda c: F.contains(seq, c))
