"""Structural variants from maximal exact matches: seeds, chains, gaps, and the fallbacks behind them.

The kernels are plain numpy on two sequences, applied with Arrow batches to rows that hold a query and one of its routed references; a row is
independent of all others, so hot references spread over tasks.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandlake.functions import scores as S

CALL_FIELDS = "svtype string, pos bigint, end bigint, ref_pos bigint, ref_end bigint, svlen bigint, score double, anchors int, gq double, mode string"
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


@dataclass(frozen=True)
class CallParams:
    """Thresholds of the chain callers."""

    k: int = 21
    gap_band: int = 5000
    min_sv: int = 40
    min_block: float = 6.0
    min_anchors: int = 2
    #: Places of one seed that are taken; None takes all.
    hits: int | None = 64
    normalize: int = 128

    @property
    def min_mem(self) -> int:
        return max(15, self.k - 5)

    def tuned(self, mode: str, tier: str) -> CallParams:
        """The parameter set of a query mode and coverage tier."""
        if mode == "assembly":
            return replace(self, k=17, gap_band=10_000, min_anchors=1, min_block=4.0) if tier == "LOW" else replace(self, k=23, min_anchors=max(3, self.min_anchors), min_block=max(7.0, self.min_block)) if tier == "HIGH" else self
        if mode == "long":
            if tier == "LOW":
                return replace(self, k=13, gap_band=20_000, min_anchors=1, min_block=2.5)
            return replace(self, k=17, gap_band=12_000, min_anchors=max(2, self.min_anchors), min_block=max(4.0, self.min_block)) if tier == "HIGH" else replace(self, k=15, gap_band=15_000, min_anchors=1, min_block=3.0)
        if tier == "LOW":
            return replace(self, k=17, gap_band=8000, min_anchors=1, min_block=3.0)
        return replace(self, k=25, min_anchors=max(4, self.min_anchors), min_block=max(7.0, self.min_block)) if tier == "HIGH" else replace(self, min_anchors=3)


def reverse_complement(seq: str) -> str:
    return seq.encode().translate(_COMPLEMENT)[::-1].decode()


def _seeds(seq: np.ndarray, k: int) -> np.ndarray:
    """A number for each k-mer (k <= 31), -1 where it has another letter than ACGT."""
    code = np.full(256, -1, np.int64)
    code[[65, 67, 71, 84]] = range(4)
    x = code[seq]
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        part = x[i : i + n]
        bad |= part < 0
        out = (out << 2) | (part & 3)
    out[bad] = -1
    return out


def find_mems(query: str, reference: str, least: int, hits: int | None = 64) -> np.ndarray:
    """(query position, reference position, length) of exact matches of at least ``least`` that can't be extended.

    Seeds are looked up in the sorted k-mers of the reference, of which ``hits`` places at most are taken for one seed (None: all, which
    gives every maximal match); a match is extended along its diagonal once.
    """
    q, r = np.frombuffer(query.encode(), np.uint8), np.frombuffer(reference.encode(), np.uint8)
    k = min(least, 31)
    qs, rs = _seeds(q, k), _seeds(r, k)
    order = np.argsort(rs, kind="stable")
    listed = rs[order]
    low, high = np.searchsorted(listed, qs), np.searchsorted(listed, qs, side="right")
    n = np.where(qs >= 0, high - low if hits is None else np.minimum(high - low, hits), 0)
    qi = np.repeat(np.arange(len(qs)), n)
    ri = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    if not len(qi):
        return np.zeros((0, 3), np.int64)
    # seeds that follow one another on a diagonal are one match
    diagonal = ri - qi
    by = np.lexsort((qi, diagonal))
    qi, ri, diagonal = qi[by], ri[by], diagonal[by]
    new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (qi[1:] != qi[:-1] + 1)])
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(qi))) + k - 1
    found = np.column_stack([qi[heads], ri[heads], length])
    found = found[found[:, 2] >= least]
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def best_chain(mems: np.ndarray, band: int) -> list[int]:
    """The chain with the largest sum of lengths: both positions rise, and gaps stay within the band.

    Many matches are chained in n log n steps by a tree of maxima over the reference positions, from which those beyond the band are taken out again.
    """
    n = len(mems)
    if not n:
        return []
    if n > TREE_MATCHES:
        return _tree_chain(mems, band)
    order = np.lexsort((mems[:, 1], mems[:, 0]))
    q, r, length = mems[order].T
    score, back = length.astype(np.int64).copy(), np.full(n, -1)
    low = np.searchsorted(q, q - band)
    for i in range(n):
        a = low[i]
        ok = (q[a:i] < q[i]) & (r[a:i] < r[i]) & (r[i] - r[a:i] <= band)
        if ok.any():
            own = np.where(ok, score[a:i], -1)
            j = int(np.argmax(own))
            score[i] += own[j]
            back[i] = a + j
    at, chain = int(np.argmax(score)), []
    while at >= 0:
        chain.append(int(order[at]))
        at = int(back[at])
    return chain[::-1]


#: Matches from which chains are found by a tree.
TREE_MATCHES = 2000


def _tree_chain(mems: np.ndarray, band: int) -> list[int]:
    order = np.lexsort((mems[:, 1], mems[:, 0]))
    n = len(order)
    q, r, length = (x.tolist() for x in mems[order].T)
    by_r = np.lexsort((np.arange(n), r))
    leaf = np.empty(n, np.int64)
    leaf[by_r] = np.arange(n)
    sorted_r = np.asarray(r)[by_r]
    low, high = np.searchsorted(sorted_r, np.asarray(r) - band).tolist(), np.searchsorted(sorted_r, r).tolist()
    leaf = leaf.tolist()
    size = 1 << max(1, (n - 1).bit_length())
    nothing = (-1, 0)
    tree = [nothing] * (2 * size)  # (score, -place): of equal scores the first place

    def put(i: int, value: tuple[int, int]) -> None:
        at = leaf[i] + size
        tree[at] = value
        while at > 1:
            at >>= 1
            new = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == new:
                break
            tree[at] = new

    score, back, gone, waiting = [0] * n, [-1] * n, 0, deque()
    for i in range(n):
        while waiting and q[waiting[0]] < q[i]:  # only matches that begin before this one
            first = waiting.popleft()
            put(first, (score[first], -first))
        while q[gone] < q[i] - band:
            put(gone, nothing)
            gone += 1
        best, a, b = nothing, low[i] + size, high[i] + size
        while a < b:
            if a & 1:
                best = max(best, tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = max(best, tree[b])
            a, b = a >> 1, b >> 1
        score[i] = length[i]
        if best[0] >= 0:
            score[i] += best[0]
            back[i] = -best[1]
        waiting.append(i)
    at, chain = max(range(n), key=lambda i: (score[i], -i)), []
    while at >= 0:
        chain.append(int(order[at]))
        at = back[at]
    return chain[::-1]


def classify_all(chain: np.ndarray, min_sv: int) -> list[tuple[str, int, int, int, int, int]]:
    """An event for each consecutive pair whose gaps differ by ``min_sv``, or that goes back in the reference: type, query span, reference span, length."""
    out = []
    for (q0, r0, n0), (q1, r1, _) in zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True):
        qa, ra = q0 + n0, r0 + n0
        delta = (q1 - qa) - (r1 - ra)
        if r1 - ra <= -min_sv <= q1 - qa:  # the reference is read again: a tandem copy
            out.append(("DUP", qa, qa + delta, r1, ra, delta))
        elif abs(delta) >= min_sv:
            kind = "INS" if delta > 0 else "DEL"
            # matches may overlap at the edges of a repeat; the event then begins where the earlier one ends
            out.append((kind, min(qa, q1), max(qa, q1), min(ra, r1), max(ra, r1), abs(delta)))
    return out


def left_normalized(query: str, reference: str, q: int, r: int, most: int) -> tuple[int, int]:
    """Shifts an indel to the left while the letters before it agree."""
    n = 0
    while n < most and q > 0 and r > 0 and query[q - 1] == reference[r - 1]:
        q, r, n = q - 1, r - 1, n + 1
    return q, r


def call_pair(query: str, reference: str, params: CallParams = CallParams(), same_contig: bool = True) -> list[tuple]:
    """All calls of a query against one reference: indels of the best chain, inversions, duplications, translocations."""
    forward = find_mems(query, reference, params.min_mem, params.hits)
    other = find_mems(reverse_complement(query), reference, params.min_mem, params.hits)
    other[:, 0] = len(query) - other[:, 0] - other[:, 2]
    out: list[tuple] = []
    chain = forward[best_chain(forward, params.gap_band)] if len(forward) else forward
    score = float(chain[:, 2].sum()) if len(chain) else 0.0
    anchors = len(chain)
    gq = min(99.0, 10 * float(np.log10(1 + anchors)) + 0.5 * score)

    def emit(kind: str, qa: int, qb: int, ra: int, rb: int, size: int, mode: str = "mem_chain") -> None:
        out.append((kind, qa + 1, max(qb, qa + 1), ra + 1, max(rb, ra + 1), size, score, anchors, gq, mode))

    if len(other):
        inverted = other[~_covered(other, chain)]
        if len(inverted) and int(inverted[:, 2].sum()) >= params.min_sv:
            a, b = int(inverted[:, 0].min()), int((inverted[:, 0] + inverted[:, 2]).max())
            emit("INV", a, b, int(inverted[:, 1].min()), int((inverted[:, 1] + inverted[:, 2]).max()), b - a)
    if anchors < params.min_anchors or score < params.min_block:
        return out
    if not same_contig:
        span = int(chain[-1, 0] + chain[-1, 2] - chain[0, 0])
        if span >= params.min_sv and 2 * score >= span:
            emit("TRA", int(chain[0, 0]), int(chain[0, 0]) + span, int(chain[0, 1]), int(chain[-1, 1] + chain[-1, 2]), span)
        return out
    extra = forward[~_covered(forward, chain)]
    extra = extra[extra[:, 2] >= params.min_sv] if len(extra) else extra
    repeated: list[tuple[int, int]] = []
    for q, r, n in extra.tolist():
        if any(q < b and a < q + n for a, b in repeated):
            continue
        # the reference stretch is already used by the chain: it stands twice in the query
        used = (chain[:, 1] < r + n) & (chain[:, 1] + chain[:, 2] > r)
        repeated.append((q, q + n))
        emit("DUP" if used.any() else "TRA", q, q + n, r, r + n, n)
    for kind, qa, qb, ra, rb, size in classify_all(chain, params.min_sv):
        if kind == "INS" and any(qa < b and a < qb for a, b in repeated):
            continue
        if kind == "DEL" and any(c[0] == "INV" and c[1] <= qb + 1 and qa <= c[2] for c in out):
            continue
        qn, rn = (qa, ra) if kind == "DUP" else left_normalized(query, reference, qa, ra, params.normalize)
        emit(kind, qn, qb - (qa - qn), rn, rb - (ra - rn), size)
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def chains(mems: np.ndarray, band: int, most: int) -> list[np.ndarray]:
    """Chains from the best down, each made of matches that no earlier one covers, until none is left or there are ``most``."""
    out: list[np.ndarray] = []
    left = mems
    while len(left) and len(out) < most:
        chain = left[best_chain(left, band)]
        out.append(chain)
        left = left[~_covered(left, chain)]
    return out


def single_reference_calls(query: str, reference: str, params: CallParams = CallParams()) -> list[tuple]:
    """All calls of a query against one reference, from many chains on both strands.

    Up to max(64, min(1024, length / 50000)) chains are taken. A short query (under 1000) may have one anchor and a score of 3. Events of all chains carry the score
    and anchors of the first one that is good enough; quality is 40. Copies are looked for behind the first chain only; there is no shift to the left and no call off the contig.
    """
    most = max(64, min(1024, len(query) // 50_000))
    least_anchors, least_score = (1, min(params.min_block, 3.0)) if len(query) < 1000 else (params.min_anchors, params.min_block)
    out: set[tuple] = set()
    first: tuple[float, int] | None = None
    forward = find_mems(query, reference, params.min_mem, params.hits)
    for number, chain in enumerate(chains(forward, params.gap_band, most)):
        score, anchors = float(chain[:, 2].sum()), len(chain)
        if anchors < least_anchors or score < least_score:
            continue
        first = first or (score, anchors)
        events = classify_all(chain, params.min_sv)
        if number == 0:
            extra = forward[~_covered(forward, chain)]
            for q, r, n in extra[extra[:, 2] >= params.min_sv].tolist():
                if ((chain[:, 1] < r + n) & (chain[:, 1] + chain[:, 2] > r)).any():
                    events.append(("DUP", q, q + n, r, r + n, n))
        out |= {(kind, qa, qb, ra, rb, size, *first) for kind, qa, qb, ra, rb, size in events}
    other = find_mems(reverse_complement(query), reference, params.min_mem, params.hits)
    other[:, 0] = len(query) - other[:, 0] - other[:, 2]
    covered = np.concatenate([c for c in chains(forward, params.gap_band, 1)]) if len(forward) else forward
    inverted = other[~_covered(other, covered)]
    if len(inverted) and int(inverted[:, 2].sum()) >= params.min_sv:
        a, b = int(inverted[:, 0].min()), int((inverted[:, 0] + inverted[:, 2]).max())
        score, anchors = first or (float(inverted[:, 2].sum()), len(inverted))
        out.add(("INV", a, b, int(inverted[:, 1].min()), int((inverted[:, 1] + inverted[:, 2]).max()), b - a, score, anchors))
    calls = [(kind, qa + 1, max(qb, qa + 1), ra + 1, max(rb, ra + 1), size, score, anchors, 40.0, "single_ref") for kind, qa, qb, ra, rb, size, score, anchors in out]
    return sorted(calls, key=lambda c: (c[1], c[0], c[2]))


def _covered(mems: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Whether a match's query stretch is mostly inside the chain's."""
    if not len(chain) or not len(mems):
        return np.zeros(len(mems), bool)
    n = int(max((mems[:, 0] + mems[:, 2]).max(), (chain[:, 0] + chain[:, 2]).max())) + 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, chain[:, 0], 1)
    np.add.at(edge, chain[:, 0] + chain[:, 2], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return 2 * (inside[mems[:, 0] + mems[:, 2]] - inside[mems[:, 0]]) > mems[:, 2]


def call_rows(pairs: DataFrame, keep: list[str], query: str, reference: str, params: CallParams = CallParams(), same_contig: str | None = None, single: bool = False) -> DataFrame:
    """Calls of each row's query against its reference; the columns ``keep`` come along. ``single`` takes many chains of each pair."""
    columns = [*keep, query, reference, *([same_contig] if same_contig else [])]

    def apply(batches):
        for pdf in batches:
            owners, rows = [], []
            for i, (q, r, same) in enumerate(zip(pdf[query], pdf[reference], pdf[same_contig] if same_contig else [True] * len(pdf), strict=True)):
                for call in single_reference_calls(q or "", r or "", params) if single else call_pair(q or "", r or "", params, bool(same)):
                    owners.append(i)
                    rows.append(call)
            names = [f.split()[0] for f in CALL_FIELDS.split(", ")]
            yield pd.concat([pdf[keep].iloc[owners].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keep)
    return pairs.select(*dict.fromkeys(columns)).mapInPandas(apply, f"{fields}, {CALL_FIELDS}")


def length_delta_call(query_length: Column, reference_length: Column, min_sv: int = 40) -> Column:
    """The fallback call of a pair without a chain: an indel of the difference of lengths; null below ``min_sv``."""
    delta = query_length - reference_length
    pos = F.least(F.floor(query_length / 4) + 1, reference_length)
    call = F.struct(F.when(delta < 0, "DEL").otherwise("INS").alias("svtype"), pos.alias("pos"), F.abs(delta).alias("svlen"), F.lit(20.0).alias("score"), F.lit(30.0).alias("gq"))
    return F.when(F.abs(delta) >= min_sv, call)


def kmer_fallback_call(query_length: Column, reference_length: Column, overlap: Column, min_sv: int = 40) -> Column:
    """The read-mode fallback: only at an overlap of 0.05 and a plausible difference of lengths."""
    delta = query_length - reference_length
    plausible = (overlap >= 0.05) & (F.abs(delta) >= min_sv) & (F.abs(delta) <= F.greatest(F.lit(min_sv), F.least(query_length, reference_length)))
    call = F.struct(F.when(delta < 0, "DEL").otherwise("INS").alias("svtype"), F.floor(F.least(query_length, reference_length) / 2).alias("pos"), F.abs(delta).alias("svlen"), (10 + 10 * overlap).alias("score"), (10 + 40 * overlap).alias("gq"))
    return F.when(plausible, call)


def off_reference_call(length: Column, overlap: Column) -> Column:
    """The call of a sequence that no reference explains, with its tier; null if one does."""
    tier = S.novelty_tier(overlap)
    call = F.struct(F.lit("OFF_REF").alias("svtype"), F.lit(1).cast("long").alias("pos"), length.cast("long").alias("svlen"), tier.alias("annotation"), F.lit(8.0).alias("score"), F.lit(20.0).alias("gq"))
    return F.when(tier != "OFF_REF_KNOWN", call)


def priority(row: dict[str, Column]) -> Column:
    """The linear priority of a candidate; keys: off_ref, overlap, score, anchors, mapq, gq, posterior, logodds, depth, layers, mode, svtype."""
    c = row
    strong = c["svtype"].startswith("TRA") & (c["score"] >= 6) & (c["anchors"] >= 2)
    return (
        F.when(c["off_ref"], -250.0).otherwise(40.0)
        + 180 * c["overlap"]
        + 0.20 * F.least(F.lit(400.0), c["score"])
        + 2 * F.least(F.lit(80), c["anchors"])
        + 0.30 * F.least(F.lit(60), c["mapq"])
        + 0.20 * F.least(F.lit(60), c["gq"])
        + 120 * c["posterior"]
        + 12 * S.clamp(c["logodds"], -6.0, 12.0)
        + 2 * F.least(F.lit(8), c["depth"])
        + 4 * F.least(F.lit(4), c["layers"])
        - F.when((c["posterior"] < 0.35) & ~strong, 120.0).otherwise(0.0)
        + F.when(c["posterior"] >= 0.90, 30.0).otherwise(0.0)
        + F.when(c["mode"] == "mem_chain", 8.0).when(c["mode"] == "length_delta", 12.0).when(c["mode"] == "kmer_fallback", 10.0).otherwise(0.0)
    )


@F.pandas_udf(LongType())
def equal_bases(query: pd.Series, reference: pd.Series) -> pd.Series:
    """At how many places two sequences have one base."""

    def count(a: str | None, b: str | None) -> int:
        n = min(len(a or ""), len(b or ""))
        return int(np.count_nonzero(np.frombuffer((a or "")[:n].encode("utf-32-le"), "<u4") == np.frombuffer((b or "")[:n].encode("utf-32-le"), "<u4")))

    return pd.Series([count(a, b) for a, b in zip(query, reference, strict=True)], dtype="int64")


#: How sure an ancestral base is where both have it, where they differ, and where only the reference or only the query reaches.
SAME_BASE, OTHER_BASE, REFERENCE_ONLY, QUERY_ONLY = 0.995, 0.65, 0.80, 0.55


def ancestral_rows(rows: DataFrame, key: str, query: str, reference: str, svtype: str, recombined: bool = True) -> DataFrame:
    """(key, ancestral, aligned, breakpoints, mean_posterior): the ancestral bases of two sequences laid side by side, for a call of a type.

    Of two bases the reference's is ancestral, but a deletion keeps the query's; where only one sequence reaches it gives the base, but the rest of a query with an insertion is new. Translocations
    and inversions have two breakpoints, sequence off the reference has one if it may be recombined, others one. Null sequences are empty; nothing at all has a posterior of 0.
    """
    rows = rows.select(F.col(key), F.coalesce(query, F.lit("")).alias("_q"), F.coalesce(reference, F.lit("")).alias("_r"), F.coalesce(svtype, F.lit("")).alias("_t"))
    q, r, kind = F.col("_q"), F.col("_r"), F.col("_t")
    both, rest = F.least(F.length(q), F.length(r)), F.length(q) - F.length(r)
    own = F.when(kind == "DEL", F.expr("substring(_q, 1, least(length(_q), length(_r)))")).otherwise(F.expr("substring(_r, 1, least(length(_q), length(_r)))"))
    tail = F.when(rest < 0, F.expr("substring(_r, length(_q) + 1)")).when(kind != "INS", F.expr("substring(_q, length(_r) + 1)")).otherwise("")
    more = F.when(rest < 0, -rest * REFERENCE_ONLY).when(kind != "INS", rest * QUERY_ONLY).otherwise(0.0)
    size = both + F.length(tail)
    points = F.when(kind.isin("TRA", "INV"), 2).when(kind == "OFF_REF", int(recombined)).otherwise(1)
    counted = rows.withColumn("_same", equal_bases("_q", "_r"))
    total = F.col("_same") * SAME_BASE + (both - F.col("_same")) * OTHER_BASE + more
    return counted.select(F.col(key), F.concat(own, tail).alias("ancestral"), both.cast("long").alias("aligned"), points.alias("breakpoints"), F.when(size > 0, total / size).otherwise(0.0).alias("mean_posterior"))
