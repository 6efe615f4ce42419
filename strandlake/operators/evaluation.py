"""Scoring of call sets against truth, consensus truth, layers, audits and enrichments."""

from __future__ import annotations

import bisect
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.functions import stats
from strandlake.operators import intervals
from strandlake.operators.selection import _scanned, collapse, greedy_match

#: Calls are columns: query_asm, contig, pos, end, svtype, svlen, source, coord_space, mate_contig, mate_pos, id.
SPANNING = ("INV", "DEL", "TDEL", "DUP")


def compatible(t: dict[str, Column], p: dict[str, Column]) -> Column:
    """Whether a truth and a predicted record of one contig and coordinate space may match.

    Near in position and similar in length; or the prediction spans the truth, which for deletions and duplications asks for at least twice
    its length. Translocations also need their mates on one contig and near.
    """
    group = S.type_group(t["svtype"]) == S.type_group(p["svtype"])
    tolerance, share = S.position_tolerance(t["svtype"]), S.length_tolerance(t["svtype"])
    size_t, size_p = F.abs(t["svlen"]), F.abs(p["svlen"])
    similar = (F.abs(size_t - size_p) <= share * F.greatest(size_t, F.lit(1))) | t["svtype"].startswith("TRA")
    near = (F.abs(t["pos"] - p["pos"]) <= tolerance) & similar
    holds = (p["pos"] <= t["pos"]) & (t["end"] <= p["end"])
    coarse = t["svtype"].isin(*SPANNING) & holds & (t["svtype"].isin("INV") | (size_p >= 2 * size_t))
    mates = ~t["svtype"].startswith("TRA") | (t["mate_contig"].eqNullSafe(p["mate_contig"]) & (F.abs(F.coalesce(t["mate_pos"], F.lit(0)) - F.coalesce(p["mate_pos"], F.lit(0))) <= tolerance))
    return group & (near | coarse) & mates


def candidate_pairs(truth: DataFrame, calls: DataFrame, width: int = 10_000, slack: int = 10_000) -> DataFrame:
    """Compatible pairs (truth_id, call_id, distance) by a bin join on query, contig, space and type group."""
    key = F.concat_ws("|", "query_asm", "contig", "coord_space", S.type_group(F.col("svtype")))
    names = ["pos", "end", "svtype", "svlen", "mate_contig", "mate_pos"]
    t = truth.select(key.alias("k"), F.col("id").alias("truth_id"), *[F.col(c).alias(f"t_{c}") for c in names])
    p = calls.select(key.alias("k"), F.col("id").alias("call_id"), *[F.col(c).alias(f"p_{c}") for c in names])
    both = intervals.overlap_join(t, p, "k", ("t_pos", "t_end"), ("p_pos", "p_end"), width, slack)
    column = lambda side: {c: F.col(f"{side}_{c}") for c in names}
    inside = (F.col("p_pos") <= F.col("t_pos")) & (F.col("t_end") <= F.col("p_end"))
    distance = F.when(inside, F.lit(0)).otherwise(F.abs(F.col("t_pos") - F.col("p_pos"))) + F.when(F.col("t_svtype").startswith("TRA"), F.lit(0)).otherwise(F.abs(F.abs("t_svlen") - F.abs("p_svlen")))
    return both.filter(compatible(column("t"), column("p"))).select("truth_id", "call_id", distance.alias("distance"))


def mutual_matches(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matches: a pair that is the best of both its ends is taken, its ends leave, and so on.

    With the total order (distance, truth_id, call_id) that gives the same matches as taking the sorted pairs one by one, round by round in parallel.
    It goes on until no pair is left: each round takes at least the best pair of all, and usually nearly all of them.
    """
    from strandlake.session import staged

    order = F.struct("distance", "truth_id", "call_id")
    left, taken = staged(pairs.distinct(), "pairs"), None
    while True:
        best_t = left.groupBy("truth_id").agg(F.min(order).alias("_bt"))
        best_c = left.groupBy("call_id").agg(F.min(order).alias("_bc"))
        now = staged(left.join(best_t, "truth_id").join(best_c, "call_id").filter((F.col("_bt") == order) & (F.col("_bc") == order)).select("truth_id", "call_id", "distance"), "matches")
        if not now.limit(1).count():
            break
        taken = now if taken is None else taken.union(now)
        left = staged(left.join(now.select("truth_id"), "truth_id", "left_anti").join(now.select("call_id"), "call_id", "left_anti").select("truth_id", "call_id", "distance"), "pairs")
    return taken if taken is not None else pairs.limit(0)


def nearest_pairs(truth_at: list, truth_id: list, call_at: list, call_id: list, tolerance: int) -> list[tuple[int, int, int]]:
    """Greedy one-to-one matches of places on a line in the order (distance, truth id, call id): (truth id, call id, distance). An id with several places is taken once.

    A place meets the next one on either side at which calls are left, nearest first; of one distance, truths take their turns by id. After a distance either the truths of a place or the calls
    of the other one are used up, so that what is held and done grows with the rows.
    """
    queue = lambda at, ids: {p: sorted({i for _, i in g}, reverse=True) for p, g in itertools.groupby(sorted(zip(at, ids, strict=True)), lambda x: x[0])}
    truths, calls = queue(truth_at, truth_id), queue(call_at, call_id)
    places = sorted(calls)
    ahead, behind = list(range(len(places) + 1)), list(range(len(places) + 1))
    used_t: set = set()
    used_c: set = set()
    out: list[tuple[int, int, int]] = []

    def head(queues: dict, p, used: set):
        """The least id at a place that is not used; those that are go."""
        q = queues.get(p)
        while q and q[-1] in used:
            q.pop()
        return q[-1] if q else None

    def shut(i: int) -> bool:
        """Whether no call is left at the i-th place; it is then passed over."""
        if head(calls, places[i], used_c) is not None:
            return False
        ahead[i], behind[i + 1] = i + 1, i
        return True

    def after(p, i: int, side: int):
        """The next place of calls from the i-th on, on one side of p: (distance, p, side, i)."""
        while True:
            i = Places._end(ahead, i) if side else Places._end(behind, i + 1) - 1
            if i < 0 or i >= len(places) or abs(places[i] - p) > tolerance:
                return None
            if not shut(i):
                return abs(places[i] - p), p, side, i

    waiting = []
    for p in truths:
        at = bisect.bisect_left(places, p)
        waiting += [x for x in (after(p, at, 1), after(p, at - 1, 0)) if x]
    heapq.heapify(waiting)
    while waiting:
        d, now = waiting[0][0], []
        while waiting and waiting[0][0] == d:
            _, p, side, i = heapq.heappop(waiting)
            if head(truths, p, used_t) is None:
                continue
            if shut(i):
                if further := after(p, i, side):
                    heapq.heappush(waiting, further)
            else:
                now.append((p, side, i))
        met: dict = {}
        for p, _, i in now:
            met.setdefault(p, set()).add(places[i])
        turns = [(head(truths, p, used_t), p) for p in met]
        heapq.heapify(turns)
        passed = {p: [] for p in met}  # truths that found no call at this distance
        while turns:
            t, own = turns[0][0], []
            while turns and turns[0][0] == t:
                own.append(heapq.heappop(turns)[1])
            free = [c for p in own for x in met[p] if (c := head(calls, x, used_c)) is not None]
            if free and t not in used_t:
                c = min(free)
                used_t.add(t)
                used_c.add(c)
                out.append((t, c, d))
            for p in own:
                # a place whose calls are used up is done at this distance
                if any(head(calls, x, used_c) is not None for x in met[p]):
                    q = truths[p]
                    if q and q[-1] == t:
                        q.pop()
                        if t not in used_t:
                            passed[p].append(t)
                    if (following := head(truths, p, used_t)) is not None:
                        heapq.heappush(turns, (following, p))
        for p, ids in passed.items():
            truths[p] += [i for i in reversed(ids) if i not in used_t]
        for p, side, i in now:
            if head(truths, p, used_t) is not None and (further := after(p, i + 1 if side else i - 1, side)):
                heapq.heappush(waiting, further)
    return out


def nearest_matches(truth: DataFrame, calls: DataFrame, key: str, tolerance: int) -> DataFrame:
    """(truth_id, call_id, distance): the matches of ``mutual_matches`` where the distance is that of places on a line, without their pairs.

    truth: key, truth_id, pos; calls: key, call_id, pos; ids are whole numbers, each of one key. A key is scanned over its sorted places, and cut at gaps beyond the tolerance unless an id has places on both sides of one.
    """
    one = truth.select(key, F.lit(0).alias("side"), F.col("truth_id").alias("id"), F.col("pos").cast("long").alias("pos"))
    two = calls.select(key, F.lit(1).alias("side"), F.col("call_id").alias("id"), F.col("pos").cast("long").alias("pos"))
    both = intervals.cut_at_gaps(one.union(two).filter("pos IS NOT NULL AND id IS NOT NULL").filter(F.col(key).isNotNull()), [key], "pos", tolerance)
    runs = both.select(key, "_run").distinct().groupBy(key).count().filter("count > 1")
    if runs.limit(1).count():
        split = both.join(runs.select(key), key, "left_semi").groupBy(key, "side", "id").agg(F.count_distinct("_run").alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"), F.lit(True).alias("_whole")).distinct()
        both = both.join(split, F.col(key) == F.col("_k"), "left").withColumn("_run", F.when(F.col("_whole").isNull(), F.col("_run"))).drop("_k", "_whole")

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        side, ids, pos = (table.column(c).to_numpy() for c in ("side", "id", "pos"))
        out: list[tuple[int, int, int]] = []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            middle = start + int(np.searchsorted(side[start:end], 1))
            if start < middle < end:
                out += nearest_pairs(pos[start:middle].tolist(), ids[start:middle].tolist(), pos[middle:end].tolist(), ids[middle:end].tolist(), tolerance)
        t, c, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"truth_id": pa.array(t, pa.int64()), "call_id": pa.array(c, pa.int64()), "distance": pa.array(d, pa.int64())})

    return _scanned(both, [key, "_run"], [F.col("side")], "truth_id bigint, call_id bigint, distance bigint", work)


def score_callsets(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, F1, Wilson bounds and status by type and over all; empty truth gives zeros and ``no_truth``."""
    matches = mutual_matches(candidate_pairs(truth, calls))
    t = truth.join(matches.select(F.col("truth_id").alias("id"), F.lit(1).alias("hit")), "id", "left").select("svtype", F.coalesce("hit", F.lit(0)).alias("tp"), (1 - F.coalesce("hit", F.lit(0))).alias("fn"), F.lit(0).alias("fp"), F.lit(1).alias("truth_calls"), F.lit(0).alias("pred_calls"))
    p = calls.join(matches.select(F.col("call_id").alias("id"), F.lit(1).alias("hit")), "id", "left").select("svtype", F.lit(0).alias("tp"), F.lit(0).alias("fn"), (1 - F.coalesce("hit", F.lit(0))).alias("fp"), F.lit(0).alias("truth_calls"), F.lit(1).alias("pred_calls"))
    sums = t.union(p).groupBy("svtype").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "truth_calls", "pred_calls")))
    rows = sums.rollup("svtype").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "truth_calls", "pred_calls"))).withColumn("svtype", F.coalesce("svtype", F.lit("ALL")))
    precision, recall = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    low, high = S.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return rows.select("*", precision.alias("precision"), recall.alias("recall"), S.f1(precision, recall).alias("f1"), low.alias("prec_lo95"), high.alias("prec_hi95"), F.when(F.col("truth_calls") == 0, "no_truth").otherwise("ok").alias("status"))


def consensus_truth(calls: DataFrame, tolerance: int = 500, least_support: int = 2) -> DataFrame:
    """Calls that at least ``least_support`` - 1 other sources support directly within the tolerance, one for each cluster.

    Support is of the call itself: two calls of one source never bridge two others. The call with most support, then the smallest position, stands
    for its neighbours.
    """
    key = F.concat_ws("|", "query_asm", "contig", S.type_group(F.col("svtype")))
    a = calls.select(key.alias("k"), F.col("id"), F.col("pos").alias("a_pos"), F.col("source").alias("a_source"))
    b = calls.select(key.alias("k"), F.col("pos").alias("b_pos"), F.col("source").alias("b_source"))
    near = intervals.overlap_join(a, b, "k", ("a_pos", "a_pos"), ("b_pos", "b_pos"), max(1, tolerance), tolerance)
    support = near.groupBy("id").agg(F.count_distinct("b_source").alias("support")).filter(F.col("support") >= least_support)
    held = calls.join(support, "id").withColumn("k", key)
    best = Window.partitionBy("k").orderBy("pos", "id")
    fresh = F.when(F.col("pos") - F.lag("pos").over(best) > tolerance, 1).otherwise(0)
    islands = held.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(best.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(F.col("support"), (-F.col("pos")).alias("p"), (-F.col("id")).alias("i"))
    return collapse(islands, ["k", "_island"], order).drop("k", "_new", "_island")


def locus_key(width: int = 500) -> Column:
    """Assembly, contig, type and binned position; translocations also by their mates."""
    mate = F.when(F.col("svtype").startswith("TRA"), F.concat_ws(":", F.coalesce("mate_contig", F.lit(".")), F.floor(F.coalesce("mate_pos", F.lit(0)) / width).cast("string"))).otherwise("")
    return F.concat_ws("|", "query_asm", "contig", S.type_group(F.col("svtype")), F.floor(F.col("pos") / width).cast("string"), mate)


def call_layers(calls: DataFrame) -> DataFrame:
    """Per sample: raw observations, loci, loci a single reference has too, pangenome-only ones, and those with read support."""
    loci = calls.groupBy("query_asm", locus_key().alias("locus")).agg(F.count("*").alias("raw"), F.max(F.coalesce("single_reference", F.lit(False)).cast("int")).alias("single"), F.max(F.coalesce("read_support", F.lit(0))).alias("reads"))
    only = F.col("single") == 0
    return loci.groupBy("query_asm").agg(F.sum("raw").alias("raw_pairwise_pangenome_observations"), F.count("*").alias("deduplicated_pangenome_loci"), F.count_if(~only).alias("single_reference_equivalent_calls"), F.count_if(only).alias("pangenome_only_calls"), F.count_if(only & (F.col("reads") > 0)).alias("pangenome_only_read_supported"))


def projected_dedup(calls: DataFrame, width: int = 25) -> DataFrame:
    """Projected calls of one locus become the one with most read support; its keys are all listed."""
    locus = F.concat_ws("|", "contig", "svtype", F.floor((F.col("pos") + width // 2) / width).cast("string"))
    grouped = calls.groupBy(locus.alias("locus")).agg(F.max_by(F.struct(*calls.columns), F.struct("read_support", (-F.col("id")).alias("i"))).alias("r"), F.array_sort(F.collect_set("id")).alias("ids"))
    return grouped.select("r.*", "ids")


def volume_audit(volumes: DataFrame) -> DataFrame:
    """Status of each sample's call volume against the median of its comparators."""
    share = F.try_divide("pred_calls", "comparator_median")
    status = F.when(F.col("pred_calls") == 0, "fail").when(share < 0.2, "low").when(share > 5, "high").otherwise("ok")
    reason = F.when(status == "fail", "no calls").when(status == "low", "far fewer calls than comparators").when(status == "high", "far more calls than comparators").otherwise("comparable")
    return volumes.select("*", status.alias("status"), reason.alias("diagnosis"))


def enrichment(rows: DataFrame, unique: str, features: list[str]) -> DataFrame:
    """A 2x2 table, odds ratio and right-tailed Fisher test of each feature among unique against shared calls."""
    long = rows.select(F.col(unique).alias("u"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f), F.lit(False)).alias("has")) for f in features])).alias("x")).select("u", "x.*")
    cells = long.groupBy("feature").agg(F.count_if(F.col("u") & F.col("has")).alias("a"), F.count_if(F.col("u") & ~F.col("has")).alias("b"), F.count_if(~F.col("u") & F.col("has")).alias("c"), F.count_if(~F.col("u") & ~F.col("has")).alias("d"))
    tested = cells.withColumn("odds_ratio", S.odds_ratio(*map(F.col, "abcd"))).withColumn("p", stats.fisher_right("a", "b", "c", "d"))
    return tested.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * len(features)))


def comparator_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, chance baseline, enrichment and a verdict from (tp, calls, comparators, universe)."""
    base = S.ratio(F.col("comparators"), F.col("universe"))
    precision = S.ratio(F.col("tp"), F.col("calls"))
    scored = counts.select("*", precision.alias("precision"), S.ratio(F.col("tp"), F.col("comparators")).alias("recall"), base.alias("base"), S.ratio(precision, base).alias("enrichment"), (base * F.col("calls")).alias("expected_tp"), stats.binomial_tail("tp", "calls", base).alias("p"))
    verdict = F.when(F.col("expected_tp") < 1, "underpowered").when((F.col("p") <= 0.05) & (F.col("enrichment") > 1), "enriched").otherwise("not enriched")
    return scored.withColumn("verdict", verdict)


def file_order_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches in the order of the calls: each takes the nearest truth that no earlier call has taken.

    pairs: truth_id, call_id, distance, and the places of both in their files, truth_order and call_order (no two calls have one place). In each round a call takes its nearest
    truth that is left if no earlier call that still waits could; that is what it would get if all took their turns. So there are as many rounds as calls that wait for one
    another in a row, and never more pairs than at the start.
    """
    from strandlake.session import staged

    columns = ["truth_id", "call_id", "distance", "truth_order", "call_order"]
    left, taken = staged(pairs.select(*columns).distinct(), "turns"), None
    while True:
        waiting = left.groupBy("truth_id").agg(F.min("call_order").alias("_first"))
        wish = left.groupBy("call_id").agg(F.min(F.struct("distance", "truth_order", "truth_id")).alias("_w"), F.min("call_order").alias("call_order"))
        now = wish.select("call_id", "call_order", F.col("_w.truth_id").alias("truth_id"), F.col("_w.distance").alias("distance")).join(waiting, "truth_id").filter(F.col("_first") == F.col("call_order"))
        now = staged(now.select("truth_id", "call_id", "distance"), "turns")
        if not now.limit(1).count():
            break
        taken = now if taken is None else taken.union(now)
        left = staged(left.join(now.select("truth_id"), "truth_id", "left_anti").join(now.select("call_id"), "call_id", "left_anti").select(*columns), "turns")
    return taken if taken is not None else pairs.select("truth_id", "call_id", "distance").limit(0)


#: Types whose lengths callers report by conventions of their own; they are not compared.
OWN_SPANS = ("OFF_REF", "INS", "TRA", "INV", "DUP")


def within_window(truth: DataFrame, calls: DataFrame, window: int) -> DataFrame:
    """Pairs of one query, contig and type whose places differ by at most ``window``, and lengths too where they are compared.

    truth: truth_id, truth_order; calls: call_id, call_order; both: query_asm, contig, svtype, pos, svlen.
    """
    key = F.concat_ws("|", "query_asm", "contig", "svtype")
    t = truth.select(key.alias("k"), "truth_id", "truth_order", F.col("pos").alias("tp"), F.col("pos").alias("te"), F.col("svlen").alias("tl"))
    p = calls.select(key.alias("k"), "call_id", "call_order", F.col("pos").alias("cp"), F.col("pos").alias("ce"), F.col("svlen").alias("cl"), "svtype")
    both = intervals.overlap_join(t, p, "k", ("tp", "te"), ("cp", "ce"), max(1, window), window)
    far = F.abs(F.col("tp") - F.col("cp"))
    return both.filter((far <= window) & (F.col("svtype").isin(*OWN_SPANS) | (F.abs(F.col("tl") - F.col("cl")) <= window))).select("truth_id", "call_id", far.alias("distance"), "truth_order", "call_order")


class Places:
    """What is still free at sorted places: numbers of rows, the least of a place first; empty places are passed over at once.

    With sizes, the rows of a place are kept apart by theirs, so that a look-up meets one row of each size in question.
    """

    def __init__(self, places: list, rows: list[int], sizes: list | None = None) -> None:
        held: dict = {}
        for i, (p, row) in enumerate(zip(places, rows, strict=True)):
            held.setdefault(p, {}).setdefault(sizes[i] if sizes else 0, []).append(row)
        self.places = sorted(held)
        self.queues = [{s: sorted(q, reverse=True) for s, q in held[p].items()} for p in self.places]
        self.sizes = [sorted(q) for q in self.queues]
        self.ahead = list(range(len(self.places) + 1))  # the next place that is not empty; the last one is none
        self.behind = list(range(len(self.places) + 1))  # the same backward, by one more; 0 is none

    @staticmethod
    def _end(way: list[int], i: int) -> int:
        end = i
        while way[end] != end:
            end = way[end]
        while way[i] != end:
            way[i], i = end, way[i]
        return end

    def _first(self, i: int, low: float, high: float) -> tuple[int, object] | None:
        """The least row of a place with a size of that range, and its size."""
        sizes, best = self.sizes[i], None
        for j in range(bisect.bisect_left(sizes, low), len(sizes)):
            if sizes[j] > high:
                break
            row = self.queues[i][sizes[j]][-1]
            if best is None or row < best[0]:
                best = row, sizes[j]
        return best

    def take(self, place, window: int, low: float = 0, high: float = 0) -> tuple[int, int] | None:
        """Takes the nearest free row within ``window`` whose size lies in the range, the least row among equals: (row, distance)."""
        at = bisect.bisect_left(self.places, place)
        r, l = self._end(self.ahead, at), self._end(self.behind, at)
        while True:
            right = self.places[r] - place if r < len(self.places) else window + 1
            left = place - self.places[l - 1] if l else window + 1
            d = min(left, right)
            if d > window:
                return None
            found = [(f, i) for i, far in ((l - 1, left), (r, right)) if far == d and (f := self._first(i, low, high))]
            if found:
                (row, size), i = min(found)
                self.queues[i][size].pop()
                if not self.queues[i][size]:
                    self.sizes[i].remove(size)
                    if not self.sizes[i]:
                        self.ahead[i], self.behind[i + 1] = i + 1, i
                return row, d
            if left == d:
                l = self._end(self.behind, l - 1)
            if right == d:
                r = self._end(self.ahead, r + 1)


def matched_in_turn(truth: DataFrame, calls: DataFrame, window: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(call_id, truth_id, distance, *more): each call in the order of its file takes the nearest truth of ``within_window`` that none before it has; null where there is none.

    The same matches as ``file_order_matches`` of all pairs, which are not made: the calls of a query, contig and type are scanned in order, over the truths that are left. A contig is
    cut at gaps wider than the window. What one scan holds grows with its rows; ids are of one truth, or one call, each. ``more`` are columns of the calls.
    """
    key = F.concat_ws("|", "query_asm", "contig", "svtype").alias("k")
    sized = F.coalesce(~F.col("svtype").isin(*OWN_SPANS), F.lit(True)).alias("sized")
    row = lambda side, name, order: ["k", "sized", F.lit(side).alias("side"), F.col(name).alias("id"), F.col(order).alias("turn"), F.col("pos").cast("long").alias("pos"), F.col("svlen").alias("size")]
    named = {c: f"_m{i}" for i, c in enumerate(more)}
    one = truth.select("*", key, sized).select(*row(0, "truth_id", "truth_order"), *[F.lit(None).cast(calls.schema[c].dataType).alias(n) for c, n in named.items()])
    two = calls.select("*", key, sized).select(*row(1, "call_id", "call_order"), *[F.col(c).alias(n) for c, n in named.items()])
    both = intervals.cut_at_gaps(one.union(two), ["k"], "pos", window)

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        side, by_size = table.column("side").to_numpy(), table.column("sized").to_pylist()
        pos, size = table.column("pos").to_pylist(), table.column("size").to_pylist()
        rows, of, far = [], [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            middle = start + int(np.searchsorted(side[start:end], 1))
            known = [i for i in range(start, middle) if pos[i] is not None and (not by_size[i] or size[i] is not None)]
            free = Places([pos[i] for i in known], known, [size[i] for i in known] if by_size[start] else None)
            for i in range(middle, end):
                span = (size[i] - window, size[i] + window) if by_size[i] and size[i] is not None else (0, 0)
                found = None if pos[i] is None or (by_size[i] and size[i] is None) else free.take(pos[i], window, *span)
                rows.append(i)
                of.append(None if found is None else found[0])
                far.append(None if found is None else found[1])
        taken = table.take(pa.array(rows, pa.int64()))
        ids = table.column("id").take(pa.array(of, pa.int64()))
        return pa.table({"call_id": taken.column("id"), "truth_id": ids, "distance": pa.array(far, pa.int64()), **{c: taken.column(n) for c, n in named.items()}})

    kind = calls.schema["call_id"].dataType.simpleString()
    fields = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in more)
    return _scanned(both, ["k", "_run"], [F.col("side"), F.col("turn"), F.col("id")], f"call_id {kind}, truth_id {kind}, distance bigint" + (f", {fields}" if more else ""), work)


def two_axis(truth: DataFrame, calls: DataFrame, window: int) -> DataFrame:
    """(axis, scenario, truth_calls, tp, fp, fn, precision, recall): calls matched in file order, by scenario and, as ``PANEL``, in all.

    On the axis ``single`` only calls of their query's own scenario take part; on ``pangenome`` all do, and those of others that find nothing are discoveries, not errors. The scenario of a
    query is that of its first truth. truth and calls as for ``within_window``, with ``scenario``, and for calls ``same_scenario``.
    """
    of = truth.groupBy("query_asm").agg(F.min_by("scenario", "truth_order").alias("scenario"), F.count("*").alias("truth_calls"))
    calls = calls.join(of.select("query_asm"), "query_asm", "left_semi")
    found = []
    for axis, eligible in (("single", calls.filter("same_scenario")), ("pangenome", calls)):
        matched = matched_in_turn(truth, eligible, window, ("query_asm", "same_scenario"))
        hits = matched.groupBy("query_asm").agg(F.count_if(F.col("truth_id").isNotNull()).alias("tp"), F.count_if(F.col("truth_id").isNull() & F.col("same_scenario")).alias("fp"))
        found.append(of.join(hits, "query_asm", "left").select(F.lit(axis).alias("axis"), "scenario", "truth_calls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp")))
    sums = found[0].union(found[1]).groupingSets([["axis", "scenario"], ["axis"]], "axis", "scenario").agg(*[F.sum(c).alias(c) for c in ("truth_calls", "tp", "fp")], F.grouping("scenario").alias("_g"))
    rows = sums.select("axis", F.when(F.col("_g") == 1, "PANEL").otherwise(F.col("scenario")).alias("scenario"), "truth_calls", "tp", "fp", (F.col("truth_calls") - F.col("tp")).alias("fn"))
    return rows.select("*", S.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), S.ratio(F.col("tp"), F.col("truth_calls")).alias("recall"))


def followup_buckets(rows: DataFrame) -> DataFrame:
    """Validation buckets by priority: class, priority, how many, and what is recommended."""
    bucket = F.when(F.col("class").startswith("hgt"), "transfer").when(F.col("class").contains("expression"), "expression").when(F.col("class").contains("te"), "mobile_element").otherwise("structural")
    advice = F.when(bucket == "transfer", "phylogeny and PCR").when(bucket == "expression", "RNA and PCR").when(bucket == "mobile_element", "long reads").otherwise("read realignment")
    return rows.groupBy(bucket.alias("bucket"), advice.alias("recommended")).agg(F.count("*").alias("n"), F.max("priority").alias("priority"))


def expression_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate: records, significant ones, and the best (significant first, then largest change, then nearest)."""
    significant = (F.col("padj") <= 0.05) & (F.abs("log2_fc") >= 1)
    order = F.struct(F.when(significant, 0).otherwise(1), -F.abs("log2_fc"), "distance_bp", "gene_id")
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(significant).alias("significant"), F.min_by("gene_id", order).alias("best_gene"), F.min_by("log2_fc", order).alias("best_fc"), F.bool_or(significant).alias("supported"))


def expression_contrast(samples: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The pair of conditions with the largest difference of mean log2 expression of each gene, with Welch's p and BH over genes."""
    x = F.log2(F.greatest(F.lit(0.0), F.col("expression")) + 1)
    s = samples.groupBy(*keys, "condition").agg(F.count("*").alias("n"), F.avg(x).alias("m"), stats.sample_variance(x).alias("v")).filter(F.col("n") >= least)
    o = s.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("condition", "n", "m", "v")])
    # pairs are of a gene's few conditions
    pairs = s.join(o, keys).filter((F.col("m") > F.col("o_m")) | ((F.col("m") == F.col("o_m")) & (F.col("condition") < F.col("o_condition"))))
    order = F.struct(F.abs(F.col("m") - F.col("o_m")), "condition", "o_condition")
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct("condition", "o_condition", "m", "o_m", "v", "o_v", "n", "o_n"), order).alias("r")).select(*keys, "r.*")
    tested = best.select(*keys, F.concat_ws("_vs_", "condition", "o_condition").alias("contrast"), (F.col("m") - F.col("o_m")).alias("log2_fc"), stats.welch("m", "v", "n", "o_m", "o_v", "o_n").alias("p"))
    return stats.benjamini_hochberg(tested, "p", "padj")


def panel_rates(sources: DataFrame) -> DataFrame:
    """Validated calls by sample: a call is validated if any source says so; rate and Wilson interval."""
    calls = sources.groupBy("query_asm", "contig", "pos", "end", "svtype").agg(F.max((F.col("read_validated") == "yes").cast("int")).alias("yes"))
    rows = calls.groupBy("query_asm").agg(F.count("*").alias("total"), F.sum("yes").alias("yes"))
    low, high = S.wilson(F.col("yes"), F.col("total"))
    return rows.select("*", S.ratio(F.col("yes"), F.col("total")).alias("rate"), low.alias("lo"), high.alias("hi"))


def wins_subset(rows: DataFrame, label: str) -> DataFrame:
    """Only the best available kind of truth label: read-level union, else read-supported, else consensus."""
    rank = F.when(F.col(label) == "read_level_union", 0).when(F.col(label).endswith("_read_supported"), F.when(F.col(label).startswith("consensus"), 1).otherwise(2)).when(F.col(label).startswith("consensus"), 3).otherwise(4)
    return rows.join(F.broadcast(rows.agg(F.min(rank).alias("_m"))), rank == F.col("_m")).drop("_m")


def predicted_counts(rows: DataFrame) -> DataFrame:
    """The largest reported count of a sample, caller and type; rows of any clade and, where query space exists, others are left out."""
    kept = rows.filter("coalesce(filter, '') NOT LIKE '%any_clade%'")
    has_query = F.max((F.col("coordinate_space") == "query").cast("int")).over(Window.partitionBy("query_asm", "method", "svtype"))
    return kept.withColumn("_q", has_query).filter((F.col("_q") == 0) | (F.col("coordinate_space") == "query")).groupBy("query_asm", "method", "svtype").agg(F.max("pred_calls").alias("pred_calls"))
