"""Graphs of segments: nodes, edges, bubbles, components, sub-clades, ancestors; and assembly of reads."""

from __future__ import annotations

import bisect
import operator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.calling import reverse_complement
from strandlake.session import staged


def segments(contigs: DataFrame, name: str, seq: str, size: int = 10_000, overlap: int = 1000) -> DataFrame:
    """Overlapping windows of contigs in order: name, pos, start, segment."""
    from strandlake.functions.sequence import positional_windows

    rows = contigs.select(name, seq, F.posexplode(positional_windows(F.length(seq), size, overlap)).alias("pos", "start"))
    return rows.select(name, "pos", "start", F.substring(F.col(seq), F.col("start") + 1, F.lit(size)).alias("segment"))


def clade_graph(parts: DataFrame, path: str, pos: str, segment: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, segment, support), paths (path, pos, node) and edges (a, b, support); equal segments are one node."""
    named = parts.withColumn("node", F.substring(F.md5(segment), 1, 16))
    nodes = named.groupBy("node").agg(F.min(segment).alias("segment"), F.count_distinct(path).alias("support"))
    steps = named.select(path, pos, "node")
    order = Window.partitionBy(path).orderBy(pos)
    pairs = steps.select(path, F.col("node").alias("a"), F.lead("node").over(order).alias("b")).filter("b IS NOT NULL")
    return nodes, steps, pairs.groupBy("a", "b").agg(F.count_distinct(path).alias("support"))


def bubbles(steps: DataFrame, path: str, pos: str, genomes: int) -> DataFrame:
    """Contexts (prev, next) with several nodes between them and enough support: prev, next, alleles, support."""
    order = Window.partitionBy(path).orderBy(pos)
    inner = steps.select(path, "node", F.lag("node").over(order).alias("prev"), F.lead("node").over(order).alias("next")).filter("prev IS NOT NULL AND next IS NOT NULL")
    found = inner.groupBy("prev", "next").agg(F.count_distinct("node").alias("alleles"), F.count_distinct(path).alias("support"))
    return found.filter((F.col("alleles") > 1) & (F.col("support") >= max(1, -(-genomes * 5 // 100))))


#: When two segments are one node, and what a bubble's alleles must differ by.
SAME_SKETCH, SAME_ENDS = 0.50, 0.85
LEAST_ALT, LEAST_OVERLAP = 100, 0.05


def collapsed(parts: DataFrame, key: str, segment: str, annotation: str, representative: str, k: int = 15) -> DataFrame:
    """(key, node): segments that are alike share the node of the first of them, representatives first.

    Only segments of one annotation, length class (by 250) and equal ends (12 bases) are compared: equal ones at once, others in order with the nodes so far, by the Jaccard
    similarity of their k-mers or that of their ends.
    """
    from strandlake.functions.evidence import ends_alike
    from strandlake.operators.selection import _scanned

    name = F.substring(F.md5(F.concat_ws("|", annotation, segment)), 1, 16)
    bucket = F.concat_ws("|", annotation, F.floor(F.length(segment) / 250), F.substring(segment, 1, 12), F.substring(F.col(segment), -12, 12))
    named = parts.select(key, F.col(segment).alias("seq"), name.alias("own"), bucket.alias("bucket"), F.coalesce(F.col(representative), F.lit(False)).alias("first"))
    distinct = named.groupBy("bucket", "own").agg(F.min("seq").alias("seq"), F.max("first").alias("first"), F.min(key).alias("key"))

    def work(table, cuts):
        import pyarrow as pa

        seqs, owns, nodes = table.column("seq").to_pylist(), table.column("own").to_pylist(), []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            kept: list[tuple[str, str, set[str]]] = []
            for i in range(low, high):
                words = {seqs[i][j : j + k] for j in range(len(seqs[i]) - k + 1)}
                for node, seq, other in kept:
                    shared = len(words & other)
                    if shared and shared >= SAME_SKETCH * (len(words) + len(other) - shared) or ends_alike(seqs[i], seq) >= SAME_ENDS:
                        nodes.append(node)
                        break
                else:
                    kept.append((owns[i], seqs[i], words))
                    nodes.append(owns[i])
        return pa.table({"own": table.column("own"), "node": pa.array(nodes)})

    found = _scanned(distinct, ["bucket"], [F.col("first").desc(), F.col("key"), F.col("own")], "own string, node string", work)
    return named.select(key, "own").join(found, "own").select(key, "node")


def compact_graph(parts: DataFrame, clade: str, row_id: str, segment: str, n: int = 64, size: int = 512) -> DataFrame:
    """(clade, node, support, number): the distinct seeds of a reservoir of each clade's rows (a sampling operator), numbered by their digest."""
    from strandlake.operators.routing import reservoir

    seeds = reservoir(parts.select(clade, row_id, F.substring(segment, 1, size).alias("seed")).filter("seed != ''"), clade, row_id, n)
    nodes = seeds.groupBy(clade, F.md5("seed").alias("node")).agg(F.count("*").alias("support"))
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy(clade).orderBy("node")))


#: The lengths of variants that are called.
LEAST_VARIANT, MOST_VARIANT = 40, 1_000_000


#: Steps of a path in one packed row at most, and steps of a clade that are walked at once.
PACKED_STEPS, WALKED_STEPS = 1000, 500_000


def _packed(rows: DataFrame) -> DataFrame:
    """(_clade, _path, _contig, _n, _ns, _letters, _sizes): steps that follow each other in a partition as one row, so that what is shuffled is little more than their letters.

    ``_n`` is the first step's place, and ``_ns`` all of them where they are not consecutive.
    """

    def apply(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[::PACKED_STEPS] = True
            for name in ("_clade", "_path"):
                column = batch.column(name)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            edges, n = [*at.tolist(), len(batch)], batch.column("_n").to_numpy()
            heads = [batch.column(name).take(pa.array(at)) for name in ("_clade", "_path", "_contig", "_n")]
            ns = pa.array([None if (np.diff(n[i:j]) == 1).all() else n[i:j] for i, j in pairwise(edges)], pa.list_(pa.int64()))
            words = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column("_seq"))
            sizes = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pc.utf8_length(batch.column("_seq")))
            yield pa.RecordBatch.from_arrays([*heads, ns, pc.binary_join(words, ""), sizes], names=["_clade", "_path", "_contig", "_n", "_ns", "_letters", "_sizes"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    heads = ", ".join(f"{name} {kinds[name]}" for name in ("_clade", "_path", "_contig"))
    return rows.select("_clade", "_path", "_contig", "_n", "_seq").mapInArrow(apply, f"{heads}, _n bigint, _ns array<bigint>, _letters string, _sizes array<int>")


def _words(packed: DataFrame) -> DataFrame:
    """(_clade, _contig, _node): the distinct segments of each packed row."""

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            words = [list({x[i:j] for i, j in pairwise(accumulate(n, initial=0))}) for x, n in zip(batch.column("_letters").to_pylist(), batch.column("_sizes").to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(batch)), [len(w) for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("_clade").take(at), batch.column("_contig").take(at), pa.array([x for w in words for x in w], pa.string())], names=["_clade", "_contig", "_node"])

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    return packed.select("_clade", "_contig", "_letters", "_sizes").mapInArrow(apply, f"_clade {kinds['_clade']}, _contig {kinds['_contig']}, _node string")


def _nearest(places: list[int], at: int) -> int:
    """Of sorted places the one nearest to ``at``, the first of two."""
    i = bisect.bisect_left(places, at)
    if i == len(places) or i and at - places[i - 1] <= places[i] - at:
        i -= 1
    return places[i]


def _walked(rows: DataFrame, least: int, most: int) -> DataFrame:
    """The bubbles of packed rows (those of the reference marked by ``_ref``), equal ones of a shard once: places on the reference, both alleles, the paths, and of the first path the distinct nodes between where ``_many`` is set.

    ``ref`` is only there where the kind of the bubble depends on it.
    """
    from strandlake.operators.selection import _scanned

    def steps(parts: list[tuple]) -> list[str]:
        order, out = [], []
        for n, ns, letters, sizes in parts:
            order += ns or range(n, n + len(sizes))
            out += [letters[i:j] for i, j in pairwise(accumulate(sizes, initial=0))]
        if any(map(operator.gt, order, order[1:])):
            out = [out[i] for i in sorted(range(len(out)), key=order.__getitem__)]
        return out

    def of_path(words: list[str], size: int, places: dict[str, list[int]]):
        """gap, ref_start, ref_end, first and last position (exclusive) of what lies between, of each bubble."""
        before, last, gap = -1, -1, 0
        for pos, word in enumerate(words):
            own = places.get(word)
            if own is None:
                continue
            chosen = own[0] if len(own) == 1 else _nearest(own, last + 1)
            if pos > before + 1 or chosen != last + 1:
                yield gap, last, chosen if chosen > last else last + 1, before + 1, pos
            before, last, gap = pos, chosen, gap + 1
        if before + 1 < len(words):
            yield gap, last, size, before + 1, len(words)

    def work(table, cuts):
        import pyarrow as pa

        at, rows, found = [], [], [[] for _ in range(8)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            group = table.slice(low, high - low)
            if not group.column("_ref")[0].as_py():
                continue
            names, parts = group.column("_path").to_pylist(), list(zip(*(group.column(name).to_pylist() for name in ("_n", "_ns", "_letters", "_sizes")), strict=True))
            many, edges = group.column("_many")[0].as_py(), [i for i in range(high - low) if not i or names[i] != names[i - 1]] + [high - low]
            ref, places, known = steps(parts[: edges[1]]), {}, {}
            sums = [0, *accumulate(map(len, ref))]
            for i, word in enumerate(ref):
                places.setdefault(word, []).append(i)
            for first, end in pairwise(edges[1:]):
                words = steps(parts[first:end])
                for gap, start, stop, a, b in of_path(words, len(ref), places):
                    alt, n = "".join(words[a:b]), max(0, sums[stop] - sums[start + 1])
                    m = len(alt)
                    if not least <= max(n, m) <= most or not (n or m):
                        continue
                    if (start, stop, alt) in known:
                        known[start, stop, alt].append(names[first])
                        continue
                    known[start, stop, alt] = [names[first]]
                    allele = "".join(ref[start + 1 : stop]) if n and (n == m or m >= 2 * n) else None
                    if allele is not None and n != m and not alt.startswith(allele + allele):
                        allele = None
                    at.append(low + first)
                    for column, value in zip(found, (gap, start, stop, alt, n, m, allele, list(set(words[a:b])) if many else None), strict=True):
                        column.append(value)
            rows += known.values()
        out = table.select(["_clade", "_path", "_contig", "_whole"]).take(pa.array(at, pa.int64()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
        for name, column, kind in zip(("_gap", "ref_start", "ref_end", "alt", "ref_len", "alt_len", "ref", "_nodes"), found, kinds, strict=True):
            out = out.append_column(name, pa.array(column, kind))
        return out.append_column("paths", pa.array(rows, pa.list_(table.schema.field("_path").type)))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    heads = ", ".join(f"{name} {kinds[name]}" for name in ("_clade", "_path", "_contig", "_whole"))
    schema = f"{heads}, _gap bigint, ref_start bigint, ref_end bigint, alt string, ref_len bigint, alt_len bigint, ref string, _nodes array<string>, paths array<{kinds['_path']}>"
    return _scanned(rows, ["_clade", "_shard"], [F.col("_ref").desc(), F.col("_path"), F.col("_n")], schema, work)


def bubble_calls(steps: DataFrame, clade: str, path: str, contig: str, pos: str, segment: str, least: int = LEAST_VARIANT, most: int = MOST_VARIANT, k: int = 15, with_allele: bool = False) -> DataFrame:
    """(clade, ref_start, ref_end, svtype, ref_len, alt_len, svlen, off_ref, overlap, partners, paths): variants of each clade's paths against its longest one.

    Equal segments are one node. A path is followed from one node of the reference to the next; of several places of a node on the reference it takes the one nearest to where it would go on. Whatever
    nodes lie between, however many, and whatever of the reference is passed over, are the two alleles of a bubble, by places on the reference (both ends exclusive); steps back have no reference allele.
    A bubble any of whose nodes also lies on other contigs than its path's is a translocation, with those as partners. Otherwise it is an inversion (the other strand, of one length), a duplication
    (that begins with two copies of the reference's), an insertion or deletion by its length, or complex. ``overlap`` is the share of an allele's k-mers that the reference has, for those of
    100 bases or more; below a twentieth it is off the reference. Equal alleles at one place are one call with all their paths; the first path by name tells its contig. The longest path, by name
    among equals, is the reference. Paths have one contig; a null segment is empty. ``with_allele`` adds the allele's letters (``alt``).
    A task holds a clade's reference with some ``WALKED_STEPS`` other steps (a path is not cut).
    """
    rows = steps.select(F.col(clade).alias("_clade"), F.col(path).alias("_path"), F.col(contig).alias("_contig"), F.col(pos).cast("long").alias("_n"), F.coalesce(segment, F.lit("")).alias("_seq"))
    return _called(_packed(rows.filter("_clade IS NOT NULL AND _path IS NOT NULL")), clade, least, most, k, with_allele)


def bubbles_of_paths(paths: DataFrame, clade: str, path: str, contig: str, segments: str, least: int = LEAST_VARIANT, most: int = MOST_VARIANT, k: int = 15, with_allele: bool = False) -> DataFrame:
    """``bubble_calls`` of paths whose segments are one array of strings a row, in order."""
    words = F.transform(segments, lambda x: F.coalesce(x, F.lit("")))
    rows = paths.filter(F.col(clade).isNotNull() & F.col(path).isNotNull() & (F.size(segments) > 0)).select(
        F.col(clade).alias("_clade"), F.col(path).alias("_path"), F.col(contig).alias("_contig"), F.lit(0).cast("long").alias("_n"), F.lit(None).cast("array<bigint>").alias("_ns"), F.array_join(words, "").alias("_letters"), F.transform(words, F.length).alias("_sizes")
    )
    return _called(rows, clade, least, most, k, with_allele)


def _called(packed: DataFrame, clade: str, least: int, most: int, k: int, with_allele: bool) -> DataFrame:
    from strandlake.functions import sequence as Q
    from strandlake.operators.sketch import BROADCAST_ROWS

    packed = staged(packed, "steps")
    sizes = packed.groupBy("_clade", "_path").agg(F.sum(F.length("_letters")).alias("_size"), F.sum(F.size("_sizes")).alias("_steps"), F.min("_contig").alias("_c0"), F.max("_contig").alias("_c1"))
    chosen = F.struct(-F.col("_size"), F.col("_path"))
    clades = sizes.groupBy("_clade").agg(F.min_by("_path", chosen).alias("_longest"), F.min_by("_steps", chosen).alias("_own"), F.sum("_steps").alias("_steps"), F.coalesce(F.min("_c0") != F.max("_c1"), F.lit(False)).alias("_many"))
    # a clade of many steps is walked in shards, each with the reference: few enough that its copies are no more than a quarter of the steps
    shards = F.ceil(F.col("_steps") / F.greatest(F.lit(WALKED_STEPS), 4 * F.col("_own"))).cast("int")
    clades = staged(clades.select("_clade", "_longest", "_many", shards.alias("_shards")), "clades")
    count, split = clades.agg(F.count("*"), F.count_if(F.col("_shards") > 1)).first()
    marked = packed.join(F.broadcast(clades) if count <= BROADCAST_ROWS else clades, "_clade").withColumns({"_ref": F.col("_path") == F.col("_longest"), "_whole": F.col("_shards") == 1})
    every = F.when(F.col("_ref"), F.sequence(F.lit(0), F.col("_shards") - 1)).otherwise(F.array(F.pmod(F.xxhash64("_path"), F.col("_shards")).cast("int")))
    found = _walked(marked.select("_clade", F.explode(every).alias("_shard"), "_path", "_contig", "_n", "_ns", "_letters", "_sizes", "_ref", "_many", "_whole"), least, most)
    named = F.md5(F.concat_ws("|", F.col("_clade").cast("string"), "ref_start", "ref_end", "alt")).alias("_id")
    one = staged(found.select("*", named), "calls")
    if split:
        first = F.min_by(F.struct("_path", "_contig", "_gap", "_nodes"), F.struct("_path", "_gap")).alias("_f")
        kept = [F.first(c).alias(c) for c in ("_clade", "_whole", "ref_start", "ref_end", "alt", "ref_len", "alt_len", "ref")]
        met = one.filter("NOT _whole").groupBy("_id").agg(*kept, first, F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths")).select("*", "_f.*").drop("_f")
        one = staged(one.filter("_whole").unionByName(met), "calls")
    # contigs of the nodes between, but for the first path's own; a clade of one contig has none
    homes = _words(packed.join(clades.filter("_many").select("_clade"), "_clade", "left_semi")).select("_clade", "_node", "_contig").distinct()
    foreign = one.filter("_nodes IS NOT NULL").select("_id", "_clade", F.explode("_nodes").alias("_node"), F.col("_contig").alias("_own")).join(homes, ["_clade", "_node"]).filter("_contig != _own")
    partners = foreign.groupBy("_id").agg(F.array_sort(F.collect_set("_contig")).alias("partners"))
    alone = one.filter("_nodes IS NULL").withColumn("partners", F.lit(None).cast("array<string>"))
    called = one.filter("_nodes IS NOT NULL").join(partners, "_id", "left").unionByName(alone).select("_clade", "_id", "ref_start", "ref_end", "alt", "ref_len", "alt_len", "ref", "partners", "paths")
    words = one.filter(F.col("alt_len") >= LEAST_ALT).select("_clade", "_id", F.explode(F.array_distinct(Q.kmers(F.col("alt"), k))).alias("_w"))
    ref = _words(marked.filter("_ref"))
    known = ref.select("_clade", F.explode(F.array_distinct(Q.kmers(F.col("_node"), k))).alias("_w")).distinct().withColumn("_known", F.lit(1))
    overlap = words.join(known, ["_clade", "_w"], "left").groupBy("_id").agg((F.count("_known") / F.count("*")).alias("_overlap"))
    both = called.join(overlap, "_id", "left")
    r, a, n, m = F.col("ref"), F.col("alt"), F.col("ref_len"), F.col("alt_len")
    kind = (
        F.when(F.col("partners").isNotNull(), "TRA").when((n > 0) & (n == m) & (a == Q.reverse_complement(r)), "INV").when((n > 0) & (m >= 2 * n) & F.startswith(a, F.concat(r, r)), "DUP")
        .when(m > n, "INS").when(m < n, "DEL").otherwise("COMPLEX")
    )
    share = F.coalesce("_overlap", F.lit(1.0))
    return both.select(F.col("_clade").alias(clade), "ref_start", "ref_end", kind.alias("svtype"), "ref_len", "alt_len", (m - n).alias("svlen"), (share < LEAST_OVERLAP).alias("off_ref"), share.alias("overlap"), F.coalesce("partners", F.array().cast("array<string>")).alias("partners"), "paths", *([a] if with_allele else []))


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root over links (a, b): each round a node takes the least root among its neighbours', and then its root's root."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("root", "_r"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("_r").alias("_near"))
        better = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("_near", "root")).alias("_best"))
        jump = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        new = staged(
            better.join(jump, F.col("_best") == F.col("_n"), "left").select("node", F.least("_best", F.coalesce("_up", "_best")).alias("root"), (F.least("_best", F.coalesce("_up", "_best")) != F.col("root")).alias("_moved")), "labels"
        )
        if not new.filter("_moved").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError("the components did not settle")


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) by doubling: log(depth) joins, until nothing new is found; depth 0 is the node itself.

    A node that is its own ancestor is an error.
    """
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct()
    every, known = up, up.count()
    while True:
        right = every.select(F.col("node").alias("_m"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        longer = every.join(right, F.col("ancestor") == F.col("_m")).select("node", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        grown = staged(every.union(longer).distinct(), "ancestors")
        if grown.filter("node = ancestor").limit(1).count():
            raise ValueError("the edges have a cycle")
        found = grown.count()
        if found == known:
            break
        every, known = grown, found
    nodes = edges.select(F.col(child).alias("node")).union(edges.select(parent)).distinct()
    return every.union(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def lowest_common(pairs: DataFrame, up: DataFrame, a: str, b: str) -> DataFrame:
    """The branch point of each pair: the common ancestor of least depth."""
    one = up.select(F.col("node").alias(a), "ancestor", F.col("depth").alias("_da"))
    two = up.select(F.col("node").alias(b), "ancestor", F.col("depth").alias("_db"))
    return pairs.join(one, a).join(two, [b, "ancestor"]).groupBy(a, b).agg(F.min_by("ancestor", F.struct(F.col("_da") + F.col("_db"), "ancestor")).alias("branch_point"))


def subclade_keys(hashes: Column, pivots: list[str]) -> Column:
    """A bit for each pivot hash that the sketch has, as a long."""
    return sum((F.when(F.array_contains(hashes, p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(pivots)), F.lit(0)).cast("long")


def subclades(rows: DataFrame, clade: str, key: str, near: int = 4, most: int = 500) -> DataFrame:
    """Islands of keys whose neighbours in sorted order differ in at most ``near`` bits, split again above ``most`` rows."""
    order = Window.partitionBy(clade).orderBy(key, *[c for c in rows.columns if c not in (clade, key)])
    far = F.bit_count(F.col(key).bitwiseXOR(F.coalesce(F.lag(key).over(order), F.col(key)))) > near
    island = F.sum(F.when(far, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inner = F.row_number().over(Window.partitionBy(clade, "island").orderBy(key, *[c for c in rows.columns if c not in (clade, key)]))
    return rows.withColumn("island", island).withColumn("part", F.floor((inner - 1) / most))


def overlap_length(left: str, right: str, least: int, mismatch: float = 0.0) -> int:
    """The longest suffix of ``left`` that is a prefix of ``right``, with a share of mismatches; 0 below ``least``."""
    a, b = np.frombuffer(left.encode(), np.uint8), np.frombuffer(right.encode(), np.uint8)
    for n in range(min(len(a), len(b)), least - 1, -1):
        if (a[-n:] != b[:n]).sum() <= mismatch * n:
            return n
    return 0


def greedy_assemble(reads: list[str], least_overlap: int = 20, least_length: int = 0, mismatch: float = 0.0, most: int | None = 64) -> list[str]:
    """Drops reads that another holds on either strand, then merges the best overlapping pair again and again.

    Of the distinct reads the ``most`` longest take part; with None all do.
    """
    parts: list[str] = []
    for r in sorted(set(reads), key=lambda s: (-len(s), s))[:most]:
        if not any(r in p or reverse_complement(r) in p for p in parts):
            parts.append(r)
    # overlaps are kept from step to step: only those of the joined part are new; numbers grow, so ties go to earlier parts
    live = dict(enumerate(parts))
    overlaps = {(i, j): overlap_length(a, b, least_overlap, mismatch) for i, a in live.items() for j, b in live.items() if i != j}
    while overlaps:
        (i, j), n = max(overlaps.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if not n:
            break
        new, joined = max(live) + 1, live[i] + live[j][n:]
        del live[i], live[j]
        overlaps = {pair: n for pair, n in overlaps.items() if i not in pair and j not in pair}
        for k, part in live.items():
            overlaps[new, k], overlaps[k, new] = overlap_length(joined, part, least_overlap, mismatch), overlap_length(part, joined, least_overlap, mismatch)
        live[new] = joined
    parts = list(live.values())
    return sorted((p for p in parts if len(p) >= least_length), key=lambda s: (-len(s), s))


def assembled(reads: DataFrame, cluster: str, seq: str, **options) -> DataFrame:
    """Contigs of each cluster of reads: cluster, contig number, seq, support."""
    kind = reads.schema[cluster].dataType.simpleString()

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy_assemble(pdf[seq].tolist(), **options)
        return pd.DataFrame({cluster: [key[0]] * len(out), "contig": range(len(out)), "seq": out, "support": [len(pdf)] * len(out)})

    return reads.select(cluster, seq).groupBy(cluster).applyInPandas(work, f"`{cluster}` {kind}, contig long, seq string, support long")


def unique_links(kmers: DataFrame, kmer: str) -> DataFrame:
    """(a, b): k-mers that overlap but for one letter, where b is the only one that can follow a and a the only one before b; a k-mer is not linked with itself."""
    k = F.col(kmer)
    ends = kmers.select(F.explode(F.array(F.struct(F.expr(f"right({kmer}, length({kmer}) - 1)").alias("m"), k.alias("a"), F.lit(None).cast("string").alias("b")), F.struct(F.expr(f"left({kmer}, length({kmer}) - 1)").alias("m"), F.lit(None).cast("string").alias("a"), k.alias("b")))).alias("x")).select("x.*")
    # of one overlap there are at most as many k-mers on either side as there are letters
    met = ends.groupBy("m").agg(F.count("a").alias("_na"), F.count("b").alias("_nb"), F.max("a").alias("a"), F.max("b").alias("b"))
    return met.filter("_na = 1 AND _nb = 1 AND a != b").select("a", "b")


def ranked_in_chains(nodes: DataFrame, links: DataFrame, rings: bool = True) -> DataFrame:
    """(node, head, rank) of nodes on chains of links (a, b), each with at most one link in and one out; a cycle is cut before its least node, or left out without ``rings``.

    A rank is the sum of the links' ``step`` from the head, or their number if they have none.

    Pointers to earlier nodes are doubled, so a chain of n nodes takes log n joins. A node points where no other one does until it has found its head, so no join has a
    hot key. When a round settles no node, only cycles are left; there the least node of the way back is kept until it no longer changes.
    """
    own = nodes.select(F.col(nodes.columns[0]).alias("node"))
    step = F.col("step") if "step" in links.columns else F.lit(1)
    first = own.join(links.select(F.col("b").alias("node"), F.col("a").alias("ptr"), step.alias("_step")), "node", "left")
    state = staged(first.select("node", F.coalesce("ptr", "node").alias("ptr"), F.when(F.col("ptr").isNull(), 0).otherwise(F.col("_step")).cast("long").alias("rank"), F.col("ptr").isNull().alias("done"), F.least("node", "ptr").alias("least")), "chains")
    settled, open_ = state.filter("done"), state.filter("NOT done")
    left = open_.count()
    while left:
        ahead = settled.unionByName(open_).select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("rank").alias("_r"), F.col("done").alias("_d"), F.col("least").alias("_l"))
        moved = (F.col("_l") < F.col("least")).alias("moved")
        state = staged(open_.join(ahead, "ptr").select("node", F.col("_p").alias("ptr"), (F.col("rank") + F.col("_r")).alias("rank"), F.col("_d").alias("done"), F.least("least", "_l").alias("least"), moved), "chains")
        now, changed = state.agg(F.count_if(~F.col("done")), F.count_if(F.col("moved") & ~F.col("done"))).first()
        settled = settled.unionByName(state.filter("done").drop("moved"))
        open_ = state.filter("NOT done").drop("moved")
        if now == left and not changed:
            break
        left = now
    out = settled.select("node", F.col("ptr").alias("head"), "rank")
    if not left or not rings:
        return out
    turning = staged(open_.select("node", "least"), "rings")
    inside = links.join(turning.select(F.col("node").alias("b"), "least"), "b").filter("b != least").select(*links.columns)
    return out.unionByName(ranked_in_chains(turning.select("node"), staged(inside, "cut")))


def unitigs(kmers: DataFrame, kmer: str, count: str, piece: int = 10_000) -> DataFrame:
    """(head, part, kmers, seq, support): the longest ways through k-mers that do not branch, in parts of ``piece`` k-mers.

    ``kmers`` has distinct k-mers with their counts. The first part begins with the whole first k-mer, and others with the letter that their first one adds. ``support`` is
    the sum of the part's counts. A single part is all that is put together in one task, so ways of any length may be found.
    """
    rows = staged(kmers.select(F.col(kmer).alias("node"), F.col(count).cast("long").alias("_n")), "kmers")
    ranks = ranked_in_chains(rows.select("node"), staged(unique_links(rows, "node"), "unique"))
    placed = ranks.join(rows, "node").withColumn("part", F.floor(F.col("rank") / piece).cast("long"))
    letter = F.when(F.col("rank") == 0, F.col("node")).otherwise(F.expr("right(node, 1)"))
    found = placed.groupBy("head", "part").agg(F.count("*").alias("kmers"), F.array_sort(F.collect_list(F.struct("rank", letter.alias("x")))).alias("_l"), F.sum("_n").alias("support"))
    return found.select("head", "part", "kmers", F.array_join(F.transform("_l", lambda x: x["x"]), "").alias("seq"), "support")


#: Letters whose k-mers are counted at once, k-mers of a row that is shuffled, and k-mers of a bucket as far as they are evenly spread.
COUNTED_LETTERS, ROW_KMERS, BUCKET_KMERS = 4_000_000, 256, 3_000_000


def _codes(seqs: pa.Array, k: int) -> np.ndarray:
    """The k-mers of all sequences, two bits a letter; those with letters other than ACGT are left out."""
    values = np.full(256, 255, np.uint8)
    values[list(b"ACGT")] = range(4)
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    letters = values[np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    n = len(letters) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    # of a window that is left out, a bad letter or an end lies in it
    bad = np.zeros(len(letters) + 1, np.int32)
    bad[1:] = np.cumsum(letters > 3)
    ends = np.zeros(len(letters) + 1, np.int32)
    np.add.at(ends, offsets[1:-1] - offsets[0], 1)
    ends = np.cumsum(ends)
    whole = (bad[k : k + n] == bad[:n]) & (ends[k - 1 : k - 1 + n] == ends[:n])
    codes, width = (letters & 3).astype(np.int64), 1
    while width < k:
        more = min(width, k - width)
        codes = (codes[: len(codes) - more] << (2 * more)) | (codes[more:] & ((1 << 2 * more) - 1))
        width += more
    return codes[whole]


def _buckets(codes: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the k-mers' first and last k - 1 letters: by the least hash of the words in them, which neighbours mostly share."""
    size = max(1, k - 5)
    mask = (1 << 2 * size) - 1
    hashes = [(((codes >> (2 * (k - size - i))) & mask).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) for i in range(k - size + 1)]
    hashes = [h ^ (h >> np.uint64(31)) for h in hashes]
    inner = hashes[1:-1] or [np.full(len(codes), np.iinfo(np.uint64).max)]
    middle = inner[0]
    for h in inner[1:]:
        middle = np.minimum(middle, h)

    def dealt(least: np.ndarray) -> np.ndarray:
        return (((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)

    return dealt(np.minimum(hashes[0], middle)), dealt(np.minimum(middle, hashes[-1]))


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _ways(codes: np.ndarray, counts: np.ndarray, k: int, bucket: int, buckets: int) -> pa.Table:
    """The ways of two k-mers and more that one bucket's overlaps make of its k-mers; a way is open at an end whose overlap is another bucket's. Rings are left out."""
    codes, counts = _sums(codes, counts)
    left, right = (b == bucket for b in _buckets(codes, k, buckets))
    n, mask = len(codes), (1 << 2 * (k - 1)) - 1

    def single(middles: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlaps that one k-mer alone has, and that k-mer."""
        at = np.flatnonzero(own)
        found, first, number = np.unique(middles[at], return_index=True, return_counts=True)
        return found[number == 1], at[first[number == 1]]

    before, a = single(codes & mask, right)
    after, b = single(codes >> 2, left)
    _, x, y = np.intersect1d(before, after, assume_unique=True, return_indices=True)
    a, b = a[x], b[y]
    a, b = a[a != b], b[a != b]
    # heads by pointer doubling; what has not found one when all chains must have is a ring
    ptr, rank, head = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    ptr[b], rank[b], head[b] = a, 1, False
    for _ in range(max(1, n).bit_length()):
        if head[ptr].all():
            break
        rank, ptr = rank + rank[ptr], ptr[ptr]
    linked = ~head
    linked[a] = True
    at = np.flatnonzero(linked & head[ptr])
    at = at[np.lexsort((rank[at], ptr[at]))]
    starts = np.flatnonzero(head[at])
    ends = np.append(starts[1:], len(at))
    first, last = at[starts], at[ends - 1] if len(at) else at
    letters = np.frombuffer(b"ACGT", np.uint8)[codes[at] & 3]
    offsets = np.append(starts, len(at)).astype(np.int32)
    support = np.add.reduceat(counts[at], starts) if len(at) else counts[:0]
    return pa.table({
        "first": pa.array(codes[first]), "last": pa.array(codes[last]), "open_left": pa.array(~left[first]), "open_right": pa.array(~right[last]), "kmers": pa.array((ends - starts).astype(np.int64)),
        "support": pa.array(support), "first_count": pa.array(counts[first]), "letters": pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())),
    })


def unitigs_of_sequences(rows: DataFrame, seq: str, k: int, least: int = 2, piece: int = 10_000) -> DataFrame:
    """(head, part, kmers, seq, support): the ways of ``least`` (two at least) k-mers and more that do not branch in the graph of all k-mers of ACGT sequences, in parts.

    As ``unitigs``, for k of 3 to 31, but k-mers are shuffled once: as numbers, counted a few million letters at a time, and dealt by the least hash in their overlaps, so that most ways are whole
    in a bucket. Only ways that go on in another bucket are chained by joins, and k-mers without a neighbour are not written again. A part is made of whole ways of buckets, and a new one
    begins every ``piece`` k-mers. Rings have no head, and are left out.
    """
    from strandlake.operators.selection import _scanned

    if not 3 <= k <= 31 or least < 2:
        raise ValueError("k is from 3 to 31, and a way has two k-mers at least")
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.length(seq)).cast("long")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_KMERS))

    def dealt(seqs: pa.Array) -> pa.RecordBatch:
        codes = _codes(seqs, k)
        codes, counts = _sums(codes, np.ones(len(codes), np.int64))
        left, right = _buckets(codes, k, buckets)
        twice = np.flatnonzero(left != right)
        bucket = np.concatenate([left, right[twice]])
        order = np.argsort(bucket, kind="stable")
        bucket, codes, counts = bucket[order], np.concatenate([codes, codes[twice]])[order], np.concatenate([counts, counts[twice]])[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(bucket)))
        rows_ = -(-sizes // ROW_KMERS)
        at = np.repeat(starts, rows_) + ROW_KMERS * (np.arange(rows_.sum()) - np.repeat(np.cumsum(rows_) - rows_, rows_))
        offsets = pa.array(np.append(at, len(bucket)).astype(np.int32))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at]), "codes": pa.ListArray.from_arrays(offsets, pa.array(codes)), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))})

    def deal(batches):
        for batch in batches:
            seqs = batch.column(0).drop_null()
            sizes = np.cumsum(pc.binary_length(seqs).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(seqs):
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + COUNTED_LETTERS, "right")))
                made = dealt(seqs.slice(low, high - low))
                # few rows at a time, as a row has hundreds of k-mers
                yield from (made.slice(i, 2000) for i in range(0, len(made), 2000))
                low = high

    def work(table: pa.Table, cuts: np.ndarray):
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = table.slice(low, high - low)
            codes, counts = (np.concatenate([pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in some.column(name).chunks]).astype(np.int64) for name in ("codes", "counts"))
            ways = _ways(codes, counts, k, some.column("bucket")[0].as_py(), buckets)
            # a way that is shut at both ends is whole
            yield ways.filter(pc.or_(pc.or_(ways.column("open_left"), ways.column("open_right")), pc.greater_equal(ways.column("kmers"), least)))

    fields = "first bigint, last bigint, open_left boolean, open_right boolean, kmers bigint, support bigint, first_count bigint, letters string"
    dealt_rows = rows.select(seq).mapInArrow(deal, "bucket int, codes array<bigint>, counts array<int>")
    ways = staged(_scanned(dealt_rows, ["bucket"], [], fields, work), "ways")
    # of two ways that share a k-mer, one ends and the other begins with it
    links = staged(ways.filter("open_right").select(F.col("first").alias("a"), F.col("last").alias("b"), (F.col("kmers") - 1).alias("step")).join(ways.filter("open_left").select(F.col("first").alias("b")), "b").select("a", "b", "step"), "links")
    heads = links.select(F.col("a").alias("node")).join(links.select(F.col("b").alias("node")), "node", "left_anti")
    ranked = staged(ranked_in_chains(links.select(F.col("b").alias("node")).unionByName(heads), links, False), "ranked")
    # ways of chains without a head are on rings
    on_chain = ranked.select(F.col("node").alias("first"), "head", "rank")
    chained = ways.join(links.select(F.col("a").alias("first")).unionByName(links.select(F.col("b").alias("first"))).distinct(), "first", "left_semi").join(on_chain, "first")
    alone = ways.filter(F.col("kmers") >= least).join(links.select(F.col("a").alias("first")).unionByName(links.select(F.col("b").alias("first"))), "first", "left_anti").withColumn("head", F.col("first")).withColumn("rank", F.lit(0).cast("long"))
    later = F.col("rank") > 0
    placed = alone.unionByName(chained).select(
        "head", "rank", F.floor(F.col("rank") / piece).cast("long").alias("part"), (F.col("kmers") - later.cast("int")).alias("kmers"), (F.col("support") - F.when(later, F.col("first_count")).otherwise(0)).alias("support"),
        F.when(later, F.expr("substring(letters, 2)")).otherwise(F.col("letters")).alias("x"),
    )
    parts = placed.groupBy("head", "part").agg(F.sum("kmers").alias("kmers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda x: x["x"]), "").alias("x"), F.sum("support").alias("support"))
    if least > 2:
        parts = staged(parts, "parts")
        parts = parts.join(parts.groupBy("head").agg(F.sum("kmers").alias("_all")).filter(F.col("_all") >= least).select("head"), "head", "left_semi")
    letters = F.transform(F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)), lambda i: F.substring(F.lit("ACGT"), F.call_function("shiftright", F.col("head"), (2 * i).cast("int")).bitwiseAND(3).cast("int") + 1, F.lit(1)))
    named = parts.withColumn("_name", F.array_join(letters, ""))
    # the first letter that a head adds is its own last one
    return named.select(F.col("_name").alias("head"), "part", "kmers", F.when(F.col("part") == 0, F.concat(F.left("_name", F.lit(k - 1)), "x")).otherwise(F.col("x")).alias("seq"), "support")
