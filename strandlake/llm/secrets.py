"""Secret scans with DataFrame functions only: three patterns, and a battery of randomness tests for other tokens.

Base spans come from fixed patterns. Every run of 20 or more token characters outside of them that has a letter and a digit is a
candidate. Its encoding is inferred (hexadecimal, base32, base36 or base64). Over that alphabet of k symbols three statistics are taken:

* the chi-squared statistic of the symbol counts against a uniform alphabet,
* the number of runs of one character class (upper case, lower case, digits, signs),
* the lag-one serial correlation of the symbols about the middle of the alphabet.

Each gives two z-scores: its distance from what independent uniform draws give, and from what a natural token gives (whose symbols collide
``NATURAL`` times as often, which changes class after a share ``CHANGES`` of its characters, and whose neighbours correlate by ``LAG``). The squares of the first
three are added: a candidate that random draws would not give (``MOST_SQUARES``) can't be a discovery. The other three are added up to one score with the variance
of scores that correlate by ``SHARED``; its p-value is that of a natural token. How large the score can be grows with the length, so the
false-discovery rate is controlled within strata of length, over the whole corpus, by Benjamini-Hochberg on scores rounded down to eighths;
only counts by stratum and rounded score (a few hundred numbers) reach the driver.

Spans are found in time that grows as n to 1.5 at most with their number: positions are prefix sums taken in blocks, and texts are cut by byte offsets.
Positions are code points, ends exclusive. A null text is empty. Repeated rows are answered one by one, null ids are kept, an
empty table gives no row, and other columns are ignored (``redact`` returns them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import staged

#: The patterns, the group whose length counts, and the least length of each base kind, in order.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: What natural tokens do: how many times as often as uniform symbols theirs collide, changes of class a character, and serial correlation.
NATURAL, CHANGES, LAG = 4.0, 0.25, 0.3
#: Correlation of the three scores of natural tokens that is allowed for.
SHARED = 0.3
#: For each alphabet, the chance that the class of two independent symbols differs.
DIFFER = {16: 1 - (10**2 + 6**2) / 16**2, 32: 1 - (26**2 + 6**2) / 32**2, 36: 1 - (26**2 + 10**2) / 36**2, 64: 1 - (2 * 26**2 + 10**2 + 2**2) / 64**2}
#: Upper ends of the strata of length.
STRATA = (23, 31, 47, 95)
RATE = 0.05
#: Greatest sum of three squared z-scores that agrees with random draws (chi-squared of three, one in ten thousand).
MOST_SQUARES = 21.1
STEPS = 8
TOP = 40 * STEPS
SPAN = "struct<start: int, kind: int, end: int, byte: int>"


def _let(name: str, value: str, body: str) -> str:
    """SQL that binds a value to a name, so that it is computed once: a one-element array stands for the binding."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(values: str, step: str, name: str) -> str:
    """SQL for the prefix results of an array of integers, by blocks of about the square root of its size; ``step`` combines two."""
    put = step.format
    grow = f"named_struct('t', {put('a.t', 'x')}, 'o', array_append(a.o, {put('a.t', 'x')}))"
    zero = "named_struct('t', 0, 'o', cast(array() AS array<int>))"
    local = f"transform(sequence(0, (size({name}.v) - 1) div {name}.c), i -> aggregate(slice({name}.v, cast(i * {name}.c + 1 AS int), {name}.c), {zero}, (a, x) -> {grow}, a -> a.o))"
    heads = f"aggregate({name}g, {zero}, (a, x) -> named_struct('t', {put('a.t', 'element_at(x, -1)')}, 'o', array_append(a.o, a.t)), a -> a.o)"
    whole = _let(f"{name}g", local, f"flatten(zip_with({name}g, {heads}, (g, t) -> transform(g, x -> {put('t', 'x')})))")
    return _let(f"{name}v", values, _let(name, f"named_struct('v', {name}v, 'c', cast(ceil(sqrt(size({name}v))) AS int))", f"CASE WHEN size({name}.v) = 0 THEN {name}.v ELSE {whole} END"))


SUM, MOST = "({0}) + ({1})", "greatest({0}, {1})"


def _spans(kind: int, pattern: str, group: int, least: int, text: str) -> str:
    """SQL for the spans of one kind, with their tokens: segments between matches and the matches' lengths give the positions."""
    found = f"named_struct('seg', split({text}, r'{pattern}', -1), 'whole', regexp_extract_all({text}, r'{pattern}', 0), 'part', regexp_extract_all({text}, r'{pattern}', {group}))"
    ends = lambda size, name: _prefix(f"zip_with(slice(m.seg, 1, size(m.whole)), m.whole, (s, w) -> {size}(s) + {size}(w))", SUM, name)
    rows = "zip_with(zip_with(m.whole, m.part, (w, p) -> named_struct('w', w, 'p', length(p))), zip_with(q.a, q.b, (a, b) -> named_struct('a', a, 'b', b)), (w, e) -> named_struct('start', e.a - length(w.w), 'end', e.a, 'byte', e.b - length(w.w), 'size', w.p, 'token', w.w))"
    kept = f"transform(filter({rows}, x -> x.size >= {least}), x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.end, 'byte', x.byte, 'token', x.token))"
    some = _let("m", found, _let("q", f"named_struct('a', {ends('length', 'u')}, 'b', {ends('octet_length', 'y')})", kept))
    return f"CASE WHEN {text} RLIKE r'{pattern}' THEN {some} ELSE cast(array() AS array<{SPAN[:-1]}, token: string>>) END"


def _pieces(text: str, spans: str, ends: str, each: str) -> str:
    """SQL that cuts a text at spans: ``each`` stands for a span ``x``, and what lies between is kept. ``ends`` are byte ends that do not fall."""
    piece = f"if(x.byte >= p, concat(cast(substring(b, p + 1, x.byte - p) AS string), {each}), '')"
    parts = f"zip_with(concat(array(0), slice(n, 1, size(n) - 1)), {spans}, (p, x) -> {piece})"
    whole = _let("n", ends, _let("b", f"cast({text} AS binary)", f"array_join(concat({parts}, array(cast(substring(b, element_at(n, -1) + 1) AS string))), '')"))
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {whole} END"


def _scores(token: str) -> str:
    """SQL for the stratum and rounded z-score of a candidate; -1 if it can't be a discovery."""
    alphabet = "CASE e.k " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in ALPHABETS.items()) + " END"
    inferred = f"""CASE WHEN {token} RLIKE '^[0-9a-f]+$' OR {token} RLIKE '^[0-9A-F]+$' THEN named_struct('k', 16, 'u', lower({token}))
        WHEN {token} RLIKE '^[A-Z2-7]+=*$' THEN named_struct('k', 32, 'u', replace({token}, '=', ''))
        WHEN {token} RLIKE '^[a-z0-9]+$' THEN named_struct('k', 36, 'u', {token})
        ELSE named_struct('k', 64, 'u', translate(replace({token}, '=', ''), '-_', '+/')) END"""
    digits = f"transform(sequence(1, length(e.u)), i -> instr({alphabet}, substr(e.u, i, 1)) - 1)"
    # One-element arrays stand for bindings, so that each value is computed once.
    binds = f"transform(array({inferred}), e -> named_struct('k', e.k, 'x', {digits}))"
    classes = f"transform(sequence(1, length({token})), i -> CASE WHEN substr({token}, i, 1) RLIKE '[A-Z]' THEN 0 WHEN substr({token}, i, 1) RLIKE '[a-z]' THEN 1 WHEN substr({token}, i, 1) RLIKE '[0-9]' THEN 2 ELSE 3 END)"
    pairs = lambda x: f"zip_with(slice({x}, 1, size({x}) - 1), slice({x}, 2, size({x}) - 1), (p, q) -> named_struct('p', p, 'q', q))"
    sums = f"""transform({binds}, b -> named_struct('k', cast(b.k AS double), 'n', cast(size(b.x) AS double),
        'sq', aggregate(array_distinct(b.x), 0D, (a, s) -> a + pow(size(filter(b.x, v -> v = s)), 2)),
        'flips', {_let('d', classes, f"aggregate({pairs('d')}, 0D, (a, y) -> a + if(y.p != y.q, 1D, 0D)) / (size(d) - 1)")},
        'lag', aggregate({pairs('b.x')}, 0D, (a, y) -> a + (y.p - (b.k - 1) / 2D) * (y.q - (b.k - 1) / 2D)) / ((b.k * b.k - 1) / 12 * (size(b.x) - 1))))"""
    differ = "CASE c.k " + " ".join(f"WHEN {k} THEN {v}D" for k, v in DIFFER.items()) + " END"
    chi = "(c.k / c.n * c.sq - c.n)"
    spread = "sqrt(2 * (c.k - 1) * (c.n - 1) / c.n)"
    natural = f"((c.k - 1) + (c.n - 1) * ({NATURAL} - 1))"
    root = "sqrt(c.n - 1)"
    runs = lambda share: f"(c.flips - {share}) * {root} / sqrt({share} * (1 - {share}))"
    squares = f"pow(({chi} - (c.k - 1)) / {spread}, 2) + pow({runs(f'({differ})')}, 2) + pow(c.lag * {root}, 2)"
    joined = f"(({natural} - {chi}) / ({NATURAL} * {spread}) + {runs(str(CHANGES) + 'D')} + ({LAG} - c.lag) * {root}) / {math.sqrt(3 + 6 * SHARED)}"
    z = f"greatest(-1, least({TOP}, cast(floor({STEPS} * ({joined})) AS int)))"
    return f"element_at(transform({sums}, c -> if(c.n >= 20 AND {squares} <= {MOST_SQUARES}, {z}, -1)), 1)"


def _stratum(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} <= {top} THEN {k}" for k, top in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their base spans and candidates (start, end, byte, stratum, score) added under reserved names."""
    held = docs.withColumn("strandlake_text", F.coalesce(F.col(text), F.lit("")))
    names = [f"strandlake_{k}" for k in KINDS]
    for k, (name, spec) in enumerate(zip(names, KINDS.values(), strict=True)):
        held = held.withColumn(name, F.expr(f"transform({_spans(k, *spec, text='strandlake_text')}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'byte', x.byte))"))
    masked = "strandlake_text"
    for k, name in enumerate(names):  # spans of one kind do not overlap
        held = held.withColumn(f"strandlake_masked_{k}", F.expr(_pieces(masked, name, f"transform({name}, x -> x.byte + x.end - x.start)", "repeat(' ', x.end - x.start)")))
        masked = f"strandlake_masked_{k}"
    held = held.withColumn("strandlake_loose", F.expr(_spans(len(KINDS), CANDIDATE, 0, 20, masked)))
    fit = "filter(strandlake_loose, c -> c.token RLIKE '[0-9]' AND c.token RLIKE '[A-Za-z]')"
    scored = f"transform({fit}, t -> named_struct('start', t.start, 'end', t.end, 'byte', t.byte, 'stratum', {_stratum('(t.end - t.start)')}, 'score', {_scores('t.token')}))"
    held = held.withColumn("strandlake_candidates", F.expr(scored)).withColumn("strandlake_base", F.expr(f"sort_array(concat({', '.join(names)}))"))
    return held.drop("strandlake_loose", *names, *(f"strandlake_masked_{k}" for k in range(len(names))))


def discoveries(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """The least rounded score of a discovery in each stratum (Benjamini-Hochberg) from (stratum, score, count) rows."""
    out = {}
    for stratum in {s for s, _, _ in counts}:
        own = sorted(((score, n) for s, score, n in counts if s == stratum), reverse=True)
        m, above, least = sum(n for _, n in own), 0, TOP + 1
        for score, n in own:
            above += n
            if score >= 0 and m * 0.5 * math.erfc(score / STEPS / math.sqrt(2)) <= rate * above:
                least = score
        out[stratum] = least
    return out


def _found(rows: DataFrame) -> Column:
    """All spans of ``scanned`` rows, with the discoveries among their candidates."""
    each = rows.select(F.explode("strandlake_candidates").alias("c")).groupBy("c.stratum", "c.score").agg(F.count("*").alias("n"))
    least = discoveries([(r["stratum"], r["score"], r["n"]) for r in each.collect()])
    bound = "CASE c.stratum " + " ".join(f"WHEN {s} THEN {v}" for s, v in sorted(least.items())) + f" ELSE {TOP + 1} END" if least else str(TOP + 1)
    added = f"transform(filter(strandlake_candidates, c -> c.score >= {bound}), c -> named_struct('start', c.start, 'kind', {len(KINDS)}, 'end', c.end, 'byte', c.byte))"
    return F.expr(f"sort_array(concat(strandlake_base, {added}))")


def _joined(spans: str) -> str:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in [*KINDS, "random"]) + "), s.kind + 1)"
    return f"array_join(transform({spans}, s -> concat_ws(':', {names}, s.start, s.end)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    rows = staged(scanned(docs.select("doc_id", "text")).drop("text", "strandlake_text"), "secrets")
    rows = rows.withColumn("strandlake_spans", _found(rows))
    counts = [F.expr(f"cast(size(filter(strandlake_base, s -> s.kind = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_joined("strandlake_base")), 256).alias("base_sha256"), F.expr(_joined("strandlake_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by ``mark``; n_chars follows where a text has changed."""
    rows = staged(scanned(docs).drop("strandlake_text"), "redact")
    rows = rows.withColumn("strandlake_spans", _found(rows))
    ends = _prefix("transform(strandlake_spans, x -> x.byte + x.end - x.start)", MOST, "e")
    rows = rows.withColumn("strandlake_clean", F.expr(_pieces("text", "strandlake_spans", ends, f"'{mark}'")))
    changed = F.size("strandlake_spans") > 0
    columns = [F.col("strandlake_clean").alias("text") if c == "text" else F.when(changed, F.length("strandlake_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*columns)
