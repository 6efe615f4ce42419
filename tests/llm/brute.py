"""Brute-force versions of the operators, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def secrets(text):
    spans = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS.values()) for m in p.finditer(text or "") if len(m[g]) >= n)
    joined = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def contamination(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def kneser_ney(docs, pruned=True):
    tokens = [(d, BLANK.findall(low(t)) + [None]) for d, t in docs]
    rows = lambda t: list(zip(["<s>", "<s>", *t][:-2], ["<s>", *t][:-1], t))
    one, three = Counter(), Counter()
    for d, t in tokens:
        if d is not None and crc(d, 7) != 2:
            one.update(t)
            three.update(rows(t))
    two = Counter(g[1:] for g in three)
    after = Counter(g[1] for g in two)
    n, v = sum(one.values()), len(one)

    def cuts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0.5] * 3
        y = n1 / (n1 + 2 * n2)
        third = 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2
        return [min(max(x, a), b) for x, a, b in zip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, third], [0.01, 0.02, 0.03], [0.99, 1.99, 2.99])]

    def level(counts, d, pruned):
        """Share of each n-gram and weight of the lower order of each context; of pruned ones all goes to the lower order."""
        total, rest = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            rest[g[:-1]] += 1 if pruned and c == 1 else d[min(c, 3) - 1]
        own = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items() if not (pruned and c == 1)}
        return own, {g: rest[g] / total[g] for g in total}

    own3, rest3 = level(three, cuts(three), pruned)
    own2, rest2 = level(two, cuts(two), False)
    own1, rest1 = level({(w,): c for w, c in after.items()}, cuts(after), False)

    def p(u, x, w):
        lower = own1.get((w,), 0) + rest1.get((), 1) / (v + 1)
        lower = own2.get((x, w), 0) + rest2.get((x,), 1) * lower
        return own3.get((u, x, w), 0) + rest3.get((u, x), 1) * lower

    return [(d, d is not None and crc(d, 7) == 2, len(t), sum(w in one for w in t), n, sum(math.log10((one.get(w, 0) + 1) / (n + v + 1)) for w in t), sum(math.log10(p(*g)) for g in rows(t))) for d, t in tokens]


def substrings(docs, length=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def fingerprint(text, width=3):
    w = BLANK.findall(low(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def shingles(text, width=5):
    w = BLANK.findall(low(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_duplicates(docs, radius=3, width=3):
    """Components of fingerprints within ``radius``."""
    marks = [fingerprint(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return [(d, f"{marks[i]:016x}", first.get(find(i))) for i, (d, _) in enumerate(docs)]


def kept_first(docs, least=0.8):
    """Ids of the rows that stay: the smallest of each component of exact similarity over all pairs, null being the largest."""
    sets = [shingles(t) for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    head = list(range(len(docs)))
    place = {i: k for k, i in enumerate(order)}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=place.get)
                head[b] = a
    return [docs[i][0] for i in range(len(docs)) if find(i) == i]


def collocations(rows, least=100, top=2000, share=100):
    """Of (text, lang): the ranked phrases of each language."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        kept = {w: a for w, a in f.items() if a >= least and len(w) > 1}
        held = {w[i:j] for w, a in kept.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= share * kept[w[i:j]]}
        found = []
        for w, a in kept.items():
            if w not in held:
                score, k = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                found.append((score, a, " ".join(w), f[w[:k]], f[w[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, total[lang], score) for i, (score, a, p, l, r) in enumerate(found[:top], 1)]
    return out


def fim(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
