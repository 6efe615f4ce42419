"""Language identification weighs all n-grams of a text, so long texts overrule the prior and near languages."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from strandlake.llm import langid, quality

VOCABULARY = ["bado", "kimu", "lesa", "tori", "nufe", "gapi", "zolu", "meki", "sovu", "rida"]


def docs(spark, counts, length=2000):
    r, rows = random.Random(6), []
    for k, (lang, n) in enumerate(counts.items()):
        weights = [1.5 if (i + k) % 3 == 0 else 1.0 for i in range(len(VOCABULARY))]
        rows += [(lang, " ".join(r.choices(VOCABULARY, weights, k=length))) for _ in range(n)]
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def grams(text):
    """Buckets of all n-grams of one to three characters, by plain arithmetic."""
    if not any(c.isalpha() for c in text.lower()):
        return Counter()
    x, last, out = [32], 32, Counter()
    for c in [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32]:
        if c != 32 or last != 32:
            x.append(c)
        last = c
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + x[i + k] + ((k + 1) << 24)) % 2**64
            out[(h * 0x9E3779B97F4A7C15) % 2**64 >> 49] += 1
    return out


def test_scores_equal_brute_force(spark):
    rows = [(1, "Ein Haus, zwei Häuser 12", "de"), (2, "a house and a barn", "en"), (3, "", "en"), (4, None, "de"), (5, "la casa e il cane!", "it"), (6, "un cane", None), (7, "123 --", "it"), (None, "die Katze", "de"), (8, "the cat " * 50, "en"), (9, "das Haus", "de")]
    sums, n = {}, Counter()
    for d, t, lang in rows:
        if lang and d is not None and zlib.crc32(str(d).encode()) % 5:
            n[lang] += 1
            sums.setdefault(lang, Counter()).update(grams(t or ""))
    names = sorted(sums)
    found = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).join(spark.createDataFrame(rows, "d long, text string, lang string"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()}
    for _, t, _ in rows:
        own = grams(t or "")
        score = [math.log(n[k] / n.total()) + sum(c * math.log((sums[k][b] + 0.3) / (sums[k].total() + 0.3 * langid.BUCKETS)) for b, c in own.items()) for k in names]
        if not own:
            assert found[t] == ("und", 0.0)
        else:
            best = max(range(len(names)), key=lambda i: score[i])
            assert found[t][0] == names[best] and abs(found[t][1] - 1 / sum(math.exp(s - score[best]) for s in score)) < 1e-4


def test_batches_and_long_texts_agree(monkeypatch):
    texts = ["Hello wörld 1", "", "çà et là — " * 30, "12", "x", "long one " * 200]
    whole = list(zip(*langid.counted(texts)))
    assert whole == [(i, b, c) for i, t in enumerate(texts) for b, c in sorted(grams(t).items())]
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert list(zip(*langid.counted(texts))) == whole


def test_a_rare_language_beside_a_near_frequent_one():
    text = " ".join(VOCABULARY * 200)
    log_prob = np.full((langid.BUCKETS, 2), -8.0)
    log_prob[np.unique(np.concatenate(list(langid.buckets(text)))), 1] += 0.05
    model = langid.Model(("often", "rare"), np.log([0.999, 0.001]), log_prob)
    assert model.predict(text)[0] == "rare" and model.predict(text)[1] > 0.99
    assert model.predict(VOCABULARY[0])[0] == "often"


def test_long_texts_of_near_languages_stay(spark):
    frame = docs(spark, {lang: 25 for lang in "abcdefgh"})
    assert langid.keep_identified(frame).count() == 200


def test_word_vectors_equal_brute_force(spark):
    texts = ["Die Katze, die Katze!", "the cat sat on the mat", "", None, "one", "the cat's 12 mats — on"]
    split = lambda t: re.findall(r"[0-9a-z\u0080-\uffff]+|[^\s0-9a-z\u0080-\uffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: int(quality.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    index = np.zeros((quality.BUCKETS, quality.DIMS))
    for b in range(quality.BUCKETS):
        for place, sign in zip(quality.PLACES[b], quality.SIGNS[b]):
            index[b, place] += sign
    context = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        w = [bucket(x) for x in split(t)]
        for a, b in zip(w, w[1:]):
            context[a] += index[b]
            context[b] += index[a]
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))
    found = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.abs(found - context).max() < 1e-6
    rows = quality.Features(found).of(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    for t, row in zip(texts, rows):
        w = [bucket(x) for x in split(t)]
        mean = np.mean([np.concatenate([context[b], index[b] / 2]) for b in w], axis=0) if w else np.zeros(2 * quality.DIMS)
        assert np.abs(row[: 2 * quality.DIMS] - mean).max() < 1e-5
        raw = (t or "").encode()
        assert abs(row[2 * quality.DIMS] - math.log1p(len(raw)) / 8) < 1e-6 and row[-1] == bool(w)
        assert abs(row[2 * quality.DIMS + 2] - len(set(w)) / max(1, len(w))) < 1e-6


def test_network_scores_equal_brute_force():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, quality.WIDTH))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    net = quality.fit(x, y)
    for row, found in zip(x[:20], net.score(x[:20])):
        hidden = [math.tanh(sum((row[i] - net.centre[i]) / net.scale[i] * net.first[i, k] for i in range(quality.WIDTH)) + net.first_bias[k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.second)) + net.second_bias
        assert abs(found - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9
    # the temperature is the one of the grid with the least loss on the rows that were kept apart
    order = np.random.default_rng(5).permutation(len(x))[: len(x) // 5]
    loss = lambda t: float(np.mean(np.logaddexp(0, net.logit(x[order]) / t) - y[order] * net.logit(x[order]) / t))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 41))
