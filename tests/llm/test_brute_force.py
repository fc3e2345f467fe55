"""The fitted operators against plain Python that does the same by definition, one document at a time."""

import math
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from tidelark.llm import attention, langid, lm_score, quality, toxicity
from tidelark.llm.common import crc_remainder, table

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").select("doc_id", "text", "lang").limit(80).unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "one two", "en")], "doc_id bigint, text string, lang string")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def sigmoid(model, x):
    z = [1.0, *((a - m) / s for a, m, s in zip(x, model.mean, model.scale, strict=True))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model.beta, strict=True))))


def test_quality(spark, docs, texts):
    labels = table(spark, SF.replace("0.001", "0.01"), "labels")
    model = quality.fit_quality(table(spark, SF.replace("0.001", "0.01"), "documents"), labels, crc_remainder(F.col("doc_id"), 5) != 0)
    assert model.calibration is not None

    def size(dictionary, chunk):
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress(chunk))

    for r in quality.score_quality(docs, model).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = 0.0
        if raw:
            chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
            bad, good = ([size(d, c) for c in chunks] for d in model.dictionaries)
            diff = [(g - b) / (g + b) for g, b in zip(good, bad, strict=True)]
            ratio = [math.log(min(g, b) / (len(c) + 16)) for g, b, c in zip(good, bad, chunks, strict=True)]
            whole = math.log(sum(map(min, good, bad)) / (len(raw) + 16))
            want = sigmoid(model.calibration, [(sum(good) - sum(bad)) / (sum(good) + sum(bad)), max(diff), min(diff), whole, min(ratio), max(ratio), math.log1p(len(raw))])
        assert r.score == pytest.approx(want, abs=0.02) and r.predicted == int(r.score >= 0.3)  # a fresh compressor may choose other matches


def test_toxicity(spark):
    bad = ["you utter fool", "vile rotten thing", "get lost fool", "rotten fool vile"]
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 6, r.integers(1, 4)))
    rows, labels = [], []
    for i in range(160):
        w = [word() for _ in range(int(r.integers(5, 60)))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(int(r.integers(0, len(w))), bad[int(r.integers(0, 4))])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, marks, F.lit(True))
    words = {i: t.split() for i, t in rows}
    count = [Counter(w for i, v in labels if v == k for w in set(words[i])) for k in (1, 0)]
    na, nb = sum(count[0].values()), sum(count[1].values())
    scores = {}
    for w in count[0] | count[1]:
        share = (count[0][w] + count[1][w]) / (na + nb)
        a, b = count[0][w] + 0.1 * na * share, count[1][w] + 0.1 * nb * share
        odds = math.log(a / na) - math.log(b / nb)
        drawn = max(0.0, abs(odds) - 2 * math.sqrt(1 / a + 1 / b))
        if drawn:
            scores[w.encode()] = math.copysign(drawn, odds)
    assert model.scores.keys() == scores.keys() and all(model.scores[w] == pytest.approx(s) for w, s in scores.items()) and len(scores) > 3
    clean = Counter(w.encode() for i, v in labels if not v for w in words[i])
    total = sum(clean.values())
    share = {w: (clean[w] + 0.5) / total for w in scores}
    growth = sum(x * math.exp(model.decay * (scores[w] - 0.5)) for w, x in share.items()) + max(0, 1 - sum(share.values())) * math.exp(-model.decay * 0.5)
    assert growth == pytest.approx(1.0, abs=1e-6) and model.rate == pytest.approx(sum(x for w, x in share.items() if scores[w] > 0.5))

    def split(sums, a, z):
        best = max(((sums[j + 1] - sums[i], i, j) for i in range(a, z) for j in range(i, z)), default=(0, 0, 0))
        return [*split(sums, a, best[1]), best, *split(sums, best[2] + 1, z)] if best[0] > 0 else []

    for row in toxicity.score_toxicity(docs, model).collect():
        w = words[row.doc_id]
        sums = np.r_[0, np.cumsum([scores.get(x.encode(), 0.0) - 0.5 for x in w])]
        p = [(a, z, 1 - math.exp(-model.rate * len(w) * math.exp(-model.decay * s))) for s, a, z in split(sums, 0, len(w))]
        kept = [(a, z, q) for a, z, q in p if q <= 0.05]
        assert row.passages == [x for a, z, _ in kept for x in (a, z)]
        logs = [-math.log10(max(q, 1e-300)) for *_, q in kept]
        want = sigmoid(model.calibration, [min(max(logs, default=0.0), 30.0), math.log1p(sum(logs)), len(kept) / math.sqrt(len(w) + 1)])
        assert row.score == pytest.approx(want, abs=1e-4)


def test_language(spark, docs, texts):
    model = langid.fit_languages(table(spark, SF, "documents"), langid.learned())
    place = {b: k for k, b in enumerate(model.buckets.tolist())}

    def bucket(gram):
        f = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
        h = gram[0] * f[0]
        for k, c in enumerate(gram[1:], 1):
            h = h * 31 + c * f[k]
        h = (h & 0xFFFFFFFF) ^ (0, 0, 0x55555555, 0x33333333)[len(gram)]
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        return h >> 16

    for r in langid.predict_languages(docs, model).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        w = " " + "".join(c if c.isalpha() else " " for c in t.lower()).strip() + " "
        w = " ".join(["", *w.split(), ""])
        grams = {w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        mine = {bucket([ord(c) for c in g]) for g in grams}
        kernel = [sum(row[place[b]] for b in mine if b in place) / math.sqrt(len(mine)) for row in model.landmarks]
        s = [sum(k * x for k, x in zip(kernel, column, strict=True)) for column in model.weights.T]
        e = [math.exp(4 * (x - max(s))) for x in s]
        assert r.lang_pred == model.names[int(np.argmax(s))] and r.score == pytest.approx(max(e) / sum(e), abs=1e-4)
    k, y, ridge = own_system(spark, model)
    assert np.allclose(np.linalg.solve(k.T @ k + ridge, k.T @ y), model.weights, atol=1e-5)


def own_system(spark, model):
    """The normal equations of the kernel ridge regression, from all texts that may be learned from (fewer than a language's bound)."""
    rows = [r for r in table(spark, SF, "documents").where(langid.learned()).where("text IS NOT NULL AND lang IS NOT NULL").collect() if langid.LETTER.search(r.text)]
    assert max(Counter(r.lang for r in rows).values()) <= langid.PER_LANGUAGE
    sets = [set(langid.ngram_buckets(r.text).tolist()) for r in rows]
    marks = [{int(b) for b, x in zip(model.buckets, row, strict=True) if x} for row in model.landmarks]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in sets])
    own = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    n = Counter(r.lang for r in rows)
    w = np.sqrt([len(rows) / len(n) / n[r.lang] for r in rows])[:, None]
    y = np.array([[1.0 if r.lang == name else -1.0 for name in model.names] for r in rows])
    return kernel * w, y * w, langid.RIDGE * len(rows) / len(model.names) * (own + 1e-6 * np.eye(len(own)))


def test_language_model(spark, docs, texts):
    model, counts = lm_score.fit_words(docs, F.col("doc_id") % 7 != 2, BYTE, frequent=200)
    count = {bytes(r.w).decode(): r.c for r in counts.collect()}
    net = model.attention
    e, p, q, k, v, o, u, b = (net.w[x].astype(float) for x in "epqkvoub")
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for r in lm_score.score_texts(docs, model, counts).where("doc_id % 5 = 0 OR doc_id < 0").collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().lower().split()][:100_000]
        ids = [model.subword_of(w.encode()) for w in words] + [model.end]
        total = 0.0
        for i, own in enumerate(ids):
            step = net.length - net.context
            start = 0 if i < net.length else ((i - net.context) // step) * step  # the one window that scores it
            before = [net.begin if j == 0 else ids[j - 1] for j in range(start, i + 1)]
            h = e[before] + p[: len(before)]
            a = softmax(h[-1] @ q @ (h @ k).T / math.sqrt(net.width))
            z = h[-1] + a @ (h @ v) @ o
            total += math.log10((1 - lm_score.SMOOTH) * softmax(z @ u + b)[own] + lm_score.SMOOTH * model.share[own]) - model.log_rest[own]
            c = count.get(words[i], 0) if i < len(words) else model.documents
            total += math.log10(c + 1)
        assert r.n_tokens == len(ids) and r.score == pytest.approx(total, rel=1e-4)


def test_context_helps(spark):
    """On held-out texts the model beats the counts alone, and the same classes without context."""
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    learn = F.coalesce(crc_remainder(F.col("doc_id"), 7) != 2, F.lit(False))
    model, counts = lm_score.fit_words(docs, learn, BYTE)

    def mean():
        r = lm_score.score_texts(docs.where(~learn), model, counts).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        return r[0] / r[2], r[1] / r[2]

    with_context, base = mean()
    net, model.attention = model.attention, None
    without, _ = mean()
    assert isinstance(net, attention.Attention) and with_context > without + 0.005 and with_context > base, (with_context, without, base)
