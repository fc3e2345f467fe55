"""op5 splits and encodes a text once for training and scoring, and its arithmetic leaves results as they were."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.llm import lm_score
from tidelark.llm.attention import Attention


def test_texts_are_read_to_count_and_to_parse_alone(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return None if i == 3 else f"Calm Weather\x0bin Tidelark {i % 4} " * (i % 5)

    rows = [(i,) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint").withColumn("text", F.udf(text, "string").asNondeterministic()("doc_id"))
    monkeypatch.setattr(lm_score, "table", lambda *_: docs)
    out = {r.doc_id: r for r in lm_score.op5_lm_score(spark, "").collect()}
    assert len(out) == 40 and seen.value <= 80
    assert out[3].n_tokens == 1 and out[4].n_tokens == 21 and out[9].score < out[5].score < 0


def test_counts_of_words(spark):
    texts = ["Red red\tBLUE \x0b\x0c sky", "", None, "É é 世界 red\r\nred", "\x1cblue"]
    got = {bytes(r.w): r.c for r in lm_score.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == Counter(w for t in texts for w in (t or "").encode().lower().split())


@pytest.mark.parametrize("size", [300, 65_535, 65_536, 200_000])
def test_ids_as_bytes(size):
    ids = np.random.default_rng(1).integers(0, size + 1, 999)
    ids[:2] = 0, size
    assert lm_score.unpacked(lm_score.packed(ids, size), size).tolist() == ids.tolist()
    assert lm_score.unpacked(lm_score.packed(ids[:0], size), size).tolist() == []


@pytest.mark.parametrize("scale", [1, 40])  # also exponents that overflow or vanish
def test_scores_of_marked_places_are_those_of_all(scale):
    net = Attention(90, width=8, length=12, context=5, head=16)
    net.w = {k: v * np.float32(scale) for k, v in net.w.items()}
    ids = np.random.default_rng(2).integers(0, 90, 150)
    x, y, score, _ = net.cut(ids, np.array([3, 4, 60, 150]))
    every = net.log_probabilities(x, y)
    assert np.isfinite(every).all()
    assert net.log_probabilities(x, y, score) == pytest.approx(every[score], rel=1e-3, abs=1e-4)
    w = {k: v.astype(float) for k, v in net.w.items()}
    h = w["e"][x] + w["p"]
    a = (h @ w["q"]) @ (h @ w["k"]).transpose(0, 2, 1) / np.sqrt(8) + net.mask
    a = np.exp(a - a.max(-1, keepdims=True))
    z = h + a / a.sum(-1, keepdims=True) @ (h @ w["v"]) @ w["o"]
    log_softmax = lambda t: t - t.max(-1, keepdims=True) - np.log(np.exp(t - t.max(-1, keepdims=True)).sum(-1, keepdims=True))
    top = log_softmax(z @ np.c_[w["u"][:, :16], w["c"]] + np.r_[w["b"][:16], w["d"]])
    parts = [top[..., :16]] + [top[..., 16 + i, None] + log_softmax(z @ w["u"][:, low:high] + w["b"][low:high]) for i, (low, high) in enumerate(net.groups)]
    plain = np.take_along_axis(np.concatenate(parts, -1), y[..., None], -1)[..., 0]
    assert every == pytest.approx(plain, rel=1e-3, abs=2e-3)
