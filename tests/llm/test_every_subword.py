"""op5's model scores every subword of every word over the whole vocabulary, against plain Python."""

import math

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tidelark.llm import lm_score
from tidelark.llm.attention import Attention

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_grouped_softmax():
    net = Attention(40, width=4, length=6, context=2, head=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.mask = net.mask.astype(np.float64)
    x, y = np.array([[40, 3, 17, 39, 5, 0]]), np.array([[3, 17, 39, 5, 0, 8]])
    every = np.array([net.log_probabilities(x, np.full_like(y, k))[0] for k in range(40)])
    assert np.exp(every).sum(0) == pytest.approx(np.ones(6))  # a distribution over all ids
    loss = lambda: -net.log_probabilities(x, y).mean()
    g = net._gradients(x, y, np.ones(x.shape))
    for k, w in net.w.items():
        for at in [tuple(i) for i in np.argwhere(g[k])[::7]]:
            old = w[at]
            w[at] = old + 1e-6
            up = loss()
            w[at] = old - 1e-6
            assert g[k][at] == pytest.approx((up - loss()) / 2e-6, abs=2e-6), k
            w[at] = old


def test_every_subword_is_scored(spark):
    rows = [(i, f"the weather in Tidelark is {x}, unforgettableé {x}{i} " * 9) for i, x in enumerate(["calm", "windy", "stormy", "changeable"] * 3)]
    rows += [(20, "unheard-of 世界 <|endoftext|> zq"), (21, ""), (22, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counts = lm_score.fit_subwords(docs, F.col("doc_id") < 12, BYTE, frequent=5)
    own = tokenizers.Tokenizer.from_file(BYTE)
    own.encode_special_tokens = True
    ids = {i: [k for w in (t or "").lower().split() for k in own.encode(" " + w, add_special_tokens=False).ids] for i, t in rows}
    assert model.places == sum(len(ids[i]) + 1 for i in range(12)) > model.tokens
    seen = {k for i in range(12) for k in ids[i]}
    assert model.size == len(seen) + 2 and model.unseen == len(lm_score.vocabulary(BYTE).token_bytes) - len(seen)
    net, total = model.attention, {}
    for i in ids:
        mine = np.array([*model.number[ids[i]], model.end])
        p = 0.98 * np.exp(net.scores(mine, np.array([len(mine)])).astype(float)) + 0.02 * model.share[mine]
        total[i] = sum(math.log10(v / (model.unseen if k == model.size - 1 else 1)) for k, v in zip(mine, p, strict=True))
    got = {r.doc_id: r for r in lm_score.score_texts(docs, model, counts).collect()}
    assert got.keys() == ids.keys() and all(got[i].score == pytest.approx(total[i], rel=1e-5) for i in ids)
    assert got[20].n_tokens == 5 and got[21].n_tokens == 1 and got[21].score == got[22].score
    assert got[0].score > got[0].base_score


def test_words_with_the_same_first_subword_are_told_apart(spark):
    """By their later subwords and what stood before; their counts are equal."""
    docs = spark.createDataFrame([(i, "red unforgettable blue unforgiving " * 400) for i in range(4)] + [(8, "red unforgettable blue unforgiving " * 30), (9, "red unforgiving blue unforgettable " * 30)], "doc_id bigint, text string")
    model, counts = lm_score.fit_subwords(docs, F.col("doc_id") < 4, BYTE)
    score = {r.doc_id: r.score for r in lm_score.score_texts(docs.where("doc_id > 7"), model, counts).collect()}
    assert score[8] > score[9] + 10
