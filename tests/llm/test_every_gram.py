"""The n-gram model holds every gram of its texts, however many."""

import numpy as np

from tidelark.llm import perplexity


def test_no_gram_is_left_out(spark):
    codes = np.random.default_rng(5).integers(97, 123, (90_000, 8)).astype(np.uint8)
    words = ["".join(map(chr, w)) for w in codes.tolist()]
    texts = [(k, "en", " ".join(words[k::60])) for k in range(60)]
    m = perplexity.fit_ngrams(spark.createDataFrame(texts, "doc_id int, lang string, text string"))
    padded = ["\2" * 4 + w + "\3" for w in set(words)]
    for order in (1, 4, 5):
        grams = {w[i - order + 1 : i + 1] for w in padded for i in range(4, len(w))}
        assert len(m.grams[order - 1][0]) == len(grams)
    assert len(grams) > 500_000
