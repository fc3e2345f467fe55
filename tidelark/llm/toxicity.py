"""Toxic passages: the maximal segments of summed token log-odds, and how surprising they are in clean text.

Tokens score by their log-odds between toxic and clean documents under a Dirichlet prior of a fixed weight (Monroe et al.,
2008), which draws tokens of little evidence to zero, less the cost of a token. All maximal-scoring segments of a text are found in linear time
(Ruzzo and Tompa, 1999); extreme-value theory (Karlin and Altschul, 1990) says how likely clean text of the same length
holds one as good, and the significant ones together become a calibrated probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, held_out, label_shares, labelled_sample, map_texts, table
from .logistic import Logistic

#: Labelled documents of each class to learn from at most.
PER_CLASS = 10_000
#: Weight of the prior: documents with a token that are seen before any, in both classes together, and divided between them as those of all tokens are.
PRIOR = 10.0
#: What each token of a passage costs at least, so that a longer passage must say more; more where clean text would gain by its tokens on average.
COST = 1.0
#: Scores are held in steps of this size; the many tokens whose score is next to nothing, and so 0, need no entry.
STEP = 0.5
SIGNIFICANT = 0.05
THRESHOLD = 0.3
#: ASCII letters in lower case; other ASCII becomes a space; bytes of other letters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first place, last place, score), from left to right, in linear time.

    Candidates are kept with the sums before and with them, and the place of the last one before whose left sum is
    smaller. A candidate that no left sum lies below ends all before it: nothing to come can reach over the fall.
    """
    edges = np.flatnonzero(np.diff(np.r_[False, scores > 0, False]))
    begins, ends = edges[::2], edges[1::2]  # runs of positive scores
    sums = np.r_[0.0, np.cumsum(scores, dtype=float)]
    found: list[tuple[int, int, float, float]] = []
    first, last, left, right, below = [], [], [], [], []
    for a, z, low, high in zip(begins.tolist(), (ends - 1).tolist(), sums[begins].tolist(), sums[ends].tolist(), strict=True):
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = below[j]
            if j < 0:
                found += zip(first, last, left, right, strict=True)
                first, last, left, right, below = [a], [z], [low], [high], [-1]
                break
            if right[j] >= high:
                for column, value in zip((first, last, left, right, below), (a, z, low, high, j), strict=True):
                    column.append(value)
                break
            a, low = first[j], left[j]
            for column in (first, last, left, right, below):
                del column[j:]
    found += zip(first, last, left, right, strict=True)
    return [(a, z, high - low) for a, z, low, high in found]


@dataclass
class ToxicModel:
    scores: dict[bytes, float]  # of the tokens that don't score 0
    cost: float = COST
    decay: float = 1.0  # of the extreme-value distribution
    rate: float = 1e-6  # positive tokens a token of clean text
    prior: float = 0.5
    calibration: Logistic | None = None

    def passages(self, text: bytes | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """The significant segments as (first token, last token, score, p), and the number of tokens."""
        w = tokens(text)
        if not w or not self.scores:
            return [], len(w)
        get = self.scores.get
        values = np.fromiter((get(x, 0.0) for x in w), float, len(w)) - self.cost
        if values.max() <= 0:
            return [], len(w)
        least = (np.log(self.rate * len(w)) - np.log(-np.log1p(-SIGNIFICANT))) / self.decay  # score of a p of SIGNIFICANT
        kept = [(a, z, s) for a, z, s in maximal_segments(values) if s >= least]
        p = -np.expm1(-self.rate * len(w) * np.exp(-self.decay * np.array([s for *_, s in kept])))
        return [(a, z, s, x) for (a, z, s), x in zip(kept, np.maximum(p, 1e-300).tolist(), strict=True)], len(w)

    @staticmethod
    def features(found: list[tuple[int, int, float, float]], n: int) -> list[float]:
        best = max((-np.log10(p) for *_, p in found), default=0.0)
        return [min(best, 30.0), np.log1p(sum(-np.log10(p) for *_, p in found)), len(found) / np.sqrt(n + 1)]

    def predict(self, features: list[list[float]]) -> list[float]:
        if self.calibration is None:
            return [self.prior] * len(features)
        return self.calibration.predict(np.array(features).reshape(-1, 3)).tolist()


def _decay(scores: np.ndarray, shares: np.ndarray, cost: float) -> float:
    """The positive root of E[exp(decay * score)] = 1 for a token of clean text; shares of all others, which score -cost, are what is left."""
    rest = max(0.0, 1 - shares.sum())
    f = lambda x: np.log(np.sum(shares * np.exp(x * scores)) + rest * np.exp(-x * cost))
    low, high = 1e-4, 1e-3
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def token_odds(a: Column, b: Column, na: int, nb: int) -> Column:
    """Log-odds of tokens that a toxic and b clean documents hold, of classes with na and nb such pairs.

    The prior adds PRIOR documents to each token, divided as na and nb are: the less is known of a token, the nearer
    it is to 0, and with the evidence its odds grow towards the counts' own.
    """
    p = na / (na + nb)
    return F.log((a + PRIOR * p) / na) - F.log((b + PRIOR * (1 - p)) / nb)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Learns from at most per_class labelled documents of each class, those with the least hashes of their ids.

    A token counts once a document, and equal texts once, so that repetition within or between documents gives a
    token no weight. Every token of the sample has a score, whatever its sign.
    Without labels of both classes (an empty table, too) the score of a document is the share of label 1.
    """
    known = label_shares(labels, label, learn, id_col)
    prior = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1)
    sample = labelled_sample(docs, labels, label, learn, per_class, id_col, text_col).select("label", F.col("text").cast("binary").alias("t")).where("t IS NOT NULL").dropDuplicates(["t", "label"])

    def counts():
        def work(label, texts):
            documents, clean = Counter(), Counter()
            for v, t in zip(label, texts, strict=True):
                w = tokens(t)
                documents.update((x, v) for x in set(w))
                if not v:
                    clean.update(w)
            rows = list(documents.items())
            return [w for (w, _), _ in rows], [v for (_, v), _ in rows], [n for _, n in rows], [0 if v else clean[w] for (w, v), _ in rows]

        return work

    c = map_texts(sample, [F.col("label"), F.col("t")], 1, counts, [("w", "binary"), ("label", "int"), ("n", "bigint"), ("clean", "bigint")])
    c = c.groupBy("w").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"), F.sum("clean").alias("n")).persist()
    totals = c.agg(F.sum("a"), F.sum("b"), F.sum("n")).first()
    na, nb, clean_tokens = (int(x or 0) for x in totals)
    score = F.round(token_odds(F.col("a"), F.col("b"), na, nb) / STEP) * STEP if na and nb else F.lit(0.0)
    rows = c.select("w", "n", score.alias("score")).where("score <> 0").toArrow()
    c.unpersist()
    if not len(rows):
        return ToxicModel({}, prior=prior)
    odds = rows.column("score").to_numpy()
    scores = dict(zip(rows.column("w").to_pylist(), odds.tolist(), strict=True))
    shares = (rows.column("n").to_numpy() + 0.5) / (clean_tokens + 0.5 * len(rows))  # clean text may yet hold those that the sample's doesn't
    cost = max(COST, float(shares @ odds) + COST / 2)  # a token of clean text must lose on average
    values = odds - cost
    rate = float(shares[values > 0].sum())
    model = ToxicModel(scores, cost, _decay(values, shares, cost), max(rate, 1e-9), prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features():
        m = shared.value
        return lambda label, texts: (label, [m.features(*m.passages(t)) for t in texts])

    fit = map_texts(sample, [F.col("label"), F.col("t")], 1, features, [("label", "int"), ("x", "array<double>")]).collect()
    y = np.array([r["label"] for r in fit])
    weights = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.calibration = Logistic(1e-3).fit(np.array([r["x"] for r in fit]), y, weights)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, passages) for each row of docs; passages: first and last token of each significant segment, one after the other.

    NULL and empty texts have no tokens and score like a text without toxic passages; repeats score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        m = shared.value

        def work(ids, texts):
            found = [m.passages(t) for t in texts]
            return ids, m.predict([m.features(*x) for x in found]), [[x for a, z, *_ in f for x in (a, z)] for f, _ in found]

        return work

    out = map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")], 1, factory, [("_id", kind), ("score", "double"), ("passages", "array<int>")])
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
