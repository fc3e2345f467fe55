"""Quality by compression: how much better a zstandard dictionary of good text fits a document than one of bad text.

Every document is compressed whole, in chunks short enough for the dictionaries to matter throughout, with either
dictionary. The normalised difference of the sizes, and the sizes against the text's, become a calibrated probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, held_out, label_shares, labelled_sample, map_texts, table
from .logistic import Logistic

#: Labelled documents of each class to learn from at most: a half builds the dictionaries, a half calibrates.
PER_CLASS = 4000
DICTIONARY = 65_536
CHUNK = 4096
#: Chunks of the whole texts of each class that its dictionary is built from at most, those with the least hashes.
CHUNKS = 4000
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes]  # of bad and good text
    prior: float
    empty: float = 0.5  # of texts without a byte, which compression says nothing of
    calibration: Logistic | None = None
    _compressors: list = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"_compressors": []}

    def _ready(self) -> list:
        if not self._compressors:
            for d in self.dictionaries:
                trained = zstandard.ZstdCompressionDict(d) if d[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                trained.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_dict_id=False, write_checksum=False))
        return self._compressors

    def features(self, text: bytes) -> list[float]:
        """Normalised differences (over the text, in its worst chunk and its best), sizes for the text's, and length."""
        bad, good = (np.array([len(c.compress(text[i : i + CHUNK])) for i in range(0, len(text), CHUNK)], float) for c in self._ready())
        n = np.minimum(CHUNK, len(text) - CHUNK * np.arange(len(bad)))
        diff = (good - bad) / (good + bad)
        ratio = np.log(np.minimum(good, bad) / (n + 16))
        whole = np.log(np.minimum(good, bad).sum() / (len(text) + 16))
        return [(good - bad).sum() / (good + bad).sum(), diff.max(), diff.min(), whole, ratio.min(), ratio.max(), np.log1p(len(text))]

    def scores(self, texts: list[bytes | None]) -> list[float]:
        out = [self.empty] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if self.calibration is None:
            p = [self.prior] * len(full)
        else:
            p = self.calibration.predict(np.array([self.features(texts[i]) for i in full]).reshape(-1, 7)).tolist()
        for i, x in zip(full, p, strict=True):
            out[i] = x
        return out


def _own_lines(samples: list[bytes]) -> list[bytes]:
    """The samples without the lines that several of them have: shared passages say nothing of quality."""
    seen = Counter(line for s in samples for line in set(s.split(b"\n")))
    return [b"\n".join(x for x in s.split(b"\n") if seen[x] == 1) for s in samples]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\n"


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learns from at most per_class labelled documents of each class, those with the least hashes of their ids.

    learn: which rows of labels may be learned from. Without labels of both classes (an empty table, too) the score is the
    share of label 1. At most CHUNKS pieces of CHUNK bytes a class reach the driver, however long the texts are.
    """
    share = label_shares(labels, label, learn, id_col)
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    without = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) == 0)
    none = labelled_sample(without, labels, label, learn, per_class, id_col, text_col).agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    empty = (none[0] + prior) / (none[1] + 1)
    sample = labelled_sample(docs.where(F.octet_length(text_col) > 0), labels, label, learn, per_class, id_col, text_col).withColumn("half", F.pmod(F.hash("_h"), F.lit(2)))
    text = F.col("text").cast("binary")
    chunks = sample.where("half = 0").select("label", text.alias("_t"), "_h", F.explode(F.sequence(F.lit(0), F.octet_length(text) - 1, F.lit(CHUNK))).alias("at"))
    chunks = chunks.select("label", F.expr(f"substring(_t, at + 1, {CHUNK})").alias("t"), F.xxhash64("_h", "at").alias("h"))
    rows = [r for v in (0, 1) for r in chunks.where(F.col("label") == v).orderBy("h", "t").limit(CHUNKS).collect()]
    rows.sort(key=lambda r: (r["h"], bytes(r["t"])))
    own = _own_lines([bytes(r["t"]) for r in rows])
    samples = [[t for t, r in zip(own, rows, strict=True) if t and r["label"] == v] for v in (0, 1)]
    if not all(samples):
        return QualityModel((b"\n", b"\n"), prior, empty)
    model = QualityModel((_dictionary(samples[0]), _dictionary(samples[1])), prior, empty)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value
        return lambda label, texts: (label, [m.features(t) for t in texts])

    fit = map_texts(sample.where("half = 1"), [F.col("label").alias("label"), text.alias("t")], 1, factory, [("label", "int"), ("x", "array<double>")]).collect()
    y = np.array([r["label"] for r in fit])
    if len(set(y.tolist())) == 2:
        weights = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.calibration = Logistic(1e-3).fit(np.array([r["x"] for r in fit]), y, weights)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) for each row of docs. NULL and empty texts have the share of label 1 among labelled empty texts; ties and repeats score alike; an empty table gives an empty result; whole texts are read, however long."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        m = shared.value
        return lambda ids, texts: (ids, m.scores(texts))

    out = map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")], 1, factory, [("_id", kind), ("score", "double")])
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, crc_remainder(F.col("doc_id"), 5) != 0)
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
