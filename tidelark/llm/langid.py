"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the 1- to 3-grams of letters that both hold: k(x, y) = |X & Y| / sqrt(|X| |Y|). The kernel is
approximated on Nystroem landmarks, kernel ridge regression separates each language from the rest, and texts are
scored by two matrix products a batch: presence times landmarks, kernel times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blas import one_thread
from .common import crc_remainder, held_out, map_texts, slices, table

#: Texts of each language to learn from at most, those with the least hashes of their ids, and landmarks among them.
PER_LANGUAGE = 400
LANDMARKS = 32
#: n-grams are told apart by 16 bits of their hash.
BUCKETS = 1 << 16
RIDGE = 1e-2
BATCH = 128
#: How sure the best language must be for a text to be kept.
LEAST_SURE = 0.3
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(text: str) -> np.ndarray:
    """The buckets of all 1- to 3-grams of the lower-cased words, each with a space before and after; repeats included."""
    words = NOT_LETTERS.sub(" ", text.lower())
    c = np.frombuffer(f" {words.strip()} ".encode("utf-32-le"), np.uint32)
    one = c * FACTORS[0]
    two = one[:-1] * np.uint32(31) + c[1:] * FACTORS[1]
    three = two[:-1] * np.uint32(31) + c[2:] * FACTORS[2]
    h = np.concatenate([one, two ^ np.uint32(0x55555555), three ^ np.uint32(0x33333333)])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    buckets: np.ndarray  # those that a landmark holds
    landmarks: np.ndarray  # landmarks x buckets, each row divided by the square root of its n-grams
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """texts x languages, about 1 for the text's language and -1 for the others."""
        out = np.empty((len(texts), len(self.names)))
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            present = np.zeros((len(part), BUCKETS), np.bool_)
            for k, t in enumerate(part):
                present[k, ngram_buckets(t)] = True
            size = np.sqrt(present.sum(1))[:, None]
            with one_thread():
                out[i : i + BATCH] = (present[:, self.buckets].astype(np.float32) @ self.landmarks.T / size) @ self.weights
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and how sure it is; `und` and 0 for NULL and for a text without a letter."""
        names, sure = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not known or not self.names:
            return names, sure
        s = self.scores([texts[i] for i in known])
        best = s.argmax(1)
        p = np.exp(4 * (s - s.max(1, keepdims=True)))
        p = p.max(1) / p.sum(1)
        for i, b, x in zip(known, best.tolist(), p.tolist(), strict=True):
            names[i], sure[i] = self.names[b], x
        return names, sure


def fit_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Learns from at most per_language texts of each language; none is left out.

    learn: which rows may be learned from; rows without a language, an id or a text are left out. A row's language is
    its own, also where rows share an id, and equal rows count once. The sample is chosen by hashes of ids and texts,
    and of its texts only the sets of n-grams, of at most BUCKETS numbers, reach the driver.
    """
    key = F.xxhash64(F.col(text_col))
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), key.alias("_key")).distinct()
    names = sorted(r["_lang"] for r in known.select("_lang").distinct().collect())
    if not names:
        return LanguageModel([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0)))
    h = F.xxhash64("_id")
    ranked = known.select("_id", "_lang", "_key", h.alias("_h"))
    by = Window.partitionBy("_lang").orderBy("_h", "_id", "_key")  # each task keeps no more than per_language rows of a language for it
    chosen = ranked.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_language).drop("_n")
    texts = docs.where(F.col(text_col).isNotNull() & learn).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), key.alias("_key"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), ["_id", "_lang", "_key"])

    def factory():
        return lambda h, lang, texts: (h, lang, [np.unique(ngram_buckets(t)).astype(np.int32) if LETTER.search(t) else np.empty(0, np.int32) for t in texts])

    rows = map_texts(sample, [F.col("_h"), F.col("_lang"), F.col("_text")], 2, factory, [("h", "bigint"), ("lang", "string"), ("x", "array<int>")]).collect()
    rows = list({(r["h"], r["lang"], tuple(r["x"])): r for r in rows if len(r["x"])}.values())  # equal rows once
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"], r["x"]))
    chosen_rows = [r for n in names for r in [r for r in rows if r["lang"] == n][:landmarks]]
    if not chosen_rows:
        return LanguageModel([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0)))
    buckets = np.unique(np.concatenate([np.array(r["x"]) for r in chosen_rows]))
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))

    def presence(part):
        p = np.zeros((len(part), len(buckets)), np.float32)
        for k, r in enumerate(part):
            at = place[np.array(r["x"])]
            p[k, at[at >= 0]] = 1 / np.sqrt(len(r["x"]))
        return p

    marks = presence(chosen_rows)
    kernel = np.concatenate([presence(rows[i : i + 256]) @ marks.T for i in range(0, len(rows), 256)]).astype(float)
    own = (marks @ marks.T).astype(float)
    y = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in rows])
    balance = np.array([1 / sum(r["lang"] == n for r in rows) if any(r["lang"] == n for r in rows) else 0 for n in names])
    w = np.array([balance[names.index(r["lang"])] for r in rows])
    w *= len(rows) / w.sum()
    a = (kernel * w[:, None]).T @ kernel + RIDGE * len(rows) / len(names) * (own + 1e-6 * np.eye(len(own)))
    return LanguageModel(names, buckets, marks, np.linalg.solve(a, (kernel * w[:, None]).T @ y))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of docs. Equal texts get equal results; other columns aren't looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        m = shared.value
        return lambda ids, texts: (ids, *m.predict(texts))

    out = map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).alias("_t")], 1, factory, [("_id", kind), ("lang_pred", "string"), ("score", "double")], most_bytes=4 << 20)
    return out.withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = LEAST_SURE) -> DataFrame:
    """docs without the rows whose language can't be told: NULL, no letter, or no language that stands out.

    The rows that stay have all their columns, repeats included. A model that has learned no language rejects only
    texts that are NULL or have no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                texts = part.column(at).to_pylist()
                if m.names:
                    names, sure = m.predict(texts)
                    keep = [n != "und" and s >= least for n, s in zip(names, sure, strict=True)]
                else:
                    keep = [bool(t and LETTER.search(t)) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned(id_col: str = "doc_id") -> Column:
    return crc_remainder(F.col(id_col), 3) != 1


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_languages(docs, fit_languages(docs, learned()))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
