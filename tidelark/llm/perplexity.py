"""Quality rules: counts of words, symbols, repeated lines and passages, and an n-gram model that says how odd a text is for its language.

The model is a modified Kneser-Ney model of the characters of words, one for each value of lang. Its grams are counted on Spark over
every word of every document; discounts, continuation counts and contexts are aggregates of the table of grams. It is
stored in sorted arrays of hashes, an array of grams and one of contexts for each order, which every task gets. A
text's perplexity is that of all its words, each looked up once a task; documents above or below the band of their
language are rejected. Words give their language away by their letters, and a table of word n-grams would be as large
as the corpus: of 27 million words of the 0.1 GB table, 12 million pairs are different.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, slices, table, written

ORDER = 5
#: Symbols before and after a word. In a word they, and NUL, count as an unknown character.
BEGIN, END, UNKNOWN = 2, 3, 0xFFFD
#: A band reaches from the quartiles by REACH times their distance, which counts as LEAST_SPREAD at least; perplexities are held as logarithms to base 10, in steps of 1 / STEPS.
REACH, LEAST_SPREAD, STEPS = 6.0, 0.02, 1000
#: The documents whose perplexity makes up the bands, and the rules that reject without it.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS = b"#*$%&|<>"
#: Bytes of a text that are split into words at a time, places of words that are looked up at a time, words that a task remembers.
PIECE, PLACES, WORDS = 1 << 22, 1 << 19, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> int:
    return int.from_bytes(lang.encode()[:7], "little") * 31 + len(lang)


def symbols(words: list[bytes]) -> np.ndarray:
    """The code points of words, each with END behind it."""
    codes = np.frombuffer((b"\n".join(words) + b"\n").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    codes[np.isin(codes, (0, BEGIN, END))] = UNKNOWN
    codes[codes == 10] = END  # words hold no line ends
    return codes


def windows(codes: np.ndarray):
    """(begin, columns) for parts of the places: the ORDER - 1 symbols before each place, within its word, and its own."""
    ends = np.flatnonzero(codes == END)
    for a in range(0, len(codes), PLACES):
        at = np.arange(a, min(a + PLACES, len(codes)))
        word = np.searchsorted(ends, at)
        start = np.where(word > 0, ends[word - 1] + 1, 0)
        yield a, [np.where(at - k >= start, codes[np.maximum(at - k, 0)], BEGIN) for k in range(ORDER - 1, 0, -1)] + [codes[at]]


def word_places(codes: np.ndarray) -> np.ndarray:
    """Of each word, how many places it has."""
    return np.diff(np.flatnonzero(codes == END), prepend=-1)


@dataclass
class NgramModel:
    grams: list[tuple[np.ndarray, np.ndarray]]  # of each order, hashes in order and the discounted share of their context
    contexts: list[tuple[np.ndarray, np.ndarray]]  # hashes in order, and the share that is left to the shorter context
    kinds: dict[str, int]  # of each language, the different symbols

    def places(self, codes: np.ndarray, lang: str) -> np.ndarray:
        """log10 of the probability of each symbol, given those before it in its word."""
        out = np.empty(len(codes))
        for a, columns in windows(codes):
            p = np.full(len(columns[0]), 1.0 / (self.kinds.get(lang, 0) + 1))
            for k in range(1, ORDER + 1):
                h = np.full(len(p), _seed(lang), np.uint64)
                for c in columns[ORDER - k : -1]:
                    h = _mixed(h, c)
                left = _looked_up(self.contexts[k - 1], h, 1.0)
                p = _looked_up(self.grams[k - 1], _mixed(h, columns[-1]), 0.0) + left * p
            out[a : a + len(p)] = np.log10(p)
        return out

    def words(self, words: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the sum over its places, and how many there are."""
        if not words:
            return np.empty(0), np.empty(0, np.int64)
        codes = symbols(words)
        n = word_places(codes)
        return np.add.reduceat(self.places(codes, lang), np.cumsum(n) - n), n


def _looked_up(pair: tuple[np.ndarray, np.ndarray], h: np.ndarray, default: float) -> np.ndarray:
    keys, values = pair
    if not len(keys):
        return np.full(len(h), default)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], default)


def split_words(text: bytes):
    """The words of a text, as lists of a piece of it each."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, c): how often each run of ORDER symbols ends at a place of a word, over all texts. A task adds its counts up before they are shuffled; NULL languages are a group of their own, named by the empty string."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])

    def counted(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = symbols(list(words))
        weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), word_places(codes))
        parts = []
        for a, columns in windows(codes):
            h = np.zeros(len(columns[0]), np.uint64)
            for c in columns:
                h = _mixed(h, c)
            parts.append((h, np.stack(columns, 1), weight[a : a + len(h)]))
        return added(parts)

    def added(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, grams, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, group = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, group, c)
        return keys, grams[first], total

    def run(batches):
        words: dict[str, dict[bytes, int]] = {}
        sums: dict[str, list] = {}

        def flush(lang: str, emit: bool):
            if words.get(lang):
                sums.setdefault(lang, []).append(counted(words.pop(lang)))
            if sums.get(lang) and (emit or len(sums[lang]) > 8):
                sums[lang] = [added(sums[lang])]
                if emit or len(sums[lang][0][0]) > PLACES:
                    _, grams, c = sums.pop(lang)[0]
                    text = np.ascontiguousarray(grams.astype("<u4")).view(f"<U{ORDER}").ravel().tolist()
                    return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(text, pa.string()), pa.array(c)], schema=schema)

        for batch in batches:
            for part in slices(batch, 1, PIECE):
                for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = words.setdefault(lang, {})
                    get = own.get
                    for some in split_words(text):
                        for w in some:
                            own[w] = get(w, 0) + 1
                    if len(own) > WORDS // 4 and (out := flush(lang, False)) is not None:
                        yield out
        for lang in sorted({*words, *sums}):
            if (out := flush(lang, True)) is not None:
                yield out

    d = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return d.mapInArrow(run, "lang string, gram string, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(types: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of the counts of one order, by how many grams are counted once, twice, three and four times."""
    n = types.groupBy("lang").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    value = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i / 2))))
    return n.select("lang", *(value(i).alias(f"d{i}") for i in (1, 2, 3)))


def fit_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> NgramModel:
    """The model of all texts, with every gram that occurs in them: 16 bytes each on the driver and in every task. An empty table gives one that knows no symbol."""
    types = written(gram_counts(docs, lang_col, text_col))
    grams, contexts, kinds = [], [], {}
    for k in range(ORDER, 0, -1):
        d = _discounts(types)
        by = Window.partitionBy("lang", "context")
        t = types.withColumn("context", F.left("gram", F.lit(k - 1)))
        whole = t.groupBy("lang", "context").agg(F.sum("c").alias("whole"))
        few = F.broadcast(d) if d.count() <= 10_000 else d  # a row a language
        t = t.join(few, "lang").join(whole, ["lang", "context"])
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.select("lang", "gram", ((F.col("c") - cut) / F.col("whole")).alias("share"), F.sum((F.col("c") - cut) / F.col("whole")).over(by).alias("taken"))
        grams.append(_collected(t.select("lang", "gram", F.col("share").alias("v")), k))
        contexts.append(_collected(t.groupBy("lang", F.left("gram", F.lit(k - 1)).alias("gram")).agg(F.greatest(F.lit(0.0), 1 - F.first("taken")).alias("v")), k - 1))
        if k == 1:
            kinds = {r["lang"]: r["count"] for r in types.groupBy("lang").count().collect()}
        else:  # of a shorter gram, how many symbols stand before it; at the beginning of words, where only BEGIN does, how often it occurs
            shorter = types.groupBy("lang", F.right("gram", F.lit(k - 1)).alias("gram")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
            types = written(shorter.select("lang", "gram", F.when(F.ascii("gram") == BEGIN, F.col("c")).otherwise(F.col("n")).alias("c")))
    return NgramModel(grams[::-1], contexts[::-1], kinds)


def _collected(rows: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and values of grams of a length. Tasks make the hashes: 16 bytes a gram reach the driver."""

    def hashed(batches):
        for b in batches:
            h = np.array([_seed(x) for x in b.column("lang").to_pylist()], np.uint64)
            codes = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(h), length)
            for j in range(length):
                h = _mixed(h, codes[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("v")], ["h", "v"])

    t = rows.select("lang", "gram", F.col("v").cast("double").alias("v")).mapInArrow(hashed, "h bigint, v double").toArrow()
    h = t.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], t.column("v").to_numpy().astype(np.float64)[order]


def repeated_words(ids: np.ndarray) -> int:
    """The words in runs of three that come twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() >= 1 << 21:
        ids = np.unique(ids, return_inverse=True)[1]
    if ids.max() < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


BASE = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint")]


def measured(docs: DataFrame, model: NgramModel | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(_id, _lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity), one row a row. NULL texts count as empty; without words, or a model, log_perplexity is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        m = shared.value
        known: dict[str, dict[bytes, int]] = {}
        state = {"score": np.empty(0), "places": np.empty(0, np.int64)}

        def learn(lang: str, words: set[bytes]) -> dict[bytes, int]:
            own = known.setdefault(lang, {})
            new = sorted(words - own.keys())
            at = len(state["places"])
            s, n = m.words(new, lang) if m is not None else (np.zeros(len(new)), np.ones(len(new), np.int64))
            own.update(zip(new, range(at, at + len(new)), strict=True))
            state["score"], state["places"] = np.concatenate([state["score"], s]), np.concatenate([state["places"], n])
            return own

        def work(ids, langs, texts):
            if len(state["places"]) > WORDS:
                known.clear()
                state["score"], state["places"] = np.empty(0), np.empty(0, np.int64)
            new: dict[str, set[bytes]] = {}
            for lang, t in zip(langs, texts, strict=True):
                if len(t) <= PIECE:
                    new.setdefault(lang, set()).update(t.split())
            for lang, words in new.items():
                learn(lang, words)
            out = [[] for _ in range(6)]
            for lang, t in zip(langs, texts, strict=True):
                own = known.get(lang, {})
                at = []
                for words in split_words(t):
                    if len(t) > PIECE:
                        own = learn(lang, set(words))
                    at.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                at = np.concatenate(at) if at else np.empty(0, np.int64)
                counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if t else np.zeros(256, np.int64)
                lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
                places = int(state["places"][at].sum())
                row = (len(at), int(counts[:128].sum() + counts[192:].sum() - counts[32] - counts[9:14].sum()), int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(at), -float(state["score"][at].sum()) / places if places else 0.0)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return ids, langs, *out

        return work

    columns = [F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t")]
    return map_texts(docs, columns, 2, factory, [("_id", kind), ("_lang", "string"), *BASE, ("log_perplexity", "double")], PIECE)


def bands(rows: DataFrame) -> DataFrame:
    """(_lang, low, high) of rows (_lang, log_perplexity): quartiles by counts of the steps, and REACH times their distance beyond them."""
    h = rows.groupBy("_lang", F.round(F.col("log_perplexity") * STEPS).cast("long").alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("_lang")
    h = h.withColumns({"upto": F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("x"))) / STEPS
    b = h.groupBy("_lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    return b.select("_lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quality_rules(docs: DataFrame, model: NgramModel | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity, low, high), one row a row.

    base_failed: under LEAST_WORDS words, or more than a half of them in repeated passages. Documents that didn't fail
    make the bands of their languages (NULL is one), and are kept within them. Equal rows fare alike, long texts are taken whole,
    an empty table gives an empty one, other columns are not looked at.
    """
    model = model or fit_ngrams(docs, lang_col, text_col)
    rows = written(measured(docs, model, id_col, lang_col, text_col))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * MOST_REPEATED)
    rows = rows.withColumn("base_failed", failed)
    band = written(bands(rows.where("NOT base_failed")))
    band = F.broadcast(band) if band.count() <= 10_000 else band  # a row a language
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    out = rows.join(band, "_lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return out.select(F.col("_id").alias(id_col), *(c for c, _ in BASE), "base_failed", "kept", "log_perplexity", "low", "high")


def op13_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
