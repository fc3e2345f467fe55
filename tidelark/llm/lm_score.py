"""Language-model scores of texts against a unigram base.

A causal self-attention model gives the probability of every subword of a text after those before it, and of the end:
each word, after a space, is encoded in the ids of a public byte-level vocabulary, and the softmax is over that whole vocabulary (in
two steps, attention.py). Any word has its ids. Ids that no training text holds can't be told apart by it: they are one class, whose
probability they share equally.

`WordModel` is the cheaper model of whole words for those who can't afford all subwords: the attention model gives the subword
that a word begins with, one of a few, and the corpus's counts say which of the words with this subword it is:

    P(word | context) = P(subword | context) * (c + 1) / (C + V + 1)

c, C, V: the word's count, and the tokens and distinct words with its subword, in all training texts.
"""

from __future__ import annotations

import copy
import dataclasses
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import Attention
from .bpe import pieces_of, vocabulary
from .common import crc_remainder, held_out, map_texts, most_frequent, slices, table, written

#: The most frequent words, which are sent to every executor; the counts of the others are joined to the texts' words.
FREQUENT = 200_000
#: Different words that a task counts before it gives them away.
HELD = 200_000
#: Subwords of a WordModel, without the one of all other words and the end of a text.
SUBWORDS = 62
#: The attention model trains on every training token: texts are cut into pieces of PIECE tokens, which are dealt into groups
#: of about GROUP tokens by their hash. The driver begins with one group; the others follow in rounds, in each of which every
#: group trains its own copy of the model, and the copies are averaged.
PIECE, GROUP = 4096, 1 << 19
#: First and last learning rate of each round, for steps of 64 windows; larger steps have rates as many times higher.
ROUNDS = ((0.004, 0.001), (0.003, 0.0005), (0.002, 0.0001))
#: Steps at least; a small corpus is passed over more than once.
LEAST_STEPS = 400
#: Weights that are averaged in one row.
CHUNK = 1 << 14
#: Share of the subword's own frequency in its probability.
SMOOTH = 0.02
LONGEST_PIECE = 8
#: Ids below which the subword model's softmax isn't grouped, and the windows of its training steps.
HEAD, BATCH = 32, 256


@dataclass
class WordModel:
    word: dict[bytes, int]  # places of the frequent words
    log_count: np.ndarray  # log10(c + 1)
    subword: np.ndarray  # of each frequent word
    piece: dict[bytes, int]  # subwords
    tokens: int  # N
    distinct: int  # V
    documents: int
    log_rest: np.ndarray | None = None  # log10(C + V + 1) of each subword
    share: np.ndarray | None = None
    attention: Attention | None = None
    batch = 64  # windows of a training step

    @property
    def other(self) -> int:
        return len(self.piece)

    @property
    def end(self) -> int:
        return len(self.piece) + 1

    def subword_of(self, w: bytes) -> int:
        get = self.piece.get
        for n in range(min(LONGEST_PIECE, len(w)), 0, -1):
            k = get(w[:n])
            if k is not None:
                return k
        return self.other

    @property
    def size(self) -> int:
        return len(self.piece) + 2

    @property
    def places(self) -> int:
        """Places of the training texts that the attention model learns from."""
        return self.tokens

    def network(self) -> Attention:
        return Attention(self.size)

    def for_parsing(self) -> WordModel:
        return WordModel(self.word, np.empty(0), self.subword, self.piece, 0, 0, 0)

    def ids_of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return [self.parse(t)[1] for t in texts]

    def parse(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of the frequent words (-1: others), the subwords of all tokens with the end, and the other words."""
        w = (text or b"").lower().split()
        at = np.fromiter(map(self.word.get, w, [-1] * len(w)), np.int64, len(w))
        ids = np.empty(len(w) + 1, np.int64)
        ids[:-1] = self.subword[at] if len(self.subword) else self.other
        rare_at = np.flatnonzero(at < 0)
        rare = [w[i] for i in rare_at.tolist()]
        ids[rare_at] = np.fromiter(map(self.subword_of, rare), np.int64, len(rare))
        ids[-1] = self.end
        return at, ids, rare

    def score(self, texts: list[bytes | None]):
        """Of each text: tokens, known among the frequent and the end, sums of log10(c + 1) over these, sums of what the subwords add, and the other words."""
        parsed = [self.parse(t) for t in texts]
        ids = np.concatenate([x[1] for x in parsed]) if parsed else np.empty(0, np.int64)
        ends = np.cumsum([len(x[1]) for x in parsed], dtype=np.int64)
        p = self.share[ids]
        if self.attention is not None:
            p = (1 - SMOOTH) * np.exp(self.attention.scores(ids, ends).astype(float)) + SMOOTH * p
        gain = np.log10(p) - self.log_rest[ids]
        gain = np.add.reduceat(gain, ends - [len(x[1]) for x in parsed]) if len(parsed) else gain
        known = [int((at >= 0).sum()) + (self.documents > 0) for at, *_ in parsed]
        sums = [float(self.log_count[at[at >= 0]].sum()) + float(np.log10(self.documents + 1)) for at, *_ in parsed]
        return [len(x[1]) for x in parsed], known, sums, gain.tolist(), [x[2] for x in parsed]


def encoded(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words one after the other, each word after a space and for itself, and the number of each word's ids."""
    place: dict[str, int] = {}
    per = [[place.setdefault(p, len(place)) for p in ((" " + w.decode(),) if w.isalpha() else pieces_of(" " + w.decode("utf-8", "surrogateescape")))] for w in words]  # ASCII letters alone are one piece
    found = vocabulary(path).merge([p.encode("utf-8", "surrogateescape") for p in place])
    lengths = np.array([len(x) for x in found], np.int64)
    pieces = np.array([p for x in per for p in x], np.int64)
    of_word = np.repeat(np.arange(len(words)), np.array([len(x) for x in per], np.int64))
    return gathered(found and np.concatenate(found), lengths, pieces), np.bincount(of_word, lengths[pieces], len(words)).astype(np.int64)


def gathered(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows, of these lengths, of a ragged table one after the other."""
    if not len(rows):
        return np.empty(0, np.int64)
    begin, n = (np.cumsum(lengths) - lengths)[rows], lengths[rows]
    return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def packed(ids: np.ndarray, size: int) -> bytes:
    """Ids up to size as bytes: all lowest bytes first, then the next ones, most of which are 0 and compress."""
    kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
    return ids.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def unpacked(data, size: int) -> np.ndarray:
    kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass
class SubwordModel(WordModel):
    """Ids are numbered by frequency in the training texts, with the end of a text among them and, last, the class of all ids that don't occur."""

    path: str = ""
    lengths: np.ndarray | None = None  # how many ids each frequent word has; the ids are in subword
    number: np.ndarray | None = None  # of each id of the vocabulary
    unseen: int = 0  # ids in the last class
    own_end: int = 0
    places_: int = 0
    batch = BATCH

    @property
    def end(self) -> int:
        return self.own_end

    @property
    def size(self) -> int:
        return len(self.share)

    @property
    def places(self) -> int:
        return self.places_

    def network(self) -> Attention:
        return Attention(self.size, head=HEAD)

    def for_scoring(self) -> SubwordModel:
        """Without the words, which parsed texts don't need."""
        return dataclasses.replace(self, word={}, log_count=np.empty(0), subword=np.empty(0, np.int64), lengths=None, number=None)

    def parse_all(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[list[bytes]]]:
        """Of each text the places of the frequent words (-1: others), and the other words; the ids of all texts with their ends, one after the other, and where each text's stop."""
        split = [(t or b"").lower().split() for t in texts]
        extra: dict[bytes, int] = {}
        get, known, rare, rows = self.word.get, len(self.lengths), [], []
        stop = np.zeros(1, np.int64)  # the row of the end, after all others
        for words in split:
            at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            other = np.flatnonzero(at < 0)
            rare.append([words[i] for i in other.tolist()])
            row = at.copy()
            row[other] = [known + extra.setdefault(w, len(extra)) for w in rare[-1]]
            rows += [(at, row)]
        flat, lengths = encoded(self.path, list(extra))
        stop[0] = known + len(extra)
        if not texts:
            return [], np.empty(0, np.int64), np.empty(0, np.int64), []
        every = np.concatenate([v for _, row in rows for v in (row, stop)])
        kind = np.int32 if len(self.subword) + len(flat) < 1 << 31 else np.int64
        n = np.concatenate([self.lengths, lengths, [1]]).astype(kind).take(every)
        begin = np.cumsum(np.concatenate([self.lengths, lengths, [1]])).astype(kind).take(every) - n
        flat = np.concatenate([self.subword, self.number.take(flat), [self.end]]).astype(np.int32)
        ends = np.cumsum(n)
        step = np.ones(int(ends[-1]), kind)  # places of the ids: one after the other within a word
        nonempty = n > 0
        first, where = begin[nonempty], (ends - n)[nonempty]
        step[where] = first - np.r_[0, (first + n[nonempty] - 1)[:-1]].astype(kind)
        return [at for at, _ in rows], flat.take(np.cumsum(step)), ends.take(np.cumsum([len(row) + 1 for _, row in rows]) - 1), rare

    def parsed(self, texts: list[bytes | None]):
        """Of each text: tokens, known among the frequent and the end, sums of log10(c + 1) over these, the other words, and its ids as bytes."""
        at, ids, ends, rare = self.parse_all(texts)
        known = [int((a >= 0).sum()) + (self.documents > 0) for a in at]
        sums = [float(self.log_count[a[a >= 0]].sum()) + float(np.log10(self.documents + 1)) for a in at]
        return [len(a) + 1 for a in at], known, sums, rare, [packed(x, self.size) for x in np.split(ids, ends[:-1])] if len(texts) else []

    def log10_probabilities(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self.share.take(ids)
        if self.attention is not None:
            p *= SMOOTH
            own = np.exp(self.attention.scores(ids, ends).astype(float))
            own *= 1 - SMOOTH
            p += own
        if self.unseen > 1:
            p[ids == self.size - 1] /= self.unseen
        return np.log10(p, out=p)

    def totals(self, ids: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text, of its ids."""
        ends = np.cumsum([len(x) for x in ids])
        return np.add.reduceat(self.log10_probabilities(np.concatenate(ids), ends), np.r_[0, ends[:-1]]) if len(ids) else np.empty(0)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, c): every distinct lower-cased word of the texts, as bytes, and its count; counted in tasks, up to HELD words at a time, before the shuffle."""

    def run(batches):
        count: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["w", "c"])

        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                count.update(chain.from_iterable(t.lower().split() for t in part.column(0).to_pylist()))
                if len(count) > HELD:
                    yield rows()
                    count.clear()
        if count:
            yield rows()

    texts = docs.select(F.col(text_col).cast("binary").alias("t")).where("t IS NOT NULL")
    return texts.mapInArrow(run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _pieces(path: str, frequent: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """The pieces of the vocabulary that most frequent words begin with, longest match first."""
    every = {t[1:] for t in vocabulary(path).token_bytes if t[:1] == b" " and 1 < len(t) <= LONGEST_PIECE + 1}
    count: dict[bytes, int] = {}
    for w, c in frequent:
        for n in range(min(LONGEST_PIECE, len(w)), 0, -1):
            if w[:n] in every:
                count[w[:n]] = count.get(w[:n], 0) + c
                break
    best = sorted(count, key=lambda t: (-count[t], t))[:SUBWORDS]
    return {t: i for i, t in enumerate(best)}


def _counted(docs: DataFrame, learn: Column, id_col: str, text_col: str, frequent: int) -> tuple[DataFrame, DataFrame, list[tuple[bytes, int]], int, int, int]:
    """The rows to learn from, the counts of their words, the most frequent words, N, V and the number of rows."""
    train = docs.where(learn).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts = written(word_counts(train, "_text"))
    documents = train.select("_id").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = [(bytes(w), c) for w, c in most_frequent(counts, frequent)]
    return train, counts, top, total["n"] + documents, total["v"] + (documents > 0), documents


def fit_subwords(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[SubwordModel, DataFrame]:
    """The model of all subwords, and the table of all word counts. Every row that may be learned from is counted and trained on."""
    m, counts = number_subwords(docs, learn, path, id_col, text_col, frequent)
    train_subwords(parse_texts(docs.where(learn), m, id_col, text_col), m)
    return m, counts


def train_subwords(parsed: DataFrame, m: SubwordModel) -> None:
    """Trains the attention weights on all of these parsed texts."""
    m.attention = _fit_attention(_pieces_of_parsed(parsed, m.size), m)


def number_subwords(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[SubwordModel, DataFrame]:
    """The model without attention weights, which parses texts, and the table of all word counts."""
    _, counts, top, tokens, distinct, documents = _counted(docs, learn, id_col, text_col, frequent)
    public = len(vocabulary(path).token_bytes)

    def per_id():
        def work(words, c):
            ids, n = encoded(path, words)
            total = np.bincount(ids, np.repeat(np.array(c, float), n), public).astype(np.int64)
            some = np.flatnonzero(total)
            return some.tolist(), total[some].tolist()

        return work

    sums = map_texts(counts, [F.col("w"), F.col("c")], 0, per_id, [("k", "bigint"), ("c", "bigint")]).groupBy("k").agg(F.sum("c").alias("c")).collect()  # at most the vocabulary
    c = np.zeros(public + 1)
    for r in sums:
        c[r["k"]] = r["c"]
    c[public] = documents
    order = np.argsort(-c, kind="stable")
    order = order[(c[order] > 0) | (order == public)]
    number = np.full(public + 1, len(order))
    number[order] = np.arange(len(order))
    words = [w for w, _ in top]
    ids, lengths = encoded(path, words)
    share = np.r_[c[order], 0] + 1
    m = SubwordModel({w: i for i, w in enumerate(words)}, np.log10(np.array([n for _, n in top], float) + 1), number[ids], {}, tokens, distinct, documents, None, share / share.sum(), None, path, lengths, number, public + 1 - len(order), int(number[public]), int(c.sum()))
    return m, counts


def fit_words(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[WordModel, DataFrame]:
    """The model, and the table of all word counts. Counts are of all rows that may be learned from."""
    spark = docs.sparkSession
    train, counts, top, tokens, distinct, documents = _counted(docs, learn, id_col, text_col, frequent)
    piece = _pieces(path, top)
    m = WordModel({w: i for i, (w, _) in enumerate(top)}, np.log10(np.array([c for _, c in top], float) + 1), np.empty(0, np.int64), piece, tokens, distinct, documents)
    m.subword = np.array([m.subword_of(w) for w, _ in top], np.int64)
    shared = spark.sparkContext.broadcast(m.piece)

    def per_subword():
        small = WordModel({}, np.empty(0), np.empty(0), shared.value, 0, 0, 0)

        def work(words, c):
            k = np.fromiter(map(small.subword_of, words), np.int64, len(words))
            n = len(shared.value) + 1
            return list(range(n)), np.bincount(k, np.array(c, float), n).astype(np.int64).tolist(), np.bincount(k, minlength=n).tolist()

        return work

    sums = map_texts(counts, [F.col("w"), F.col("c")], 0, per_subword, [("k", "bigint"), ("c", "bigint"), ("v", "bigint")]).groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    c, v = np.zeros(m.end + 1), np.zeros(m.end + 1)
    for r in sums:
        c[r["k"]], v[r["k"]] = r["c"], r["v"]
    c[m.end], v[m.end] = documents, documents > 0
    m.log_rest = np.log10(c + v + 1)
    m.share = (c + 1) / (c + 1).sum()
    m.attention = _fit_attention(_pieces_of_texts(train, m), m)
    return m, counts


def _pieces_of_texts(train: DataFrame, m: WordModel) -> DataFrame:
    """(h, at, ids): all training texts as subwords, in pieces of at most PIECE after the one before them."""
    shared = train.sparkSession.sparkContext.broadcast(m.for_parsing())

    def factory():
        begin = shared.value.size

        def work(h, texts):
            out = ([], [], [])
            for x, own in zip(h, shared.value.ids_of(texts), strict=True):
                ids = np.r_[begin, own].astype(np.int32)
                for at in range(0, len(ids) - 1, PIECE):
                    for column, value in zip(out, (x, at, ids[at : at + PIECE + 1]), strict=True):
                        column.append(value)
            return out

        return work

    return map_texts(train, [F.xxhash64("_id", "_text").alias("_h"), F.col("_text").cast("binary").alias("_t")], 1, factory, [("h", "bigint"), ("at", "bigint"), ("ids", "array<int>")], most_bytes=2 << 20)


def parse_texts(docs: DataFrame, m: SubwordModel, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None) -> DataFrame:
    """(_id, _key, _h, _learn, n, known, sums, rare, ids), written: each text is split and encoded once, for training and scoring."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        return lambda ids, keys, h, learn, texts: (ids, keys, h, learn, *shared.value.parsed(texts))

    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [F.col(id_col).alias("_id"), F.xxhash64(text.cast("binary")).alias("_key"), F.xxhash64(F.col(id_col), text).alias("_h"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("_learn"), text.cast("binary").alias("_t")]
    schema = [("_id", kind), ("_key", "bigint"), ("_h", "bigint"), ("_learn", "boolean"), ("n", "bigint"), ("known", "bigint"), ("sums", "double"), ("rare", "array<binary>"), ("ids", "binary")]
    return written(map_texts(docs, columns, 4, factory, schema, most_bytes=2 << 20))


def _pieces_of_parsed(parsed: DataFrame, size: int) -> DataFrame:
    """(h, at, ids): all parsed texts to learn from, in pieces of at most PIECE after the id before them, as bytes."""

    def factory():
        def work(h, texts):
            out = ([], [], [])
            for x, own in zip(h, texts, strict=True):
                ids = np.r_[size, unpacked(own, size)]
                for at in range(0, len(ids) - 1, PIECE):
                    for column, value in zip(out, (x, at, packed(ids[at : at + PIECE + 1], size)), strict=True):
                        column.append(value)
            return out

        return work

    return map_texts(parsed.where("_learn"), [F.col("_h"), F.col("ids")], 1, factory, [("h", "bigint"), ("at", "bigint"), ("ids", "binary")], most_bytes=2 << 20)


def _ids_of_piece(data, size: int) -> np.ndarray:
    return unpacked(data, size) if isinstance(data, bytes | bytearray | pa.Buffer) else np.asarray(data)


def _trained_copies(pieces: DataFrame, net: Attention, rate: float, least: float, windows: int) -> list[np.ndarray]:
    """The average over all groups of the copies of net that they train, weighted by their windows.

    Sums are of whole numbers, so that they don't depend on the order of tasks.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        start = shared.value
        total, count = np.zeros(sum(v.size for v in start.w.values()), np.int64), 0

        def add(part):
            own = copy.deepcopy(start)
            x, y, valid = own.blocks(part)
            own.train(x, y, valid, batch=windows, rate=rate, least=least)
            return np.rint(np.concatenate([v.ravel() for v in own.w.values()]).astype(float) * (1 << 24)).astype(np.int64) * len(x), len(x)

        part, tokens, group = [], 0, None
        for batch in batches:
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part and (g != group or tokens >= 2 * GROUP):  # equal rows can make a group large
                    w, n = add(part)
                    total, count, part, tokens = total + w, count + n, [], 0
                part.append(_ids_of_piece(ids.as_buffer() if pa.types.is_binary(ids.type) else ids.values.to_numpy(), start.size))
                tokens, group = tokens + len(part[-1]), g
        if part:
            w, n = add(part)
            total, count = total + w, count + n
        if count:
            for i, at in enumerate(range(0, len(total), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[at : at + CHUNK].tobytes()]), pa.array([count])], ["i", "w", "n"])

    def add(t: pa.Table) -> pa.Table:
        w = np.sum([np.frombuffer(x, np.int64) for x in t.column("w").to_pylist()], 0)
        return pa.table({"i": t.column("i").slice(0, 1), "w": [w.tobytes()], "n": [sum(t.column("n").to_pylist())]})

    kinds = "i bigint, w binary, n bigint"
    sums = pieces.repartition("g").sortWithinPartitions("g", "h", "at").select("g", "ids").mapInArrow(run, kinds)
    rows = sums.groupBy("i").applyInArrow(add, kinds).collect()  # the weights, once
    if not rows:
        return []
    w = np.concatenate([np.frombuffer(r["w"], np.int64) for r in sorted(rows)]).astype(float)
    return np.split(w / rows[0]["n"] / (1 << 24), np.cumsum([v.size for v in net.w.values()])[:-1])


def _fit_attention(pieces: DataFrame, m: WordModel) -> Attention | None:
    groups = max(1, -(-m.places // GROUP))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("h", "at"), F.lit(groups)))
    pieces = written(pieces)
    first = sorted(pieces.where("g = 0").groupBy("h", "at").agg(F.first("ids").alias("ids"), F.count("*").alias("n")).collect())  # equal rows once, with their number
    net, batch, speed = m.network(), m.batch, m.batch / 64
    net.start_from(m.share)
    if first:
        ids = [_ids_of_piece(r["ids"], net.size) for r in first]
        x, y, valid = net.blocks(ids)
        valid *= np.repeat([r["n"] for r in first], [-(-(len(x) - 1) // net.length) for x in ids])[:, None].astype(np.float32)
        net.train(x, y, valid, passes=max(1, -(-LEAST_STEPS * 64 // len(x))), batch=batch, rate=0.01 * speed, least=0.0 if groups == 1 else ROUNDS[0][0] * speed)
    elif groups == 1:
        return None
    for k, (rate, least) in enumerate(ROUNDS):
        if groups > 1 + k:
            new = _trained_copies(pieces.where((F.col("g") > 0) & (F.col("g") % len(ROUNDS) == (k + 1) % len(ROUNDS))), net, rate * speed, least * speed, batch)
            if new:
                net.w = {name: v.reshape(net.w[name].shape).astype(np.float32) for name, v in zip(net.w, new, strict=True)}
    return net


def score_texts(docs: DataFrame, model: WordModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, logarithms to base 10.

    NULL counts as empty; an empty text has its end alone; repeated rows give repeated results. Words that aren't
    sent to every executor are joined to the counts; the words so sent are those that would make that join skewed.
    """
    if isinstance(model, SubwordModel):
        return score_parsed(parse_texts(docs, model, id_col, text_col), model, counts, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def factory():
        m = shared.value
        return lambda ids, keys, texts: (ids, keys, *m.score(texts))

    schema = [("_id", kind), ("_key", "bigint"), ("n", "bigint"), ("known", "bigint"), ("sums", "double"), ("gain", "double"), ("rare", "array<binary>")]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = written(map_texts(docs, [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_t")], 2, factory, schema, most_bytes=2 << 20))
    return _summed(rows, rows, model, counts, id_col)


def score_parsed(parsed: DataFrame, model: SubwordModel, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What score_texts gives, of parsed texts."""
    shared = parsed.sparkSession.sparkContext.broadcast(model.for_scoring())
    kind = dict(parsed.dtypes)["_id"]

    def factory():
        m = shared.value
        return lambda ids, keys, n, known, sums, own: (ids, keys, n, known, sums, m.totals([unpacked(x, m.size) for x in own]).tolist())

    schema = [("_id", kind), ("_key", "bigint"), ("n", "bigint"), ("known", "bigint"), ("sums", "double"), ("gain", "double")]
    rows = map_texts(parsed, [F.col(c) for c in ("_id", "_key", "n", "known", "sums", "ids")], 5, factory, schema, most_bytes=2 << 20)
    return _summed(rows, parsed, model, counts, id_col)


def _summed(rows: DataFrame, parsed: DataFrame, model: WordModel, counts: DataFrame, id_col: str) -> DataFrame:
    """The result rows; rare: words of parsed that are joined to the counts."""
    rare = parsed.select("_id", "_key", F.explode("rare").alias("w")).join(counts, "w").select("_id", "_key", F.log10(F.col("c") + 1).alias("s"))
    none = lambda kind: F.lit(None).cast(kind)
    every = rows.select("_id", "_key", "n", "known", "sums", "gain", none("double").alias("s")).unionByName(rare.select("_id", "_key", none("bigint").alias("n"), none("bigint").alias("known"), none("double").alias("sums"), none("double").alias("gain"), "s"))
    out = every.groupBy("_id", "_key").agg(F.count("n").alias("rows"), F.max("n").alias("n"), F.max("known").alias("known"), F.max("sums").alias("sums"), F.max("gain").alias("gain"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.count("s").alias("found"))
    out = out.withColumns({"s": F.col("sums") + F.col("s") / F.col("rows"), "known": F.col("known") + (F.col("found") / F.col("rows")).cast("long")})
    out = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_copy"))
    score = F.col("gain") if isinstance(model, SubwordModel) else F.col("s") + F.col("gain")
    base = F.col("s") - F.col("n") * float(np.log10(model.tokens + model.distinct + 1))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(crc_remainder(F.col("doc_id"), 7) != 2, F.lit(False))
    model, counts = number_subwords(docs, learn, public_tokenizers.path("byte_bpe_50k.json"))
    parsed = parse_texts(docs, model, learn=learn)
    train_subwords(parsed, model)
    out = score_parsed(parsed, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
