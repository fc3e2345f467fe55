"""Byte-pair encoding and decoding with a lexicon of frequent words.

The pieces of the corpus's frequent words are encoded once and compiled into a minimal acyclic automaton whose common suffixes are
shared. Every arc carries the number of words that sort before those it leads to, so that the sum along a path is the
number of the word, which its ids are kept under. The automaton is a file that Spark hands to the executors and that
each task maps into memory. Other pieces are merged exactly, many at a time, with the ranks of the vocabulary file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, most_frequent, shared_file, table, written

#: Frequent words whose pieces are in the lexicon, at most; every other piece is merged exactly.
LEXICON = 60_000
#: Pieces whose ids a worker remembers at a time.
MEMO = 250_000
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _piece_pattern(letter: str, number: str) -> str:
    return rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


PIECES = regex.compile(_piece_pattern(r"\p{L}", r"\p{N}"))
#: Letters and numbers below U+0250, where the standard library's search, which is faster, can be given them one by one.
LATIN_PIECES = re.compile(_piece_pattern(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"))
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")


def pieces_of(text: str) -> list[str]:
    """The pieces that a text without special strings is encoded in, each for itself."""
    return (PIECES if BEYOND_LATIN.search(text) else LATIN_PIECES).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file (tokenizers .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        letters = _byte_letters()
        ids = j["model"]["vocab"]
        size = max([*ids.values(), *(a["id"] for a in j["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
        pairs = np.array([(ids[a] << 20) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order
        byte = self.of_byte
        self.rank_of_bytes = self._ranks(np.repeat(byte, 256), np.tile(byte, 256)).reshape(256, 256)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[i] == key, self.rank[i], 1 << 40)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. All words are merged at once: each round merges, in every word, its pair of least rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.of_byte[raw]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list = [None] * len(words)
        none = 1 << 40
        ranks = np.full(len(sym), none, np.int64)  # of each symbol and the next
        if len(sym) > 1:
            ranks[:-1] = np.where(word[1:] == word[:-1], self.rank_of_bytes[raw[:-1], raw[1:]], none)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            count = np.diff(np.r_[starts, len(sym)])
            done = least == none
            if done.any():
                for s, n in zip(starts[done].tolist(), count[done].tolist(), strict=True):
                    out[word[s]] = sym[s : s + n]
                keep = np.repeat(~done, count)
                sym, word, ranks = sym[keep], word[keep], ranks[keep]
                least, count = least[~done], count[~done]
                if not len(sym):
                    break
            hit = ranks == np.repeat(least, count)
            at = np.flatnonzero(hit)
            if (overlap := np.diff(at) == 1).any():  # in a run such as aaa, each second pair from the left
                run = np.r_[0, np.cumsum(~overlap)]
                first = np.flatnonzero(np.r_[True, ~overlap])
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            sym[at] = self.merged[ranks[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            new_at = at - np.arange(len(at))  # places after the removal
            sym, word, ranks = sym[stay], word[stay], ranks[stay]
            changed = np.zeros(len(sym), bool)
            changed[new_at] = changed[np.maximum(new_at - 1, 0)] = True
            again = np.flatnonzero(changed)
            nxt = np.minimum(again + 1, len(sym) - 1)
            ranks[again] = np.where((again + 1 < len(sym)) & (word[nxt] == word[again]), self._ranks(sym[again], sym[nxt]), none)
        return [np.empty(0, np.int64) if x is None else x for x in out]

    def pack(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit numbers."""
        found = self.merge([p.encode() for p in pieces])
        ends = np.cumsum([4 * len(x) for x in found]).tolist()
        every = np.concatenate(found).astype("<u4").tobytes() if found else b""
        return [every[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def decode(self, packed: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def build_lexicon(words: list[bytes], outputs: list[bytes]) -> bytes:
    """A minimal acyclic transducer as bytes. words: sorted, none twice; outputs: the packed ids of each.

    States are made bottom-up while the sorted words are read: what the next word can no longer change is looked up
    among the states made before, so that equal suffixes become one state (Daciuk et al., 2000).
    """
    register: dict[tuple, int] = {}
    made: list[tuple[bool, list[tuple[int, int]]]] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(made)
            made.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the states of the last word: [final, arcs that are frozen]
    last = b""
    for w in words:
        common = len(os.path.commonprefix([w, last]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path.extend([False, []] for _ in w[common:])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    below = np.zeros(len(made), np.int64)
    arcs = []
    for s, (final, out) in enumerate(made):  # targets come before their sources
        n = int(final)
        for byte, to in out:
            arcs.append((s << 8 | byte, to, n))
            n += below[to]
        below[s] = n
    arcs.sort()
    table_ = np.array(arcs, np.int64).reshape(-1, 3)
    final = np.array([f for f, _ in made], np.int64)
    ends = np.cumsum([0, *map(len, outputs)], dtype=np.int64)
    head = np.array([root, len(made), len(arcs), len(words)], np.int64)
    return b"".join([head.tobytes(), final.tobytes(), *(np.ascontiguousarray(table_[:, k]).tobytes() for k in range(3)), ends.tobytes(), *outputs])


class Lexicon:
    """The transducer in a file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r", shape=(os.path.getsize(path) // 8,)).view(np.ndarray)
        self.root, states, arcs, words = (int(x) for x in data[:4])
        at = np.cumsum([4, states, arcs, arcs, arcs, words + 1])
        self.final, self.key, self.to, self.before, self.ends = (data[a:z] for a, z in zip(at, at[1:], strict=False))
        self.ids = np.memmap(path, np.uint8, "r", offset=int(at[-1]) * 8, shape=(int(self.ends[-1]),)) if words and self.ends[-1] else np.empty(0, np.uint8)

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The packed ids of each word, None for those that the lexicon doesn't hold. All words advance together."""
        n = len(words)
        out: list[bytes | None] = [None] * n
        if not n or not len(self.key):
            return out
        ids = memoryview(self.ids)
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        live, state, number = np.arange(n), np.full(n, self.root), np.zeros(n, np.int64)
        for step in range(int(sizes.max()) + 1):
            ended = sizes[live] == step
            hit = ended & (self.final[state] == 1)
            k = number[hit]
            for i, a, z in zip(live[hit].tolist(), self.ends[k].tolist(), self.ends[k + 1].tolist(), strict=True):
                out[i] = ids[a:z].tobytes()
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            key = state << 8 | text[begins[live] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            live, arc = live[ok], arc[ok]
            state, number = self.to[arc], number[ok] + self.before[arc]
        return out


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON) -> list[tuple[str, int]]:
    """The most frequent words of the whole corpus, at most `most`, with their counts; words are counted before the shuffle."""
    words = docs.select(F.explode(F.split(F.translate(F.col(text_col), "\n", " "), " ")).alias("w")).where("w <> ''")
    return most_frequent(written(words.groupBy("w").agg(F.count("*").alias("c")).where("c > 1")), most)


#: Files that an application's executors can get already; a name is that of its content.
_HANDED_OUT: set[tuple[str, str]] = set()


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON) -> str:
    """Builds the lexicon of the pieces of docs' frequent words and hands the file to the executors; returns its name there."""
    v = vocabulary(path)
    words = [" " + w for w, _ in frequent_words(docs, text_col, most) if not any(s in w for s in v.special)]
    pieces = sorted({p for w in words for p in pieces_of(w)}, key=str.encode)
    data = build_lexicon([p.encode() for p in pieces], v.pack(pieces))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sc = docs.sparkSession.sparkContext
    if (sc.applicationId, name) not in _HANDED_OUT:
        sc.addFile(shared_file(docs.sparkSession, name, data))  # executors that come late get it, too
        _HANDED_OUT.add((sc.applicationId, name))
    return name


class Encoder:
    """Encodes texts piece by piece: pieces that it remembers, then the lexicon, then exact merges."""

    def __init__(self, path: str, lexicon: str | None, memo: int = MEMO):
        self.v = vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.most = memo
        self.memo: dict[str, bytes] = {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.v.special.items()}

    def _learn(self, wanted: set[str]) -> None:
        """Makes the memo hold all wanted pieces."""
        new = list(wanted.difference(self.memo))
        if len(self.memo) + len(new) > self.most:
            self.memo = {}
            new = list(wanted)
        known = self.lexicon.look_up([p.encode() for p in new]) if self.lexicon else [None] * len(new)
        self.memo.update((p, k) for p, k in zip(new, known, strict=True) if k is not None)
        unseen = [p for p, k in zip(new, known, strict=True) if k is None]
        for i in range(0, len(unseen), 16384):
            self.memo.update(zip(unseen[i : i + 16384], self.v.pack(unseen[i : i + 16384]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        v = self.v
        parts = [v.split_special.split(t) if t and v.split_special and any(s in t for s in v.special) else [t or ""] for t in texts]
        pieces = [[[p] if i % 2 else pieces_of(p) for i, p in enumerate(x)] for x in parts]  # special strings stand at odd places
        self._learn(set().union(*(y for x in pieces for y in x[::2])))
        get = self.memo.__getitem__
        return [b"".join([self.special[y[0]] if i % 2 else b"".join(map(get, y)) for i, y in enumerate(x)]) for x in pieces]


@lru_cache(maxsize=2)
def encoder(path: str, lexicon: str) -> Encoder:
    """The worker's encoder, which later tasks use again."""
    return Encoder(path, lexicon)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """(id, ids, decoded) for each row of docs: the ids, packed as little-endian unsigned 32-bit numbers, and their text.

    NULL is encoded as an empty text, which has no ids and decodes to an empty text. Special strings inside a text
    become their ids. Repeated rows give repeated results; an empty table gives an empty result; other columns aren't
    looked at. A very long text is held whole, its ids and its decoded text beside it. path: a vocabulary file that exists on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    name = compile_lexicon(docs, path, text_col, lexicon)

    def factory():
        e = encoder(path, SparkFiles.get(name))

        def work(ids, texts):
            packed = e.encode(texts)
            return ids, packed, [e.v.decode(x) for x in packed]

        return work

    out = map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")], 1, factory, [("_id", kind), ("ids", "binary"), ("decoded", "string")], most_bytes=1 << 20)
    return out.withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, of what encode() gives; edge cases are its own."""
    out = encode(docs, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
