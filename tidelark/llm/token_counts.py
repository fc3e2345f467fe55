"""Token counts of documents of any length, by a public tokenizer, with overlap resynchronisation.

A text is encoded in overlapping chunks that are cut anywhere. Two neighbours are spliced at a boundary that is proven
stable and that both encodings begin a token at, the next tokens being the same, with their offsets. If an overlap has
no such boundary, it is widened, in the end to all that follows the last splice, which is then encoded again at double
the length, so that the time stays linear. Within a chunk, words between white space are counted once and remembered.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache
from itertools import accumulate
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

CHUNK = 8192
OVERLAP = 256
LIMIT = 2048
#: Words whose token counts a worker remembers at a time, and the longest of them.
MEMO, LONGEST = 300_000, 64
SPACE = " \t\n\r"
#: What the pieces of plain Latin words, in lower case, are: no character of these is changed by its neighbours.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[!-/:-`{-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+| ")
NOT_PLAIN = r"[^!-~\xa1-\xac\xae-\u012f\u0131-\u017f]"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=65536)
def _class(c: str) -> str:
    """S, L, N or O: white space, letter, number, other; empty for a character that a neighbour or a newer Unicode can change."""
    if c in SPACE:
        return "S"
    kind = unicodedata.ucd_3_2_0.category(c)
    if kind[0] in "MCZ" and not c.isascii() or len(c.lower()) > 1 or 0x1100 <= ord(c) < 0x1200 or unicodedata.normalize("NFC", c) != c:
        return ""
    return kind[0] if kind[0] in "LN" else "O"


def stable(text: str, p: int) -> bool:
    """Whether the tokens from p on can't depend on the text before p.

    Pieces end where the class of characters changes and at every digit, but for what an apostrophe begins; marks and
    jamos, which join the character before them, and characters that change with their case or form are left out.
    """
    left, right = _class(text[p - 1]), _class(text[p])
    return bool(left and right) and right != "S" and text[p - 1] != "'" and (left != right or left == "N")


class _Chunk:
    """A stretch of a text, its words, and how many tokens each has."""

    def __init__(self, counter: Counter, text: str, begin: int, end: int):
        self.counter, self.begin, self.end = counter, begin, end
        self.words = words_of(text[begin:end])
        self.until = list(accumulate(counter.of(self.words), initial=0))

    @cached_property
    def at(self) -> list[int]:
        """Where the words start, and where one after them would."""
        return [*map(add, accumulate(map(len, self.words), initial=self.begin), range(len(self.words) + 1))]

    def tokens(self, low: int, high: int) -> tuple[list[int], list[int]]:
        """Where the tokens of the words that reach into [low, high) start, and their ids."""
        inside = [k for k in range(bisect_right(self.at, low) - 1, min(bisect_left(self.at, high), len(self.words))) if self.words[k]]
        coded = self.counter.t.encode_batch([self.words[k] for k in inside], add_special_tokens=False)
        return [self.at[k] + a for k, e in zip(inside, coded, strict=True) for a, _ in e.offsets], [i for e in coded for i in e.ids]

    def before(self, p: int) -> int:
        """How many tokens start before p."""
        k = bisect_right(self.at, p) - 1
        if k == len(self.words) or self.at[k] == p:
            return self.until[k]
        return self.until[k] + sum(self.at[k] + a < p for a, _ in self.counter.t.encode(self.words[k], add_special_tokens=False).offsets)


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Counter:
    """Counts the tokens of texts; words between white space are counted once."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.t, self.chunk, self.overlap = tokenizer(path), chunk, overlap
        self.memo, self.pieces = {"": 0}, {}
        special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.longest_special = max([1, *map(len, special)])
        self.not_plain = re.compile("|".join([NOT_PLAIN, *map(re.escape, special)])).search

    def _encoded(self, memo: dict[str, int], texts: list[str]) -> None:
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            memo.update(zip(part, map(len, self.t.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def learn(self, words: set[str]) -> None:
        """Makes the memo hold the words. Plain Latin ones are the sums of their pieces, which many words share."""
        new = [w for w in words.difference(self.memo) if len(w) <= LONGEST]
        if len(self.memo) + len(new) > MEMO:
            self.memo = {"": 0}
            new = [w for w in words if w and len(w) <= LONGEST]
        latin = [w for w in new if not self.not_plain(w)]
        self._encoded(self.memo, [w for w in new if self.not_plain(w)])
        split: list[list[str]] = [[]]
        for p in PLAIN_PIECES.findall(" ".join(latin).lower()):
            if p == " ":
                split.append([])
            else:
                split[-1].append(p)
        wanted = {p for x in split for p in x}
        if len(self.pieces) + len(wanted) > MEMO:
            self.pieces = {}
        self._encoded(self.pieces, list(wanted.difference(self.pieces)))
        get = self.pieces.__getitem__
        self.memo.update((w, sum(map(get, x))) for w, x in zip(latin, split, strict=False))

    def of(self, words: list[str]) -> list[int]:
        """The number of tokens of each word."""
        n = list(map(self.memo.get, words))
        missing = [i for i, x in enumerate(n) if x is None]  # long words, and those of chunks that were made wider
        for i, e in zip(missing, self.t.encode_batch_fast([words[i] for i in missing], add_special_tokens=False) if missing else (), strict=True):
            n[i] = len(e)
        return n

    def splice(self, text: str, left: _Chunk, right: _Chunk, run: int = 3) -> int | None:
        """A stable boundary in the overlap that both encodings have, with `run` equal tokens after it (or all to the end of the left one).

        Special strings may stand at either end, cut; boundaries as near to it as the longest of them aren't taken.
        """
        low, high = right.begin, left.end
        (starts, ids), (others, other_ids) = left.tokens(low, high), right.tokens(low, high)
        at = {p: k for k, p in reversed(list(enumerate(starts)))}
        for k, p in enumerate(others):
            if p in at and low + self.longest_special <= p <= high - self.longest_special and stable(text, p):
                i = at[p]
                n = min(run, len(starts) - i - 1, len(others) - k)  # the last token of the left may be cut
                if n > 0 and starts[i : i + n] == others[k : k + n] and ids[i : i + n] == other_ids[k : k + n]:
                    return p
        return None

    def count(self, text: str) -> int:
        """The number of tokens of text, of which no more than about a chunk is encoded at a time where it has boundaries."""
        total, floor, n = 0, 0, len(text)
        left = _Chunk(self, text, 0, min(self.chunk, n))
        while left.end < n:
            wide = self.overlap
            while True:
                start = left.end - wide
                if start <= floor:  # no boundary since the last splice: encode from there on, twice as far
                    left = _Chunk(self, text, floor, min(n, left.end + max(self.chunk, left.end - floor)))
                    break
                right = _Chunk(self, text, start, min(n, left.end + self.chunk))
                p = self.splice(text, left, right)
                if p is not None:
                    total += left.before(p) - left.before(floor)
                    floor, left = p, right
                    break
                wide *= 2
        return total + left.until[-1] - (left.before(floor) if floor > left.begin else 0)

    def counts(self, texts: list[str | None]) -> list[int]:
        self.learn({w for t in texts if t for a in range(0, len(t), self.chunk) for w in words_of(t[max(0, a - self.overlap) : a + self.chunk])})
        return [sum(self.of(words_of(t))) if t and len(t) <= self.chunk else self.count(t) if t else 0 for t in texts]


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """The worker's counter, which later tasks use again."""
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs, without begin, end or added special tokens.

    path: a tokenizers .json file that exists on every executor, whose pieces are runs of letters, single numbers and
    runs of others, as stable() says. NULL counts as empty, an empty text has no tokens, repeated rows give repeated
    results, an empty table an empty one; other columns aren't looked at. Very long texts take linear time.
    """
    kind = dict(docs.dtypes)[id_col]

    def factory():
        c = counter(path, chunk, overlap)

        def work(ids, texts, n_bytes):
            n = c.counts(texts)
            return ids, n_bytes, n, [x > limit for x in n]

        return work

    columns = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes")]
    out = map_texts(docs, columns, 1, factory, [("_id", kind), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], most_bytes=4 << 20)
    return out.withColumnRenamed("_id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
