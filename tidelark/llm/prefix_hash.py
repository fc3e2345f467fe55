"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, at i, the sum of c[j] * B**j over j < i, modulo two primes. Differences of it,
brought to place 0 by an inverse power, are the hashes of any span, so that spans compare in constant time and the
longest common extension of two places is a binary search. A fingerprint holds the hash of the whole text and the
least mixed hashes of all its spans of a fixed length, whose overlap estimates how much two texts share.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW, table

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
KEEP = 48
#: Rows of a range of ids, about; a task sorts and reads one range.
ROWS = 100_000


class _Powers:
    """Powers of the bases and of their inverses, made as long as the longest text so far."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        for row, bases in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])):
            for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
                while len(row[k]) < n:
                    row[k] = np.concatenate([row[k], row[k] * np.uint64(pow(b, len(row[k]), p)) % np.uint64(p)])


POWERS = _Powers()


class PrefixHash:
    """The prefix arrays of a text, or of code points."""

    def __init__(self, text: str | np.ndarray):
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32) if isinstance(text, str) else text
        self.points, self.n = c, len(c)
        POWERS.reach(self.n + 1)
        c = c.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up, p in zip(POWERS.up, PRIMES, strict=True):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * up[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def spans(self, length: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """A 62-bit hash of each span of `length` code points that starts in [begin, end)."""
        end = self.n - length + 1 if end is None else end
        if end <= begin:
            return np.empty(0, np.uint64)
        h = []
        for s, down, p in zip(self.sums, POWERS.down, PRIMES, strict=True):
            p = np.uint64(p)
            h.append((s[begin + length : end + length] + p - s[begin:end]) % p * down[begin:end] % p)
        return h[0] << np.uint64(31) | h[1]

    def span(self, i: int, j: int) -> int:
        """The hash of the code points from i to j, the same wherever they stand."""
        h = [(int(s[j]) - int(s[i])) % p * int(d[i]) % p for s, d, p in zip(self.sums, POWERS.down, PRIMES, strict=True)]
        return h[0] << 31 | h[1]

    def whole(self) -> int:
        return self.span(0, self.n)


def longest_common_extension(a: PrefixHash, b: PrefixHash, i: int = 0, j: int = 0) -> int:
    """How many code points from i in a and from j in b are the same."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def span_length(n: int) -> int:
    return SPAN if n >= 2 * SPAN else max(1, n // 4)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def least(mixed: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The `keep` least distinct values, sorted."""
    if len(mixed) > 8 * keep:
        part = np.unique(np.partition(mixed, 4 * keep)[: 4 * keep])
        if len(part) >= keep:
            return part[:keep]
    return np.unique(mixed)[:keep]


class Fingerprint:
    def __init__(self, n: int, whole: int, values: np.ndarray):
        self.n, self.whole, self.values = n, whole, values

    def __str__(self) -> str:
        return f"{self.n:x}:{self.whole:016x}:{self.values.astype('>u4').tobytes().hex()}"

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        n, whole, values = s.split(":")
        return cls(int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(values), ">u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """About the share of one text's spans that the other has (Dice), from 0 to 1; 1 for equal texts, two empty ones too."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        union = np.union1d(self.values, other.values)[:KEEP]
        if not len(union):
            return 0.0
        j = float((np.isin(union, self.values) & np.isin(union, other.values)).mean())
        return 2 * j / (1 + j)


def fingerprint(p: PrefixHash, known: np.ndarray | None = None, same: int = 0) -> tuple[Fingerprint, np.ndarray]:
    """The fingerprint of a text, and the mixed hashes of its spans.

    known: the mixed hashes of a text whose first `same` code points are the same and whose spans are as long; the
    spans within them aren't hashed again.
    """
    w = span_length(p.n)
    reuse = max(0, same - w + 1) if known is not None else 0
    mixed = _mix(p.spans(w, reuse)) if p.n else np.empty(0, np.uint32)
    if reuse:
        mixed = np.concatenate([known[:reuse], mixed])
    return Fingerprint(p.n, p.whole(), least(mixed)), mixed


class _Document:
    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.prefix = PrefixHash(text)
        self.print, self.mixed = fingerprint(self.prefix)


def _compare(a: _Document, b: _Document) -> tuple:
    """The result row of document a, whose next document is b."""
    n = a.prefix.n
    k = n // 4
    edited = a.text[: n - k] + b.text[:k]
    p = PrefixHash(np.concatenate([a.prefix.points[: n - k], b.prefix.points[:k]]))
    reuse = span_length(p.n) == span_length(n)
    fp, _ = fingerprint(p, a.mixed if reuse else None, n - k)
    return a.key, n, hashlib.sha256(edited.encode()).hexdigest(), str(a.print), str(fp), a.print.likeness(fp), a.print.likeness(b.print), longest_common_extension(a.prefix, p), longest_common_extension(a.prefix, b.prefix)


def _literal(values: list, kind: str):
    """The values, NULLs among them, as one constant array, however many they are."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast(f"array<{kind}>")


def _range_of(bounds: list[int], nulls: int, at, share):
    """The number of a row's range. bounds: sorted, an id that fills several ranges several times; its rows are dealt to these by share, which is in [0, 1), and NULL ids to the first `nulls` ranges."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    times = Counter(bounds) if len(set(bounds)) < len(bounds) else {}
    known, many = _literal(bounds, "bigint"), _literal([times.get(b, 1) for b in bounds], "bigint")
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(known, a + s - 1) <= at, a + s).otherwise(a)) if bounds else F.lit(0)  # a binary search
    number = below
    if times:
        own = F.when(F.get(known, below - 1) == at, F.get(many, below - 1)).otherwise(1)
        number = (below - own + 1 + F.floor(share * own)).cast("int")
    return F.when(at.isNull(), F.floor(share * max(1, nulls)).cast("int")).otherwise(number + nulls)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """Each row's fingerprint, and that of the text whose last quarter is replaced by the beginning of the next row's text.

    Rows are ordered by their integer id (NULL first), then by the hash of their text; after the last comes the first.
    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lce_edited, lce_next): the last
    two are the common prefixes with the edited and with the next text. NULL counts as empty; an empty text has likeness
    1 to an empty one and 0 to others; repeated rows follow each other; an empty table gives an empty result; a very
    long text is held whole with its prefix arrays; an id that isn't an integer raises TypeError.

    Ids are dealt into ranges of about `rows` rows that are sorted apart, each text moving once. An id that fills several
    ranges, or NULL, is split by the hash of the text. The row that follows a range's last one is the first of the next
    range and is sent to both.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), F.shiftrightunsigned(F.xxhash64(text), 11).alias("_h"))
    size = d.agg(F.count("*").alias("n"), F.count("_id").alias("known")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // rows))
    nulls = -(-ranges * (size["n"] - size["known"]) // max(1, size["n"]))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(int(x) for x in d.where("_id IS NOT NULL").approxQuantile("_id", cuts, max(1e-6, 0.25 / ranges))) if cuts and size["known"] else []
    d = d.withColumn("_r", _range_of(bounds, nulls, F.col("_id"), F.col("_h") / float(1 << 53)))
    first = d.groupBy("_r").agg(F.min(F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_h")).alias("least")).orderBy("_r").collect()  # a row a range
    total = len(bounds) + 1 + nulls
    least, before, last = [None] * total, [None] * total, first[-1]["_r"] if first else 0
    for r in first:
        least[r["_r"]], before[r["_r"]], last = (r["least"]["_id"], r["least"]["_h"]), last, r["_r"]  # the first range follows the last
    mine = F.col("_id").eqNullSafe(F.get(_literal([x and x[0] for x in least], "bigint"), F.col("_r"))) & (F.col("_h") == F.get(_literal([x and x[1] for x in least], "bigint"), F.col("_r")))
    own, lent = F.struct(F.col("_r").alias("r"), F.lit(0).alias("lent")), F.struct(F.get(_literal(before, "int"), F.col("_r")).alias("r"), F.lit(1).alias("lent"))
    d = d.select("_id", "_text", "_h", F.explode(F.when(F.coalesce(mine, F.lit(False)), F.array(own, lent)).otherwise(F.array(own))).alias("_to")).select("_to.r", "_to.lent", F.col("_id").cast(kind).alias("_id"), "_text", "_h")
    d = d.repartitionById(total, F.col("r")).sortWithinPartitions("r", "lent", F.col("_id").asc_nulls_first(), "_h", "_text").drop("_h")
    names = [("_id", kind), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("lce_edited", "bigint"), ("lce_next", "bigint")]
    schema = pa.schema([(n, ARROW[k]) for n, k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        waiting, at = None, None  # the last own row, and its range; None once it has met a lent row

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                r, borrowed, key, text = (c[i].as_py() for c in batch.columns)
                if waiting is None or r != at:
                    if borrowed:
                        continue  # a further row with the id of the lent one
                    waiting, at = _Document(key, text), r
                    continue
                nxt = _Document(key, text)
                rows.append(_compare(waiting, nxt))
                waiting = None if borrowed else nxt
                if len(rows) >= 256:
                    yield out()
        if rows:
            yield out()

    return d.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in names)).withColumnRenamed("_id", id_col)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
