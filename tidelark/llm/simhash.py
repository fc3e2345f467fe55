"""SimHash near-duplicates: fingerprints, links within a few bits by pigeonring filtering, and their components.

A fingerprint of 64 bits is a ring of bits + 1 segments. If two fingerprints differ in at most `bits` bits, some
segment starts a chain whose differences stay within their share of the budget after every step: none in the first
segment, one at most after the second, and so on. So a pair meets in a block keyed by a whole segment and one half
of the next (a half of it is equal, too), and within the block the rest of the chain is checked before all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, table
from .components import connected_components

BITS = 3
#: Fingerprints of a block that one task compares at a time; larger blocks are dealt into tiles of about this size.
TILE = 512


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of lower-cased words; fewer words make one shingle, none make none."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number; NULL and wordless texts have 0."""
    kind = dict(docs.dtypes)[id_col]

    def factory():
        return lambda ids, texts: (ids, np.array([simhash(shingle_hashes(t, words)) for t in texts], np.uint64).astype(np.int64))

    return map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")], 1, factory, [("_id", kind), ("fp", "bigint")])


def _edges_of_ring(bits: int) -> list[int]:
    return [round(64 * i / (bits + 1)) for i in range(bits + 2)]


def _masks(bits: int) -> list[np.uint64]:
    at = _edges_of_ring(bits)
    return [np.uint64(sum(1 << b for b in range(a, z))) for a, z in zip(at, at[1:], strict=False)]


def block_keys(fp, bits: int = BITS):
    """Array of the keys under which a fingerprint meets those within `bits` bits: 2 * (bits + 1) numbers."""
    at, m = _edges_of_ring(bits), bits + 1
    cut = lambda a, z: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1))
    keys = []
    for i in range(m):
        j = (i + 1) % m
        mid = (at[j] + at[j + 1]) // 2
        for half, (a, z) in enumerate(((at[j], mid), (mid, at[j + 1]))):
            tag = F.lit(2 * i + half)
            keys.append(F.shiftleft(F.shiftleft(cut(at[i], at[i + 1]), z - a).bitwiseOR(cut(a, z)), 6).bitwiseOR(tag.cast("long")))
    return F.array(*keys)


def close_pairs(x: np.ndarray, y: np.ndarray, ring: int, masks: list[np.uint64], bits: int) -> np.ndarray:
    """Which x and y differ in at most `bits` bits, in the order of the chain that begins at segment `ring`.

    x, y: unsigned arrays that broadcast together. A pair that fails the chain here, but not everywhere, is found in
    the block of another segment.
    """
    diff, m = x ^ y, bits + 1
    total = np.zeros(diff.shape, np.uint8)
    ok = np.ones(diff.shape, bool)
    for step in range(m):
        total += np.bitwise_count(diff & masks[(ring + step) % m])
        ok &= total <= (step + 1) * bits // m
    return ok


def _forest(fp: np.ndarray, ring: int, masks: list[np.uint64], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within one tile connect: at most one a fingerprint."""
    left, us, vs = np.arange(len(fp)), [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            ok = close_pairs(fp[frontier][:, None], fp[left][None, :], ring, masks, bits)
            hit = ok.any(0)
            us.append(fp[frontier[ok[:, hit].argmax(0)]])
            vs.append(fp[left[hit]])
            frontier, left = left[hit], left[~hit]
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _links_in(group: np.ndarray, ring: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by group. Small groups are compared row by row at a distance, all groups at once."""
    masks, us, vs = _masks(bits), [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= 16, sizes)
    for d in range(1, min(16, len(fp))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        if not len(i):
            break
        for r in range(bits + 1):
            k = i[ring[i] == r]
            k = k[close_pairs(fp[k], fp[k + d], r, masks, bits)]
            us.append(fp[k])
            vs.append(fp[k + d])
    for a, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        u, v = _forest(fp[a : a + n], int(ring[a]), masks, bits)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def near_links(distinct: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between different fingerprints (column fp, no row twice) of at most `bits` different bits.

    They connect whatever the full set of links connects; within a block no more than 15 links a fingerprint are
    given. A block of more than `tile` fingerprints is dealt into tiles and every pair of tiles is a group of its own,
    so that no group outgrows a task, and none is cut.
    """
    rows = distinct.select("fp", F.explode(block_keys(F.col("fp"), bits)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.select("key", "fp", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    rows = rows.select("key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush(cols):
            key, a, b, fp = cols
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            u, v = _links_in(group, (key & 63) >> 1, fp.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            key, a, b, _ = cols
            same = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            begin = len(key) - int(same[::-1].argmin()) if not same.all() else 0
            if begin:
                yield flush([c[:begin] for c in cols])
            kept = [c[begin:] for c in cols]
        if kept and len(kept[0]):
            yield flush(kept)

    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(id, fp, component): one row for each row of docs; component is the least id that links lead to, itself included.

    Equal fingerprints are one node, so that copies cost no links. NULL and wordless texts have fingerprint 0 and link
    like any other; a row whose id is NULL belongs to its component but can't name it. Repeated rows stay. An empty
    table gives an empty result. Other columns of docs are not looked at.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("_id").alias("least"))
    labels = connected_components(near_links(nodes.select("fp"), bits, tile))
    nodes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component"))
    named = nodes.join(least, "label").select("fp", "component")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs without the near copies: of each component the row with the least id stays, whole and with all its columns.

    Of rows that share this id (repeated rows) one stays, the first by the hash of its text and, in ties, by the other
    columns as JSON. A row whose id is NULL can't be told from its copies and stays. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, bits)
    keep = found.where(F.col(id_col) == F.col("component")).select(F.col(id_col).alias("_keep")).distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_keep"))
    others = F.to_json(F.struct(*(F.col(f"_row.`{c}`") for c in docs.columns if c != text_col)))
    first = Window.partitionBy("_keep").orderBy(F.xxhash64(F.col(f"_row.`{text_col}`")), others, F.col(f"_row.`{text_col}`"))
    named = packed.join(keep, "_keep").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return named.select("_row.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
