"""Merkle manifests of tables: a digest of every row, of every source and of the whole, and the proof that a row is part of it.

The digests of a source's rows, in order, are grouped in runs of FANOUT; each run's digest is the hash of its digests, level
by level until one is left. A level is one window over runs: columns at fixed offsets before and behind a node, masked by its
slot and the length of its run, are its siblings, and the rows of the first children make the nodes of the next level.
Tables shrink by FANOUT from level to level; each is written, so that lost executors cost one level at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, table, written
from .decontaminate import LOWER, UPPER
from .ranks import ranked

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    """SHA-256 of a string, as bytes."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """Digests, as bytes one after the other, as lowercase hexadecimal text."""
    return F.lower(F.hex(digests))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: of each value - if it is NULL, or its length in bytes, a colon and itself."""
    text = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (_g, pos, n, d) with run, left and right, the siblings' digests, and parent on the first child of each run."""
    run, slot = F.floor(F.col("pos") / fanout), F.col("pos") % fanout
    length = F.least(F.lit(fanout), F.col("n") - (F.col("pos") - slot))
    w = Window.partitionBy("_g", "run").orderBy("pos")
    before = [F.when(slot >= k, F.lag("d", k).over(w)) for k in range(fanout - 1, 0, -1)]
    behind = [F.when(slot + k < length, F.lead("d", k).over(w)) for k in range(1, fanout)]
    joined = lambda parts: F.concat(*(F.coalesce(p, F.lit(b"")) for p in parts))
    out = nodes.withColumn("run", run).withColumns({"left": joined(before), "right": joined(behind)})
    return out.withColumn("parent", F.when((slot == 0) & (F.col("n") > 1), digest(text_of(F.concat("d", "right")))))


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, written, and (_g, d, top) of what remains of each group and the level where it does."""
    levels = []
    while True:
        levels.append(written(_level(nodes, fanout)))
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= 1:  # one number
            break
        first = levels[-1].where(F.col("parent").isNotNull())
        nodes = first.select("_g", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("d"))
    ends = [s.where("n = 1").select("_g", "d", F.lit(k).alias("top")) for k, s in enumerate(levels)]
    return levels, reduce(DataFrame.unionByName, ends)


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with what tops (_g, top, path, ..) say of their groups' last nodes, and their own path.

    A path is the array of the siblings (left, right) of a node and of those above it; levels without siblings because
    one node is left are no part of it. Each level is joined to the far smaller one above by run.
    """
    kept = [c for c in tops.columns if c not in ("_g", "top", "path")]
    end = lambda k: tops.where(F.col("top") == k).select("_g", F.lit(0).cast("long").alias("run"), F.col("path").alias("_path"), *kept)
    above = end(len(levels) - 1)
    for k in reversed(range(len(levels))):
        own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))
        nodes = levels[k].join(above, ["_g", "run"]).withColumn("path", F.concat(own, "_path")).drop("_path", "left", "right", "parent")
        if k > 0:
            above = nodes.select("_g", F.col("pos").alias("run"), F.col("path").alias("_path"), *kept).unionByName(end(k - 1))
    return nodes


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, fanout: int = FANOUT) -> DataFrame:
    """rows with leaf, subroot and root, digests as bytes, and path, the siblings (left, right) of each level up to the root.

    Groups are ordered by their values, NULL first; within one, rows ascend by `order`, NULL first, then by their leaf, so
    that repeated rows have a leaf each and the root doesn't depend on where rows lie. A hot group is split over tasks at
    each level. No row gives no result. Columns of rows are carried along; names that begin with _, and those of the
    tree (pos, n, d, run, top), are its own.
    """
    nodes = ranked(rows.withColumn("d", leaf), group, [order, F.col("d")])
    levels, ends = _climb(nodes, fanout)
    groups = ranked(ends.withColumnRenamed("_g", "_of"), F.lit(0), [F.col("_of")])
    top_levels, last = _climb(groups, fanout)
    root = last.select("_g", "top", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("d").alias("root"))
    tops = _descend(top_levels, root).select(F.col("_of").alias("_g"), "top", "path", F.col("d").alias("subroot"), "root")
    return _descend(levels, tops).withColumnRenamed("d", "leaf").drop("_g", "pos", "n", "run")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to, as text."""
    return F.aggregate(path, text_of(leaf), lambda x, s: F.sha2(F.concat(text_of(s["left"]), x, text_of(s["right"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, as text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(text_of(s["left"]), text_of(s["right"]))), "").cast("binary"), 256)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents by source, and whether a text with its A-Z in lower case would be found out in every fifth document."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    values = [F.col(c) for c in COLUMNS]
    other = F.when(crc_remainder(F.col("doc_id"), 5) == 0, leaf_digest([*values[:-1], F.translate("text", UPPER, LOWER)]))
    rows = written(docs.select("doc_id", "source", leaf_digest(values).alias("_leaf"), other.alias("tampered")))  # texts are read once, and move nowhere
    out = manifest(rows, F.col("source"), F.col("doc_id"), F.col("_leaf"))
    out = out.select("doc_id", "leaf", "subroot", text_of(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, source: str, depth: int) -> str:
    """Levels of a source (sid, pos, n, d) of up to FANOUT ** depth nodes a group, and the siblings l, r of each."""
    parts = [f"{name}0 AS (SELECT sid, pos, n, d FROM {source})"]
    for k in range(depth):
        parts.append(f"{name}{k + 1} AS (SELECT sid, run AS pos, m AS n, CASE WHEN one THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY slot)) END AS d FROM (SELECT sid, pos AS slot, pos // 16 AS run, (n + 15) // 16 AS m, n = 1 AS one, d FROM {name}{k}) q GROUP BY sid, run, m, one)")
        side = lambda rows: f"coalesce(string_agg(d, '') OVER (PARTITION BY sid, pos // 16 ORDER BY pos ROWS BETWEEN {rows}), '')"
        parts.append(f"{name}s{k} AS (SELECT sid, pos, n > 1 AS more, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
    return ", ".join(parts)


def _sql_fold(name: str, tree: str, source: str, sid: str, pos: str, depth: int) -> str:
    """The rows of a source (x, sibs, ..) led through a tree's levels: the digest x so far, and the siblings met."""
    parts, last = [], source
    for k in range(depth):
        parts.append(f"{name}{k} AS (SELECT f.* REPLACE (CASE WHEN more THEN sha256(l || x || r) ELSE x END AS x, sibs || l || r AS sibs) FROM {last} f JOIN {tree}s{k} t ON t.sid = f.{sid} AND t.pos = f.{pos} // {FANOUT**k})")
        last = f"{name}{k}"
    return ", ".join(parts)


#: CRC-32 of a number's decimal digits, bit by bit.
SQL_CRC = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
_PART = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = lambda text: f"sha256({' || '.join(_PART(c) for c in (*COLUMNS[:-1], text))})"
LEVELS, TOP_LEVELS = 7, 4

#: The same in DuckDB, for sources of up to FANOUT ** LEVELS rows and up to FANOUT ** TOP_LEVELS sources.
OP11_SQL = f"""
WITH d0 AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, {_LEAF('text')} AS d, CASE WHEN {SQL_CRC.format(x='CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM d0),
{_sql_tree('a', 'leaves', LEVELS)}, subs AS (SELECT 0 AS sid, sid AS pos, count(*) OVER () AS n, d FROM a{LEVELS}), {_sql_tree('b', 'subs', TOP_LEVELS)},
f AS (SELECT doc_id, l.sid, l.pos, l.d AS leaf, coalesce(other, l.d) AS x, '' AS sibs, 0 AS top, s.d AS subroot FROM leaves l JOIN subs s ON s.pos = l.sid),
{_sql_fold('u', 'a', 'f', 'sid', 'pos', LEVELS)}, {_sql_fold('v', 'b', f'u{LEVELS - 1}', 'top', 'sid', TOP_LEVELS)}
SELECT doc_id, leaf, subroot, d AS root, sha256(sibs) AS proof_sha256, x AS folded_root, x = d AS verified FROM v{TOP_LEVELS - 1} JOIN b{TOP_LEVELS} ON true
"""
