"""Benchmark decontamination with DataFrame functions alone.

The normalised benchmark windows form a hash set whose size is checked: up to MOST_WINDOWS it goes to every
executor as a literal set, which each document's windows are looked up in while the document is scanned; beyond that
the hashes of the documents' windows are joined to those of the benchmark, and the few that meet are looked at again.
Either way a hit is verified by comparing the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, table

WINDOW = 10
#: Words that are looked up first; few windows of the documents have such a start in common with the benchmark.
HEAD = 3
#: Distinct benchmark windows that are sent to every executor: at about 100 bytes each, some 5 MB.
MOST_WINDOWS = 50_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; a text of ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_words(text: Column) -> Column:
    """The words of a text; a NULL text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def benchmark_windows(bench: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, win, hash, head, items): each distinct window with the sorted ids, as strings, of the items that hold it.

    An item of fewer than window words, but not none, is one window. Items without words have no window.
    """
    b = settled(bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("_text")), "w", normal_words(F.col("_text")))
    b = b.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    b = b.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    b = b.select("item", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("win"), F.xxhash64(F.slice("w", F.col("at"), F.col("len"))).alias("hash"), F.xxhash64(F.slice("w", F.col("at"), F.least(F.col("len"), F.lit(HEAD)))).alias("head"))
    return b.groupBy("len", "win", "hash", "head").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _starts(length: int) -> Column:
    return F.when(F.col("n_words") >= length, F.sequence(F.lit(1), F.col("n_words") - length + 1)).otherwise(F.array().cast("array<int>"))


def _covered(hits: Column) -> Column:
    """Words inside any of the hits, which are structs (pos, len, ..) sorted by pos."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(a["end"], h["pos"]))).alias("n"), F.greatest(a["end"], h["pos"] + h["len"]).alias("end")),
        lambda a: a["n"],
    )


def _read_set(windows: DataFrame, most: int) -> tuple[list[int], list | None]:
    """The distinct lengths, and the windows themselves if there are at most `most` of them."""
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most WINDOW values
    rows = windows.select("len", "win", "hash", "head").limit(most + 1).collect()
    return lengths, (rows if len(rows) <= most else None)


def _at(i: Column, length: int) -> list[Column]:
    """The words from i (from 1) on, one by one: slice() would copy the whole array for each window."""
    return [F.get(F.col("w"), i + (k - 1)) for k in range(length)]


def _hits_of_length(length: int, rows: list) -> Column:
    """The windows of one length whose first words, then hash, are in the sets and, to verify, whose words are.

    Written as SQL text, since thousands of literals are slow to make one by one; a word holds no quote or backslash.
    """
    heads, hashes, texts = (sorted({r[k] for r in rows if r["len"] == length}) for k in ("head", "hash", "win"))
    at = lambda n: ", ".join(f"get(w, i + {k - 1})" for k in range(n))
    starts = f"if(n_words >= {length}, sequence(1, n_words - {length} + 1), cast(array() AS array<int>))"
    close = f"filter({starts}, i -> xxhash64({at(min(HEAD, length))}) IN ({', '.join(f'{h}L' for h in heads)}) AND xxhash64({at(length)}) IN ({', '.join(f'{h}L' for h in hashes)}))"
    spans = f"transform({close}, i -> struct(i - 1 AS pos, {length} AS len, concat_ws(' ', {at(length)}) AS win))"
    quoted = ", ".join(f"'{t}'" for t in texts)
    return F.expr(f"filter({spans}, x -> x.win IN ({quoted}))")


def hits_in_rows(docs: DataFrame, rows: list, text_col: str = "text") -> DataFrame:
    """docs with n_words and hits, array<struct(pos, len, win)> by pos (from 0), found while each row is scanned."""
    d = settled(docs, "w", normal_words(F.col(text_col))).withColumn("n_words", F.size("w"))
    found = [_hits_of_length(n, rows) for n in sorted({r["len"] for r in rows})]
    hits = F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<pos:int,len:int,win:string>>")
    return settled(d, "hits", hits).drop("w")


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, items (sorted strings) and hits, array<struct(pos, len)>.

    A NULL or wordless text has no words and no hits; repeated rows give repeated results; an empty benchmark hits
    nothing. Other columns of docs are not looked at.
    """
    windows = benchmark_windows(bench, window, item_col, item_text_col)
    lengths, rows = _read_set(windows, most_windows)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if rows is not None:
        d = hits_in_rows(d, rows, "_text").withColumn("_key", F.xxhash64("_text"))
        found = d.select("_id", "_key", "n_words", F.transform("hits", lambda h: F.struct(h["pos"], h["len"])).alias("hits"), F.posexplode_outer(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("_at", "win"))
        found = found.withColumn("n_hit", _covered(F.col("hits"))).join(F.broadcast(windows.select("win", "items")), "win", "left")
        out = found.groupBy("_id", "_key", "n_words", "n_hit", "hits").agg(F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    else:
        d = settled(d, "w", normal_words(F.col("_text"))).select("_id", F.xxhash64("_text").alias("_key"), "w", F.size("w").alias("n_words"))
        places = lambda n: F.transform(_starts(n), lambda i: F.struct(i.alias("i"), F.lit(n).alias("len"), F.xxhash64(*_at(i, n)).alias("hash")))
        none = F.array().cast("array<struct<i:int,len:int,hash:bigint>>")
        close = d.select("_id", "_key", F.explode(F.concat(none, *map(places, lengths))).alias("s")).select("_id", "_key", "s.*")
        close = close.join(windows.select("len", "hash").distinct(), ["len", "hash"], "left_semi").groupBy("_key").agg(F.collect_set(F.struct("i", "len")).alias("close"))
        spans = F.transform("close", lambda c: F.struct((c["i"] - 1).alias("pos"), c["len"].alias("len"), F.array_join(F.slice("w", c["i"], c["len"]), " ").alias("win")))
        hit = d.join(close, "_key").select("_id", "_key", F.explode(spans).alias("s")).select("_id", "_key", "s.*").join(windows.select("win", "items"), "win")
        hit = hit.select("_id", "_key", F.struct("pos", "len").alias("s"), "items", F.lit(None).cast("int").alias("n_words"))
        base = d.select("_id", "_key", F.lit(None).cast("struct<pos:int,len:int>").alias("s"), F.lit(None).cast("array<string>").alias("items"), "n_words")
        out = base.unionByName(hit).groupBy("_id", "_key").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("_rows"), F.array_sort(F.collect_set("s")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        out = out.withColumn("n_hit", _covered(F.col("hits")))
    again = F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_copy")
    return out.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "items", "hits", again).drop("_copy")


def remove_contaminated(docs: DataFrame, bench: DataFrame, how: str = "documents", text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs without what they share with the benchmark, with the columns of docs.

    how="documents" drops every row with a hit; how="spans" keeps the row and takes the hit words, with what follows
    each up to the next word, out of its text. A row without hits stays as it is, NULL and empty texts included.
    """
    windows = benchmark_windows(bench, window)
    lengths, rows = _read_set(windows, most_windows)
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))  # names of docs can't clash with ours
    if rows is not None:
        found = hits_in_rows(packed, rows, "_text")
    else:
        hit = find_contamination(docs.select(F.xxhash64(text_col).alias("_k"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct(), bench, "_k", "text", window, most_windows)
        hit = hit.where("n_hit > 0").groupBy("_k").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        found = packed.withColumn("_k", F.xxhash64("_text")).join(hit, "_k", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int>>")))
    if how == "documents":
        return found.where(F.size("hits") == 0).select("_row.*")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    parts = F.regexp_extract_all("_text", F.lit(word + gap), F.lit(0))
    left = F.filter(F.col("_parts"), lambda _, i: ~F.exists("hits", lambda h: (h["pos"] <= i) & (i < h["pos"] + h["len"])))
    found = found.withColumn("_parts", F.when(F.size("hits") > 0, parts))
    cleaned = F.when(F.size("hits") > 0, F.concat(F.regexp_extract("_text", "^" + gap, 0), F.array_join(left, ""))).otherwise(F.col("_text"))
    found = found.withColumn("_clean", cleaned)
    return found.select(*(F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same result in DuckDB: windows of both sides as rows, joined by their words.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, n, i, item FROM dw JOIN bw USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
