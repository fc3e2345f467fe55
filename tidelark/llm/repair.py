"""Cheapest repairs of conversations: turns kept, given another role, deleted or inserted until user and assistant alternate.

The repair of a conversation is a path through its rows and four states (nothing yet, after system, user or assistant). It
is found by depth-first branch-and-bound: an explicit stack of prefixes, lower bounds for what the rows behind a prefix cost at
least, the best whole repair so far (cost, then audit) as incumbent, and for every node (row, state) the best prefix that
reached it, which eliminates the others; an empty stack proves optimality.

Conversations may be of any length: rows are numbered by `ranked` and solved in segments of SEGMENT rows, each for every
state that it may be entered in; what the segments leave open, one of four states at each border, is decided by one pass over
their small tables. A segment's repair ends in an edit of a row, so that of two of equal cost one audit is never the beginning
of the other, and the lesser audit stays the lesser whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW, table, written
from .ranks import ranked

SEGMENT = 64
#: Rows that a lower bound looks at together.
WINDOW = 5
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, user, assistant. What a row of each initial leads to from each, and what an inserted row does.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What is to be inserted at the end of a conversation, in cost.
CLOSING = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
BLANKS = " \t\n\x0b\f\r"
NEVER = 1 << 30


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row. Codes: x must go; s, u, a and o (other) are initials, in upper case if truncated."""
    out = [("D", DELETE, state)]
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        if (kept := AFTER[code.lower()].get(state)) is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, TURN[state]))
    return out


@lru_cache(maxsize=1 << 17)
def _least(codes: str, state: int) -> int:
    """The least cost of a few rows entered in a state."""
    best, cost = NEVER, 0
    for _ in range(3 if codes else 0):  # two inserted rows reach every state that any number does
        best = min([best, *(cost + c + _least(codes[1:], s) for _, c, s in edits(codes[0], state))])
        state, cost = TURN[state], cost + INSERT
    return best if codes else 0


def lower_bounds(codes: str) -> list[list[int]]:
    """Of each place and state, what the rows from there on cost at least: the rows of a window exactly, those behind it as if the state at each further border were free."""
    n = len(codes)
    free = [0] * (n + WINDOW)
    exact = [[0] * 4 for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        exact[i] = [_least(codes[i : i + WINDOW], s) + free[i + WINDOW] for s in range(4)]
        free[i] = max(min(exact[i]), free[i + 1])
    return exact


def repairs(codes: str, entry: int, closes: bool) -> dict[int, tuple[int, str]]:
    """The cheapest repair (cost, audit), of equal ones the least audit, of rows entered in a state, for each state they can be left in.

    closes: the rows end their conversation, so that rows may be inserted behind them; the only end is then ASSISTANT,
    which stands for every legal one.
    """
    n, least = len(codes), lower_bounds(codes)
    ends = (ASSISTANT,) if closes else (START, SYSTEM, USER, ASSISTANT) if entry == START else (SYSTEM, USER, ASSISTANT) if entry == SYSTEM else (USER, ASSISTANT)
    incumbent: dict[int, tuple[int, str]] = {}

    def bound(i: int, state: int) -> int:
        return least[i][state] if i < n else CLOSING[state] if closes else 0

    def hopeless(i: int, state: int, cost: int, audit: str) -> bool:
        total = cost + bound(i, state)
        for e in ends:
            if e not in incumbent or total < (best := incumbent[e])[0] or (total == best[0] and audit <= best[1][: len(audit)]):
                return False
        return True

    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best[i, state] != (cost, audit) or hopeless(i, state, cost, audit):
            continue
        moves = []
        if i < n:
            moves = [(i + 1, s, cost + c, audit + letter) for letter, c, s in edits(codes[i], state)]
        elif not closes or state in (START, ASSISTANT):
            end = ASSISTANT if closes else state
            incumbent[end] = min(incumbent.get(end, (NEVER, "")), (cost, audit))
        if i < n or (closes and state not in (START, ASSISTANT)):
            moves.append((i, TURN[state], cost + INSERT, audit + "I"))
        moves.sort(key=lambda m: (m[2] + bound(m[0], m[1]), m[3]), reverse=True)  # the most promising is looked at first
        for m in moves:
            node, value = (m[0], m[1]), (m[2], m[3])
            if (node not in best or value < best[node]) and not hopeless(*m):
                best[node] = value
                stack.append(m)
    return incumbent


_cached = lru_cache(maxsize=1 << 16)(repairs)  # most conversations are short, and alike


def walk(codes: str, entry: int, audit: str) -> list[tuple[int | None, str | None]]:
    """What a repair leaves: (row, None) for a kept row, (row, role) for one with another role, (None, role) for an inserted one."""
    out, state, i = [], entry, 0
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            out.append((None, ROLE[state]))
            continue
        if letter == "K":
            state = AFTER[codes[i].lower()][state]
            out.append((i, None))
        elif letter == "R":
            state = TURN[state]
            out.append((i, ROLE[state]))
        i += 1
    return out


def _segments(rows: DataFrame) -> DataFrame:
    """(k, seg, last, pos, mark, row, turn, initial, blank, cut), arrays in order, of rows (_g, pos, n, row, turn, role, text_key, blank, cut); mark 1 follows the first of equal rows."""
    of = F.floor(F.col("pos") / SEGMENT).alias("seg")
    item = rows.select("_g", of, F.struct("pos", F.lit(0).alias("mark"), "row", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "cut", "n").alias("x"))
    first = rows.groupBy("_g", "role", "text_key").agg(F.min("pos").alias("pos"))  # pre-aggregated: copies of a row cost no shuffle
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = first.select("_g", of, F.struct("pos", F.lit(1).alias("mark"), none("bigint", "row"), none("bigint", "turn"), none("string", "initial"), none("boolean", "blank"), none("boolean", "cut"), none("bigint", "n")).alias("x"))
    s = item.unionByName(first).groupBy("_g", "seg").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most 2 * SEGMENT
    last = (F.col("seg") + 1) * SEGMENT >= F.get("x.n", F.lit(0))
    return s.select(F.col("_g.k").alias("k"), "seg", last.alias("last"), *(F.col(f"x.{c}").alias(c) for c in ("mark", "row", "turn", "initial", "blank", "cut")))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


SOLVED = [("seg", pa.int64(), "bigint"), ("last", pa.bool_(), "boolean"), ("codes", pa.string(), "string"), ("rows", pa.list_(pa.int64()), "array<bigint>"), ("cost", pa.list_(pa.int32()), "array<int>"), ("audit", pa.list_(pa.string()), "array<string>")]
SOLVED += [(c, pa.int64(), "bigint") for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "least_turn")] + [(c, pa.string(), "string") for c in ("first_initial", "last_initial")]


def _solve_segment(seg, last, mark, row, turn, initial, blank, cut) -> tuple:
    codes, rows, turns, initials = [], [], [], []
    counts = [0, 0, 0]
    for j, m in enumerate(mark):
        if m:
            continue
        unseen = j + 1 < len(mark) and mark[j + 1] == 1
        fault = 0 if blank[j] else 1 if not unseen else 2 if cut[j] else None
        if fault is not None:
            counts[fault] += 1
        c = initial[j] if initial[j] in ("s", "u", "a") else "o"
        codes.append("x" if fault in (0, 1) else c.upper() if fault == 2 else c)
        rows.append(row[j])
        turns.append(turn[j])
        initials.append(initial[j])
    codes = "".join(codes)
    cost, audit = [-1] * 16, [None] * 16
    for entry in (START,) if seg == 0 else range(4):
        for end, (c, a) in _cached(codes, entry, last).items():
            cost[entry * 4 + end], audit[entry * 4 + end] = c, a
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    known = [t for t in turns if t is not None]
    return (seg, last, codes, rows, cost, audit, *counts, illegal, len(set(known)), turns[0], turns[-1], known[0] if known else None, initials[0], initials[-1])


def _mapped(df: DataFrame, work, kind: str, schema: list[tuple]) -> DataFrame:
    """df, whose first column is the conversation (k), through work: an iterator of rows to an iterator of tuples; rows go in and come out in batches."""
    arrow = pa.schema([("k", ARROW[kind]), *((n, t) for n, t, _ in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for r in work(rows):
            out.append(r)
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} {t}" for n, _, t in schema))


def _decide(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(k, seg, slot, illegal, same) of segments (k, seg, last, cost, audit, initials, turns) in order: the chosen entry and end of each, and what its border adds.

    Of the best repairs up to a border one is kept for each state, with its place among them by audit. Four bytes a
    segment are remembered, so that a conversation of any length is decided in a stream.
    """
    front: dict[int, tuple[int, int]] = {}
    came: list[bytes] = []
    borders = bytearray()
    before = None
    for k, seg, last, cost, audit, first_initial, last_initial, first_turn, last_turn in rows:
        if seg == 0:
            front, came, borders, before = {START: (0, 0)}, [], bytearray(), None
        found: dict[int, tuple] = {}
        for entry, (c, place) in front.items():
            for end in range(4):
                if cost[entry * 4 + end] >= 0:
                    x = (c + cost[entry * 4 + end], place, audit[entry * 4 + end], entry)
                    found[end] = min(found.get(end, x), x)
        order = {v: i for i, v in enumerate(sorted({x[1:3] for x in found.values()}))}
        front = {end: (x[0], order[x[1:3]]) for end, x in found.items()}
        came.append(bytes(found[e][3] if e in found else 9 for e in range(4)))
        borders.append(0 if before is None else 2 * (not _legal(before[0], first_initial)) + (before[1] is not None and before[1] == first_turn))
        before = (last_initial, last_turn)
        if last:
            end, slots = ASSISTANT, bytearray(len(came))
            for i in range(len(came) - 1, -1, -1):
                slots[i] = came[i][end] * 4 + end
                end = came[i][end]
            for i, slot in enumerate(slots):
                yield k, i, slot, borders[i] // 2, borders[i] % 2


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(k, sha256) of the rows (k, seg, at, role, text) of each conversation, which come in order."""
    key, sha = None, None
    for k, _, _, role, text in rows:
        if sha is None or k != key:
            if sha is not None:
                yield key, sha.hexdigest()
            key, sha = k, hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{role}:{text}".encode())
    if sha is not None:
        yield key, sha.hexdigest()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired) of the turns of conversations.

    conversations: one row for each value of conv, NULL too, with gaps, blank, duplicate, truncated, illegal, cost, audit.
    repaired: (conv, seg, at, role, text), what is left of each in the order of (seg, at). Rows are taken by turn, NULL first; those of
    equal turn by role, then the digest of their text. NULL roles and texts count as one space. A conversation may hold
    any share of the rows: only its audit, one value of the result, and a few bytes a segment are ever in one task's
    memory. No row gives no conversation; other columns are not looked at.
    """
    kind = dict(rows.dtypes)[conv]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = written(rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    ends = F.rtrim("text", F.lit(BLANKS))
    narrow = d.select("conv", "row", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    narrow = ranked(narrow, F.col("conv"), [F.col("turn"), F.col("role"), F.col("text_key")])
    solved = written(_mapped(_segments(narrow), lambda rows: ((k, *_solve_segment(*r)) for k, *r in rows), kind, SOLVED)).withColumn("_g", F.struct("k"))
    small = solved.select("k", "seg", "last", "cost", "audit", "first_initial", "last_initial", "first_turn", "last_turn")
    slots = [("seg", pa.int64(), "bigint"), ("slot", pa.int32(), "int"), ("border_illegal", pa.int64(), "bigint"), ("border_same", pa.int64(), "bigint")]
    chosen = _mapped(small.repartition("k").sortWithinPartitions("k", "seg"), _decide, kind, slots)
    chosen = written(solved.join(chosen.select(F.struct("k").alias("_g"), "seg", "slot", "border_illegal", "border_same"), ["_g", "seg"]).withColumns({"cost": F.get("cost", F.col("slot")), "audit": F.get("audit", F.col("slot"))}))
    sums = {c: F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")}
    turns = F.max("last_turn") - F.min("least_turn") + 1 - F.sum(F.col("turns") - F.col("border_same"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    out = chosen.groupBy("_g").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *(sums[c] for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("border_illegal")).alias("illegal"), sums["cost"], audit.alias("audit"))
    out = out.select(F.col("_g.k").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    left = [("seg", pa.int64(), "bigint"), ("at", pa.int32(), "int"), ("row", pa.int64(), "bigint"), ("new_role", pa.string(), "string")]
    steps = _mapped(chosen.select("k", "seg", "codes", "rows", "slot", "audit"), lambda rows: ((k, seg, at, None if i is None else ids[i], role) for k, seg, codes, ids, slot, audit in rows for at, (i, role) in enumerate(walk(codes, slot // 4, audit))), kind, left)
    steps = written(steps)
    own = steps.where(F.col("row").isNotNull()).join(d.select("row", "role", "text"), "row").select("k", "seg", "at", F.coalesce("new_role", "role").alias("role"), "text")
    repaired = own.unionByName(steps.where(F.col("row").isNull()).select("k", "seg", "at", F.col("new_role").alias("role"), F.lit("").alias("text")))
    return out, repaired.withColumnRenamed("k", conv)


def repaired_digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256) of the role:text lines of each repaired conversation, hashed in a stream."""
    kind = dict(repaired.dtypes)[conv]
    r = repaired.select(F.col(conv).alias("k"), "seg", "at", "role", "text").repartition("k").sortWithinPartitions("k", "seg", "at")
    return _mapped(r, _digests, kind, [("repaired_sha256", pa.string(), "string")]).withColumnRenamed("k", conv)


def damage(rows: DataFrame) -> DataFrame:
    """conversations as the query damages them, by the CRC-32 of conv_id:turn."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(value("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text")).alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return d.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """conversations, damaged, with their faults and their cheapest repair; a conversation that loses all rows has zeros and an empty repair."""
    rows = table(spark, sf_dir, "conversations")
    found, repaired = repair(damage(rows))
    same = lambda d: d.withColumn("_g", F.struct("conv_id")).drop("conv_id")
    out = same(rows.select("conv_id").distinct()).join(same(found), "_g", "left").join(same(repaired_digests(repaired)), "_g", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_g.conv_id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
