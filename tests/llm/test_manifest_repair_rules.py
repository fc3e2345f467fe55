"""Merkle manifests, repairs of conversations and quality rules against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.llm import merkle, perplexity, ranks, repair
from tidelark.llm.common import table

H = lambda x: hashlib.sha256(x.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_places_in_groups(spark):
    rows = [(k % 3 if k % 5 else None, k % 7 if k % 11 else None, k) for k in range(400)] + [(9, 1, -1)] * 30
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(6)
    got = ranks.ranked(df, F.col("g"), [F.col("o"), F.col("v")]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        mine = sorted((r.pos, r.o, r.v, r.n) for r in got if r.g == g)
        assert [(o, v) for _, o, v, _ in mine] == [r[1:] for r in own] and [p for p, *_ in mine] == list(range(len(own))) and {n for *_, n in mine} == {len(own)}
    assert ranks.ranked(df.where("false"), F.col("g"), [F.col("o")]).collect() == []


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(part, (*r[:4], t))))

    def tree(level):
        siblings, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for j, p in enumerate(at):
                run = level[p // 16 * 16 : p // 16 * 16 + 16]
                siblings[j].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            at = [p // 16 for p in at]
            level = [H("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], siblings

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    own = {s: tree([leaf(r, r[4]) for r in groups[s]]) for s in names}
    root, above = tree([own[s][0] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        for r, siblings in zip(groups[s], own[s][1], strict=True):
            x = leaf(r, r[4])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                x = leaf(r, r[4].translate(LOWER))
            for a, b in siblings + top:
                x = H(a + x + b)
            out.append((r[0], leaf(r, r[4]), own[s][0], root, H("".join(a + b for a, b in siblings + top)), x, x == root))
    return out


@pytest.mark.parametrize("sizes", [(300, 17, 16, 1), (1,), (16,), (257, *[2] * 40)])
def test_manifest(spark, tmp_path, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.choice([k, k, k, 5, None]), (None, "s", "é", "z")[s % 4] if s < 4 else f"s{s}", rng.choice(["en", None]), rng.choice([k, None]), rng.choice(["Some Text", "É lower", "", None, "a" * 3000 + "Z"])) for s, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumns({c: F.lit(7) for c in ("leaf", "pos", "d", "path")})
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1], r[4], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows + rows[:1]), key=key)


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle(spark, str(tmp_path)).collect() == []


def cheapest(codes):
    """Least (cost, audit) by dynamic programming over rows and states."""
    front = {0: (0, "")}

    def inserted():
        for _ in range(3):
            for s, (c, a) in list(front.items()):
                t = 3 if s == 2 else 2
                front[t] = min(front.get(t, (10**9, "")), (c + 3, a + "I"))

    for x in codes:
        inserted()
        new = {}
        for s, (c, a) in front.items():
            moves = [("D", 4, s)]
            if x != "x":
                extra = 3 * x.isupper()
                moves.append(("R", 3 + extra, 3 if s == 2 else 2))
                if (x.lower(), s) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    moves.append(("K", extra, {"s": 1, "u": 2, "a": 3}[x.lower()]))
            for letter, cost, t in moves:
                new[t] = min(new.get(t, (10**9, "")), (c + cost, a + letter))
        front = new
    inserted()
    return min(front[s] for s in (0, 3) if s in front)


def test_repairs_are_cheapest_and_least():
    rng = random.Random(2)
    for n in range(9):
        for alphabet in ("xsuaoSUAO", "uaUAx", "ua", "su"):
            for _ in range(25):
                codes = "".join(rng.choice(alphabet) for _ in range(n))
                assert repair.repairs(codes, 0, True)[3] == cheapest(codes), codes
    for alphabet in ("u", "a", "xsuaoSUAO", "uaUA"):
        codes = "".join(rng.choice(alphabet) for _ in range(repair.SEGMENT))
        assert repair.repairs(codes, 0, True)[3] == cheapest(codes)


def plain_repairs(rows):
    value = lambda x: " " if x is None else str(x)
    bare = lambda t: t.strip(" \t\n\x0b\x0c\r")
    conversations = {}
    for c, turn, role, text in rows:
        own = conversations.setdefault(c, [])
        k = zlib.crc32(f"{value(c)}:{value(turn)}".encode()) % 20
        role, text = "user" if k == 4 else value(role), "" if k == 1 else re.sub("[.!?]", "", value(text)) if k == 2 else value(text)
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        codes, seen, faults = "", set(), Counter()
        for _, role, text in own:
            fault = "blank" if not bare(text) else "duplicate" if (role, text) in seen else "truncated" if bare(text)[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            x = role[0] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else x.upper() if fault else x
        turns = {r[0] for r in own} - {None}
        cost, audit = cheapest(codes)
        lines, state, rest = [], 0, iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[role[0]] if letter == "K" else 3 if state == 2 else 2
            lines.append(f"{role if letter == 'K' else ('', '', 'user', 'assistant')[state]}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, H("\n".join(lines))))
    return sorted(out, key=str)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("segment", [64, 3])
def test_repaired_conversations(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)  # a third of all rows in one conversation, over many segments
    rng = random.Random(segment)
    rows = [(rng.choice([7, 7, 7, None, 1, 2, 3, 4, 50 + k]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(["Hi.", "no end", " ", "", None, "What?", "a b c!", "x\x0b", "y. \n", f"{k}.", "é?" * 500])) for k in range(400)]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit(1) for c in ("row", "pos", "seg", "audit")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in repair.op12_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_repairs(rows)


def test_conversations_without_rows(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVERSATION).write.parquet(f"{tmp_path}/one/conversations.parquet")
    assert [tuple(r) for r in repair.op12_repair(spark, f"{tmp_path}/one").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", H(""))]
    spark.createDataFrame([], CONVERSATION).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.op12_repair(spark, f"{tmp_path}/none").collect() == []


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_base_rules(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \n\x0b", "a a a a", "x\ny\nx\n\n x\nx", "é ü #|| \x1c b", "one two three " * 40, " ".join(str(k) for k in range(60)), "w" * 5000, "\x00 \x02\x03 \x00a"]
    texts += [rng.choice(" \n\t").join(rng.choice(["ab", "c", "$é", "d　e", "f<>"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    monkeypatch.setattr(perplexity, "PIECE", 64)  # texts of many pieces
    monkeypatch.setattr(perplexity, "PLACES", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for r in perplexity.quality_rules(df).collect():
        assert tuple(r)[1:7] == plain_rules(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def plain_kneser_ney(words, order=5):
    """log10 probabilities of each place of a word, from counts of words, in dictionaries."""
    pad = lambda w: "\2" * (order - 1) + w + "\3"
    types = Counter()
    for w, c in words.items():
        p = pad(w)
        for i in range(order, len(p) + 1):
            types[p[i - order : i]] += c
    levels = []
    for k in range(order, 0, -1):
        n = [sum(c == i for c in types.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cut = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if y is not None and n[i] else i / 2 for i in (1, 2, 3)]
        whole, left = Counter(), Counter()
        for g, c in types.items():
            whole[g[:-1]] += c
        share = {g: (c - cut[min(c, 3) - 1]) / whole[g[:-1]] for g, c in types.items()}
        for g, v in share.items():
            left[g[:-1]] += v
        levels.append((share, left))
        shorter = Counter()
        for g, c in types.items():
            shorter[g[1:]] += c if g[1:2] == "\2" else 1
        kinds = len(types)
        types = shorter

    def places(w):
        p, out = pad(w), []
        for i in range(order, len(p) + 1):
            q = 1 / (kinds + 1)
            for share, left in levels[::-1]:
                k = len(next(iter(share)))
                q = share.get(p[i - k : i], 0.0) + (1 - left[p[i - k : i - 1]] if p[i - k : i - 1] in left else 1.0) * q
            out.append(np.log10(q))
        return sum(out)

    return places


def test_the_model_is_kneser_ney(spark):
    rng = random.Random(9)
    texts = {"en": [" ".join(rng.choice(["the", "then", "hen", "a", "été", "thin", "zzz"]) for _ in range(80)) for _ in range(5)], None: ["xx xy"]}
    df = spark.createDataFrame([(k, lang, t) for lang, x in texts.items() for k, t in enumerate(x)], "doc_id int, lang string, text string")
    m = perplexity.fit_ngrams(df)
    for lang, x in texts.items():
        plain = plain_kneser_ney(Counter(w for t in x for w in t.split()))
        probes = ["the", "thez", "été", "qq", "h", "xx", "thenthen"]
        got = m.words([w.encode() for w in probes], lang or "")[0]
        assert got == pytest.approx([plain(w) for w in probes], abs=1e-9)
    assert sum(10 ** m.words([bytes([c])], "en")[0][0] for c in range(97, 123)) < 1


def test_bands_reject_odd_texts(spark):
    rng = random.Random(1)
    syllables = ["ta", "no", "ri", "ke", "mu", "sa"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(120))
    odd = " ".join("".join(chr(rng.randint(33, 500)) for _ in range(6)) for _ in range(120))
    rows = [(k, "en", text()) for k in range(200)] + [(900, "en", odd), (901, "en", "kkkk " * 20 + " ".join(f"{'k' * i}" for i in range(1, 60)))]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id int, lang string, text string")).collect()}
    assert all(got[k].kept for k in range(200)) and not got[900].kept and got[900].log_perplexity > got[900].high
    assert perplexity.quality_rules(spark.createDataFrame([], "doc_id int, lang string, text string")).collect() == []


def test_rules_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: plain_rules(r.text) for r in table(spark, sf, "documents").collect()}
    assert all(tuple(r)[1:7] == truth[r.doc_id] for r in perplexity.op13_rules(spark, sf).collect())
