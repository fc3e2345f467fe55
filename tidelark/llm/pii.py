"""Personal data: exact base patterns, and more spans that weak labelers agree on.

Candidates are the base spans, the matches that fail a base pattern's test, and spans of wider patterns. What can be seen
of a candidate and around it is a small code. Regex, gazetteer and context labelers vote on it; expectation-maximisation
over the counts of codes (their number is bounded, whatever the corpus) estimates how reliable each labeler is for each
kind, and its posteriors train a classifier on features of the span and its context. Of the candidates that aren't base
spans, those are taken that the classifier gives ACCEPT at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, slices, table
from .logistic import Logistic

KINDS = ("email", "ip", "card", "phone")
#: The classifier's least probability for a span that no base pattern has.
ACCEPT = 0.9
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does, so that no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns, for the labelers to decide on.
AT_WORD = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
AT = re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
SHORT_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2,4}(?![0-9])")
NEAR = {
    "email": frozenset("email e-mail mail contact correo courriel write reach".split()),
    "ip": frozenset("ip host address server client login from".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact telefon telefono".split()),
}
AGAINST = frozenset("version release id isbn issn doi order invoice section chapter page no number ref".split())
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info co".split())
WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
HAS_DIGIT = re.compile("[0-9]")
#: First digits of card issuers; area and exchange of a local number; the first part of a public or private address.
ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
AREA = re.compile(r"[2-9][0-9]{2}[2-9]")
NETWORK = re.compile(r"[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    """Whether all parts are at most 255, however many zeros they begin with."""
    return all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for p in s.split(".")))


def matches(text: str) -> list[tuple[Span, bool]]:
    """The matches of the four base patterns in code points, leftmost and non-overlapping within each kind, and whether each passes its test."""
    out: list[tuple[Span, bool]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(((0, start, m.end()), True))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [((1, m.start(), m.end()), _octets(m[0])) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:  # 19 digits with separators between them
            d = _digits(m[0])
            if 13 <= len(d) <= 19:
                out.append(((2, m.start(), m.end()), len(d) >= 14 and luhn(d)))
    if "+" in text:
        out += [((3, m.start(), m.end()), 10 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return sorted(out, key=lambda s: (s[0][1], s[0][0]))


def base_spans(text: str) -> list[Span]:
    """The spans of the four base patterns, by start and kind."""
    return [s for s, ok in matches(text) if ok]


def wider_spans(text: str, base: list[Span], failed: list[Span] = ()) -> list[Span]:
    """Candidates of the wider patterns, and failed matches, that touch no base span and no candidate that starts before."""
    found: list[Span] = list(failed)
    if AT.search(text):
        found += [(0, m.start(), m.end()) for m in AT_WORD.finditer(text)]
    if text.count(":") >= 7:
        found += [(1, m.start(), m.end()) for m in IP6.finditer(text)]
    if HAS_DIGIT.search(text):
        found += [(2, m.start(), m.end()) for m in SHORT_CARD.finditer(text)]
        found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    out: list[Span] = []
    taken = sorted((a, z) for _, a, z in base)
    i = end = 0  # base spans that begin before a candidate ends, and where the last of these or of the candidates ends
    for k, a, z in sorted(found, key=lambda s: (s[1], s[0], s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and all(x >= z for x, _ in taken[i : i + 1]) and a >= max((y for _, y in taken[max(0, i - 1) : i]), default=0):
            out.append((k, a, z))
            end = z
    return out


#: How many values each part of a code has: see features().
SIZES = (2, 2, 3, 3, 3, 3, 4, 3)
CODES = int(np.prod(SIZES))


def features(text: str, span: Span) -> tuple[int, ...]:
    """What can be seen of a span: cue and counter-cue before it, the characters left and right, its test, a gazetteer, its digits and separators.

    Left and right: 0 apart, 1 a letter or digit, 2 part of an address or code. Test and gazetteer: 0 says nothing,
    1 for, 2 against.
    """
    k, a, z = span
    kind, s = KINDS[k], text[a:z]
    d = _digits(s) if z - a <= 100 else "0" * 100
    before = [w.lower() for w in WORD.findall(text[max(0, a - 40) : a])][-4:]
    cue, counter = any(w in NEAR[kind] for w in before), any(w in AGAINST for w in before)
    left, right = text[a - 1 : a], text[z : z + 2]
    left = 1 if left.isalnum() else 2 if left and left in "=_/#.-:" and kind != "email" else 0
    right = 1 if right[:1].isalnum() else 2 if right and (right[0] in "=_/" or (right[0] in ".-:" and right[1:].isalnum())) else 0
    if kind == "email":
        name = re.split(r"@|[\[(]", s)[0].strip()
        test = 2 if name[:1] in (".", "") or name[-1:] == "." or ".." in s or len(s) > 80 else 1
        known = 1 if re.split(r"[.\s\])]", s.lower())[-1] in ENDINGS else 0
    elif kind == "ip":
        v6 = ":" in s
        test = 1 if v6 or _octets(s) else 2
        first = s.split(".")[0]
        known = 1 if v6 or NETWORK.fullmatch(first) else 2
    elif kind == "card":
        test = 1 if luhn(d) else 2
        known = 1 if ISSUER.match(d) else 2
    else:
        plus, area = s.startswith("+"), bool(AREA.match(d))
        test = 1 if (10 <= len(d) <= 15 if plus else len(d) == 10 and area) else 2
        known = (1 if d[0] != "0" else 2) if plus else 0 if area else 2
    size = sum(len(d) >= x for x in (9, 12, 15))
    return int(cue), int(counter), left, right, test, known, size, min(2, len({c for c in s if c in " .-()[]:"}))


def encoded(k: int, seen: tuple[int, ...]) -> int:
    code = k
    for v, n in zip(seen, SIZES, strict=True):
        code = code * n + v
    return code


def decoded(code: int) -> tuple[int, tuple[int, ...]]:
    seen = []
    for n in reversed(SIZES):
        code, v = divmod(code, n)
        seen.append(v)
    return code, tuple(reversed(seen))


SIGN = (0, 1, -1)
#: Digits, as features() puts them in classes, that a kind has as a rule; those of an address say nothing.
USUAL = {"email": (0,), "card": (2, 3), "phone": (1, 2)}


def votes(k: int, seen: tuple[int, ...]) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 abstains."""
    cue, counter, left, right, test, known, size, _ = seen
    words = 1 if cue and not counter else -1 if counter and not cue else 0  # gazetteer of words before
    apart = 1 if not left and not right else -1  # context
    form = 0 if KINDS[k] not in USUAL else 1 if size in USUAL[KINDS[k]] else -1  # regex
    return SIGN[test], words, apart, SIGN[known], form


def inputs(seen: np.ndarray) -> np.ndarray:
    """The classifier's inputs: one of each value of each feature but the first."""
    return np.concatenate([seen[:, [j]] == np.arange(1, n) for j, n in enumerate(SIZES)], axis=1).astype(float)


@dataclass
class PiiModel:
    """Which codes are taken; those of kinds that nothing was learned of aren't."""

    least: float = ACCEPT
    reliabilities: dict[str, np.ndarray] = field(default_factory=dict)
    classifiers: dict[str, Logistic] = field(default_factory=dict)
    known: dict[int, float] = field(default_factory=dict)

    def probability(self, code: int) -> float:
        if code not in self.known:  # at most 4 * CODES
            k, seen = decoded(code)
            c = self.classifiers.get(KINDS[k])
            self.known[code] = 0.0 if c is None else float(c.predict(inputs(np.array([seen])))[0])
        return self.known[code]

    def accepts(self, code: int) -> bool:
        return self.probability(code) >= self.least


#: Counts that reliabilities begin from, by class and vote: a test, words before and a gazetteer are taken to tell much, places and forms, which most candidates share, little.
STRONG, WEAK = [[8, 2, 1], [1, 2, 8]], [[1, 2, 2], [1, 2, 4]]
PRIORS = np.array([STRONG, STRONG, WEAK, STRONG, WEAK], float).transpose(1, 0, 2)


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100, start: np.ndarray | None = None, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | class) as class x labeler x (against, abstains, for).

    v: patterns x labelers of -1, 0, 1; n: how often each occurs. Begins from the majority of the votes and a Beta
    prior that takes labelers to be better than chance.
    """
    p = 1 / (1 + np.exp(-v.sum(1) * 1.0)) if start is None else start
    prior = np.array([[[4, 2, 1]], [[1, 2, 4]]], float) if prior is None else prior
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        theta = np.stack([(w @ (v == x)) for x in (-1, 0, 1)], axis=-1) + prior
        theta /= theta.sum(-1, keepdims=True)
        share = np.clip((w.sum(1) + 1) / (w.sum() + 2), 1e-6, 1)
        log = np.log(share)[:, None] + sum(np.log(theta[:, j, v[:, j] + 1]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, theta


def candidates_in(text: str) -> list[tuple[Span, bool, int]]:
    """The spans of a text to decide on, whether each is a base span, and its code."""
    every = matches(text)
    base = [s for s, ok in every if ok]
    both = [(s, True) for s in base] + [(s, False) for s in wider_spans(text, base, [s for s, ok in every if not ok])]
    return [(s, b, encoded(s[0], features(text, s))) for s, b in both]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, patterns): for each row of docs its spans as kind, start, end, base (0, 1), one after the other, and their codes."""
    kind = dict(docs.dtypes)[id_col]

    def factory():
        def work(ids, texts):
            found = [candidates_in(t or "") for t in texts]
            return ids, [[x for s, b, _ in f for x in (*s, int(b))] for f in found], [[c for *_, c in f] for f in found], [""] * len(ids)

        return work

    out = map_texts(docs, [F.col(id_col).alias("_id"), F.col(text_col).alias("_t")], 1, factory, [("_id", kind), ("spans", "array<int>"), ("patterns", "array<int>"), ("_t", "string")])
    return out.select(F.col("_id").alias(id_col), "spans", "patterns")


def fit_pii(found: DataFrame, accept: float = ACCEPT) -> PiiModel:
    """Learns from all candidates of the corpus; at most 4 * CODES counts reach the driver. Without candidates of a kind it accepts none of it."""
    rows = found.select(F.explode("patterns").alias("code")).groupBy("code").count().collect()
    model = PiiModel(accept)
    for k, kind in enumerate(KINDS):
        mine = sorted((r["code"], r["count"]) for r in rows if decoded(r["code"])[0] == k)
        if not mine:
            continue
        seen, n = np.array([decoded(c)[1] for c, _ in mine]), np.array([c for _, c in mine], float)
        v, group = np.unique(np.array([votes(k, tuple(s)) for s in seen.tolist()]), axis=0, return_inverse=True)
        start = 1 / (1 + np.exp(-v @ np.where(PRIORS[1, :, 2] > 4, 1.0, 0.25)))
        p, model.reliabilities[kind] = expectation_maximisation(v, np.bincount(group, n), start=start, prior=PRIORS)
        p, x = p[group], inputs(seen)
        model.classifiers[kind] = Logistic(1e-2).fit(np.concatenate([x, x]), np.r_[np.ones(len(p)), np.zeros(len(p))], np.r_[n * p, n * (1 - p)] + 1e-9)
    return model


def final_spans(spans: list[int], patterns: list[int], model: PiiModel) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the accepted ones, each by start and kind."""
    every = [(tuple(spans[4 * i : 4 * i + 3]), spans[4 * i + 3], p) for i, p in enumerate(patterns)]
    by = lambda s: (s[1], s[0], s[2])
    return sorted((s for s, b, _ in every if b), key=by), sorted((s for s, b, p in every if b or model.accepts(p)), key=by)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def resolve(found: DataFrame, model: PiiModel, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): counts are of base spans; base and spans are written kind:start:end."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kind = dict(found.dtypes)[id_col]

    def factory():
        m = shared.value

        def work(ids, spans, patterns, _):
            both = [final_spans(s, p, m) for s, p in zip(spans, patterns, strict=True)]
            return ids, *([sum(s[0] == k for s in b) for b, _ in both] for k in range(4)), [written(b) for b, _ in both], [written(a) for _, a in both]

        return work

    schema = [("_id", kind), *((f"n_{k}", "bigint") for k in KINDS), ("base", "string"), ("spans", "string")]
    return map_texts(found, [F.col(id_col), F.col("spans"), F.col("patterns"), F.lit("").alias("_t")], 3, factory, schema).withColumnRenamed("_id", id_col)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """resolve() of all rows of docs, with a model of their own candidates.

    A NULL text counts as empty and has no spans; repeated rows give repeated results; an empty table gives an empty
    result; other columns aren't looked at.
    """
    found = checkpointed(candidates(docs, id_col, text_col))  # one scan of the texts; candidates are few
    return resolve(found, fit_pii(found), id_col)


def mask_pii(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of personal data replaced by [KIND], and length_col (where docs has it) set anew.

    Rows without spans, NULL texts included, stay as they are; all columns and repeated rows stay.
    """
    if model is None:
        model = fit_pii(candidates(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def masked(text: str, m: PiiModel) -> str:
        spans = [s for s, base, code in candidates_in(text) if base or m.accepts(code)]
        out, end = [], 0
        for k, a, z in sorted(spans, key=lambda s: (s[1], s[0])):
            if z <= end:
                continue
            out += [text[end : max(a, end)], f"[{KINDS[k].upper()}]"]
            end = z
        return "".join([*out, text[end:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                texts = [None if t is None else masked(t, m) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                if length_at is not None:
                    old = columns[length_at].to_pylist()
                    columns[length_at] = pa.array([n if new is None or new == was else len(new) for n, new, was in zip(old, texts, part.column(at).to_pylist(), strict=True)], columns[length_at].type)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
