"""Operator 3: personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans of each kind. The field's nodes are a text's mentions in order: the base spans, and what looks
like one but fails the patterns (seven digits or more with separators, parts of such runs that would pass on their own, or an
address written with "(at)"). Node features, a chain potential between neighbours and a skip potential between distant
mentions that repeat or resemble each other (the same address or local part, the same last seven digits, the same network)
score the labels none, email, ip, card and phone. Loopy message passing gives each mention's marginals; mentions outside the
base spans are added where a kind has at least MIN_MARGINAL, of those that overlap the likeliest. Base spans always stay.

Weights, skip potential included, are fitted by pseudo-likelihood on at most FIT_MENTIONS mentions of each of at most
FIT_TEXTS texts (by a hash of the id; rows that share one give one text). Base spans are their labels. As patterns leave no
labelled repeats that they miss, each text is told once more, with each base mention again in a loose form that hides its
label from the patterns, next to a decoy of the same form (other digits or letters, label none): the node can't tell the two
apart, so what the field learns of them is how far a repeat is to be trusted.

All patterns run in linear time: they start at the edges of runs only, and don't backtrack over digits.

Cases: null and empty texts have no spans. Very long texts are searched whole. Of equal marginals the first mention is
taken. Repeated rows are searched each; null ids stay null. Other columns are ignored. An empty table gives an empty result.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, read, text_chunks

KINDS = ("email", "ip", "card", "phone")
FIT_TEXTS, FIT_MENTIONS, MIN_MARGINAL, ROUNDS = 4000, 200, 0.8, 30

# The patterns of the base spans, each from the edge of a run so that no place is tried twice.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may be a mention though no pattern fits.
_LOOSE = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().,/:_-]{0,2}[0-9])++")
_LOOSE_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's matches: the run before an @ that no earlier match took, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Mention(NamedTuple):
    start: int
    end: int
    label: int  # 0: none, else 1 + the kind's number
    known: bool  # whether the label may be learned from
    keys: tuple[str, ...]  # mentions with a key in common repeat or resemble each other
    features: tuple[float, ...]


FEATURES = 10


def _mention(s: str, start: int, label: int, known: bool = True) -> Mention:
    d = _digits(s)
    at = "@" in s or "(at" in s or "[at" in s
    numbers = re.findall("[0-9]+", s)
    keys: tuple[str, ...] = ()
    if at:
        address = re.sub(r"\x20?[\[(]at[\])]\x20?", "@", s).lower()
        local = address.partition("@")[0]
        keys = (f"e:{address}", *([f"l:{local}"] if len(local) >= 5 else []))
    elif len(numbers) == 4 and all(len(n) <= 3 for n in numbers):
        keys = (f"i:{'.'.join(numbers)}", f"n:{'.'.join(numbers[:3])}")
    elif len(d) >= 7:
        keys = (f"d:{d[-7:]}",)
    parts = s.split(".")
    return Mention(start, start + len(s), label, known, keys, (
        1.0, float(s[:1] == "+"), float(13 <= len(d) <= 19 and luhn(d)), float(9 <= len(d) <= 15), float(13 <= len(d) <= 19), float(len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)),
        float("@" in s), float(at and "@" not in s), float(len(d) < 9 and not at), float(" " in s),
    ))


def _parts(s: str) -> list[tuple[int, int]]:
    """Of a run of digits with separators: parts, from one space to another, that would be a card or a phone on their own."""
    tokens = [m.span() for m in re.finditer(r"[^\x20]+", s)]
    digits = [_digits(s[a:b]) for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        d = ""
        for j in range(i, len(tokens)):
            d += digits[j]
            if len(d) > 19:
                break
            if (i or j < len(tokens) - 1) and (s[a] == "+" and 9 <= len(d) <= 15 or 13 <= len(d) and luhn(d)):
                out.append((a, a + len(s[a : tokens[j][1]].rstrip("().,/:_-"))))
    return out


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[Mention]:
    """In order of start; loose ones only outside the base spans."""
    out = [_mention(text[a:b], a, 1 + KINDS.index(k)) for k, a, b in spans]
    told = {k for m in out for k in m.keys}
    taken = sorted((a, b) for _, a, b in spans)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    starts = [a for a, _ in taken]
    for pattern in (_LOOSE, _LOOSE_AT):
        for m in pattern.finditer(text):
            if pattern is _LOOSE and len(_digits(m[0])) < 7:
                continue
            before = int(np.searchsorted(starts, m.end()))
            if not before or ends[before - 1] <= m.start():
                whole = _mention(m[0], m.start(), 0)
                out += [whole._replace(known=told.isdisjoint(whole.keys))] if len(_digits(m[0])) <= 19 or pattern is _LOOSE_AT else []
                out += [_mention(m[0][a:b], m.start() + a, 0, False) for a, b in _parts(m[0])] if pattern is _LOOSE else []
    return sorted(out)


def loosely(kind: str, s: str) -> str:
    """The same in a form that no pattern finds."""
    if kind == "email":
        return s.replace("@", " (at) ")
    return {"ip": " . ", "card": ".", "phone": "."}[kind].join(re.findall("[0-9]+", s))


def with_hidden(text: str, found: list[Mention]) -> list[Mention]:
    """found and, after it, each base mention again in a loose form, with a decoy of that form."""
    out, at = list(found), len(text)
    for n, m in enumerate(m for m in found if m.label):
        s = text[m.start : m.end]
        kind = KINDS[m.label - 1]
        turned = iter([c for c in reversed(s) if c.isalnum()])
        decoy = "".join(next(turned) if c.isalnum() else c for c in s)
        pair = [(loosely(kind, s), m.label), (loosely(kind, decoy), 0)]
        for form, label in pair if n % 2 else reversed(pair):
            made = _mention(form, at, label)
            if label or set(made.keys).isdisjoint(m.keys):
                out.append(made)
            at += len(form) + 1
    return out


class Field(NamedTuple):
    node: np.ndarray  # (FEATURES, 5)
    chain: np.ndarray  # (5, 5), from a mention to the next
    skip: np.ndarray  # (5, 5), symmetric


def edges_of(found: list[Mention]) -> tuple[np.ndarray, np.ndarray]:
    """(edges, 2) of neighbours, and of each mention with the last before it of each of its keys."""
    last: dict[str, int] = {}
    skip: dict[tuple[int, int], None] = {}
    for i, m in enumerate(found):
        for k in m.keys:
            if k in last:
                skip[last[k], i] = None
            last[k] = i
    n = np.arange(len(found) - 1)
    return np.stack((n, n + 1), 1), np.array(list(skip), np.int64).reshape(-1, 2)


def marginals(field: Field, found: list[Mention]) -> np.ndarray:
    """Sum-product messages along both kinds of edges, damped, ROUNDS times at most. Labels of base spans are evidence."""
    score = np.array([m.features for m in found]) @ field.node
    label = np.array([m.label for m in found])
    score = np.where((label[:, None] == 0) | (label[:, None] == np.arange(5)), score, -50.0)
    chain, skip = edges_of(found)
    source = np.concatenate((chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]))
    target = np.concatenate((chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]))
    reverse = np.concatenate([np.arange(len(e)) + o for e, o in ((chain, len(chain)), (chain, 0), (skip, 2 * len(chain) + len(skip)), (skip, 2 * len(chain)))])
    potential = np.concatenate((np.repeat(field.chain[None], len(chain), 0), np.repeat(field.chain.T[None], len(chain), 0), np.repeat(field.skip[None], 2 * len(skip), 0)))
    message = np.zeros((len(source), 5))
    for _ in range(ROUNDS if len(source) else 0):
        belief = score.copy()
        np.add.at(belief, target, message)
        z = (belief[source] - message[reverse])[:, :, None] + potential
        top = z.max(1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.5 * (message + new)
        if moved < 1e-4:
            break
    np.add.at(score, target, message)
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(texts: list[list[Mention]], rounds: int = 150) -> Field:
    """Pseudo-likelihood: each labelled mention given the labels of its labelled neighbours."""
    x, y, known, chain, skip = [], [], [], [], []
    for found in texts:
        base = len(y)
        x += [m.features for m in found]
        y += [m.label for m in found]
        known += [m.known for m in found]
        c, s = edges_of(found)
        chain.append(c + base)
        skip.append(s + base)
    node, links = np.zeros((FEATURES, 5)), np.zeros((2, 5, 5))
    if not y:
        return Field(node, links[0], links[1])
    x, y, known = np.array(x), np.array(y), np.array(known)
    gold = np.eye(5)[y]
    pairs = [e[known[e].all(1)] for e in (np.concatenate(chain), np.concatenate(skip))]
    n = known.sum()
    penalty = np.concatenate((np.full(FEATURES * 5, 1e-4), np.full(25, 3e-2), np.full(25, 1e-4)))  # neighbours decide only where nothing else does
    p = np.zeros(len(penalty))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for r in range(1, rounds + 1):
        node, links = p[: FEATURES * 5].reshape(FEATURES, 5), p[FEATURES * 5 :].reshape(2, 5, 5)
        s = x @ node
        for e, w in zip(pairs, links, strict=True):
            np.add.at(s, e[:, 1], w[y[e[:, 0]]])
            np.add.at(s, e[:, 0], w[:, y[e[:, 1]]].T)
        q = np.exp(s - s.max(1, keepdims=True))
        miss = (gold - q / q.sum(1, keepdims=True)) * known[:, None]
        grads = [gold[e[:, 0]].T @ miss[e[:, 1]] + miss[e[:, 0]].T @ gold[e[:, 1]] for e in pairs]
        grads[1] = (grads[1] + grads[1].T) / 2
        g = np.concatenate([(x.T @ miss).ravel(), *(a.ravel() for a in grads)]) / n - penalty * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    links = p[FEATURES * 5 :].reshape(2, 5, 5)
    return Field(p[: FEATURES * 5].reshape(FEATURES, 5), links[0], links[1])


def find(field: Field, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the field adds."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    found = mentions(text, base)
    if all(m.label for m in found):
        return base, []
    p = marginals(field, found)
    likely = [(-q[k], m.start, m.end, KINDS[k - 1]) for m, q in zip(found, p, strict=True) if not m.label and (k := int(q.argmax())) and q[k] >= MIN_MARGINAL]
    added: list[tuple[str, int, int]] = []
    for _, a, b, kind in sorted(likely):
        at = bisect_left(added, a, key=lambda s: s[1])
        if (at == len(added) or b <= added[at][1]) and (not at or added[at - 1][2] <= a):
            added.insert(at, (kind, a, b))
    return base, added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def fit_field(docs: DataFrame, limit: int = FIT_TEXTS) -> Field:
    """docs: (id, text). Mentions of at most `limit` texts that hold a digit or an @, first by a hash of the id."""
    names = ["start", "end", "label", "known", "keys", "features"]
    ddl = "id long, again boolean, start long, end long, label long, known boolean, keys array<string>, features array<double>"
    schema = pa.schema([("id", pa.int64()), ("again", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int64()), ("known", pa.bool_()), ("keys", pa.list_(pa.string())), ("features", pa.list_(pa.float64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = mentions(t, base_spans(t))[:FIT_MENTIONS]
                rows += [(i, again, *m) for again, told in ((False, found), (True, with_hidden(t, found))) for m in told]
            if rows:
                yield arrow_batch(schema, [list(c) for c in zip(*rows, strict=True)])

    some = docs.where(F.col("id").isNotNull() & F.col("text").rlike("[0-9@]"))
    chosen = some.select("id").distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(limit)
    texts = some.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(made, ddl).toArrow().to_pandas().sort_values(["id", "again", "start", "end", "label"], kind="stable")
    return fit([[Mention(*r) for r in g[names].itertuples(index=False)] for _, g in rows.groupby(["id", "again"])])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of the base spans, n_added, base_sha256, spans) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_field(docs))
    counts = [f"n_{k}" for k in (*KINDS, "added")]
    ddl = f"{id_col} long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in ddl.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch, texts in text_chunks(batches, "text"):
            rows = []
            for base, added in (find(field, t) for t in texts):
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
            yield arrow_batch(schema, [batch.column(0), *(list(c) for c in zip(*rows, strict=True))])

    return docs.mapInArrow(search, ddl)


def mask(text: str | None, spans: str) -> str | None:
    """The text with its spans replaced by their kinds in brackets; of overlapping spans the first counts."""
    out, since = [], 0
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= since:
            out += [text[since:a], f"[{k}]"]
            since = b
    return text if text is None else "".join([*out, text[since:]])


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))
