"""Operator 8: quality rules by line sequence labelling with a linear-chain conditional random field.

Each line of a text with a word is content or boilerplate. Features of the line's characters, the mean weight of its words
(hashed to BUCKETS) and the label of the line before score the labels; Viterbi decoding marks the lines, and a text is kept
if its base rules pass and at least CONTENT_SHARE of its words stand in content lines.

The field is fitted by likelihood on the lines of a bounded sample of labelled texts (FIT_TEXTS texts, FIT_LINES lines of
each), whose lines are labelled one by one: lines that stand between RECURRING different pairs of lines or more in the
sample, lines that stand earlier in their text and lines of texts of poor quality are boilerplate, the others content. So good texts teach the field how
labels change from line to line. All texts are scored whole.

Cases: null and empty texts and texts without words have no words and fail the base rules. Without labelled rows, or with
lines of one label alone, all lines count as content. Very long texts are hashed piece by piece and decoded line by line.
Repeated rows are scored each; null ids stay null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_batch, labelled_sample, mix64, ngrams, read, span_hashes, text_chunks, words_of

FIT_TEXTS, FIT_LINES, RECURRING, CONTENT_SHARE, BUCKETS = 2000, 60, 3, 0.5, 4096
SYMBOLS = b"#*$%&|<>"  # fixed value of the base rules
FEATURES = 11

_CLASS = np.zeros((5, 256), np.int32)  # symbols, upper case, other letters and bytes of letters, digits, other marks
for _row, _bytes in enumerate((SYMBOLS, range(65, 91), [*range(97, 123), *range(128, 256)], range(48, 58), b"!?|.,;:")):
    _CLASS[_row, list(_bytes)] = 1


class Lines(NamedTuple):
    """Lines with a word: text_of, the number of words, hash and features of each; bucket: of each word, line_of: its line."""

    text_of: np.ndarray
    words: np.ndarray
    hash: np.ndarray
    features: np.ndarray
    bucket: np.ndarray
    line_of: np.ndarray


def lines_of(words: Words, h: np.ndarray) -> Lines:
    ends = np.flatnonzero(words.raw == 10)  # the last of each text stands for its end
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(words.begin, begins)
    after = np.searchsorted(words.begin, ends)
    has = after > first
    begins, ends, first, after = begins[has], ends[has], first[has], after[has]
    text_of = np.searchsorted(words.text_at, begins, side="right") - 1
    n = (after - first).astype(np.float64)

    def between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return (total[b] - total[a]).astype(np.float64)

    size = np.maximum(ends - begins, 1).astype(np.float64)
    symbols, upper, lower, digits, marks = (between(row[words.raw], begins, ends) for row in _CLASS)
    same = np.zeros(len(h) + 1)
    same[1 : len(h)] = h[1:] == h[:-1]
    repeats = between(same[: len(h)], first, after)
    lengths = between(words.end - words.begin, first, after) / n
    marked = words.raw[np.maximum(words.end - 1, 0)] if len(h) else np.zeros(0, np.uint8)
    marked_words = between(_CLASS[4][marked] + _CLASS[0][marked], first, after)
    last = marked[after - 1] if len(after) else marked
    whole = span_hashes(words.raw, begins, ends)
    order = np.lexsort((whole, text_of))  # stable: an earlier line of the same text comes before
    earlier = np.zeros(len(begins))
    earlier[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    features = np.stack([
        np.ones(len(n)), np.log1p(n) / 3, 10 * symbols / size, upper / np.maximum(upper + lower, 1), 5 * digits / size, 5 * marks / size,
        repeats / n, np.abs(lengths - 6) / 6, marked_words / n, np.isin(last, list(b".!?")).astype(float), earlier,
    ], 1) if len(n) else np.zeros((0, FEATURES))
    return Lines(text_of, after - first, whole, np.minimum(features, 5), (h % np.uint64(BUCKETS)).astype(np.int64), np.repeat(np.arange(len(n)), after - first))


class Field(NamedTuple):
    """weights: (features, 2), labels boilerplate and content; lexicon: of words' buckets for content; steps: (2, 2) from
    label to label."""

    weights: np.ndarray
    lexicon: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray, words: np.ndarray, bucket: np.ndarray, line_of: np.ndarray) -> np.ndarray:
        """(lines, 2)"""
        out = features @ self.weights
        out[:, 1] += np.bincount(line_of, self.lexicon[bucket], len(out)) / np.maximum(words, 1)
        return out


def label_lines(field: Field, lines: Lines) -> np.ndarray:
    """1 for content."""
    return viterbi(field, field.scores(lines.features, lines.words, lines.bucket, lines.line_of), lines.text_of)


def viterbi(field: Field, scores: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The best labels of the lines of each text, all texts side by side."""
    if not len(scores):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(text_of)])))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    best, back = scores.copy(), np.zeros(scores.shape, np.int8)
    for t in range(1, int(sizes[0])):
        at = starts[: np.searchsorted(-sizes, -t)] + t
        reach = best[at - 1][:, :, None] + field.steps
        back[at] = reach.argmax(1)
        best[at] += reach.max(1)
    out = np.zeros(len(scores), np.int64)
    out[starts + sizes - 1] = best[starts + sizes - 1].argmax(1)
    for t in range(int(sizes[0]) - 1, 0, -1):
        at = starts[: np.searchsorted(-sizes, -t)] + t
        out[at - 1] = back[at, out[at]]
    return out


def marginals(s: np.ndarray, steps: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums over sequences (n, t, 2) side by side, on (n, t) where they have a line.

    (node marginals, edge marginals from a line to the next, log sums)
    """
    log_sum = lambda z, axis: np.logaddexp(np.take(z, 0, axis), np.take(z, 1, axis))
    a, b = s.copy(), np.zeros_like(s)
    for t in range(1, s.shape[1]):
        a[:, t] = np.where(on[:, t, None], s[:, t] + log_sum(a[:, t - 1, :, None] + steps, 1), a[:, t - 1])
    for t in range(s.shape[1] - 2, -1, -1):
        b[:, t] = np.where(on[:, t + 1, None], log_sum(steps + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
    z = log_sum(a[:, -1], 1)
    node = np.exp(a + b - z[:, None, None]) * on[:, :, None]
    edge = np.exp(a[:, :-1, :, None] + steps + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
    return node, edge, z


class Sequence(NamedTuple):
    """A text to learn from: features and label of each line, and its words' buckets with their lines."""

    features: np.ndarray
    label: np.ndarray
    bucket: np.ndarray
    line_of: np.ndarray


def fit(sequences: list[Sequence], rounds: int = 120) -> Field:
    """Maximum likelihood with small L2 terms, by Adam steps."""
    sequences = [q for q in sequences if len(q.label)]
    if len({int(y) for q in sequences for y in q.label}) < 2:
        weights = np.zeros((FEATURES, 2))
        weights[0, 1] = 1
        return Field(weights, np.zeros(BUCKETS), np.zeros((2, 2)))
    longest = max(len(q.label) for q in sequences)
    x = np.zeros((len(sequences), longest, FEATURES))
    y, on = np.zeros((len(sequences), longest), np.int64), np.zeros((len(sequences), longest), bool)
    for i, q in enumerate(sequences):
        k = len(q.label)
        x[i, :k], y[i, :k], on[i, :k] = q.features, q.label, True
    bucket = np.concatenate([q.bucket for q in sequences])
    line_of = np.concatenate([q.line_of + i * longest for i, q in enumerate(sequences)])
    size = len(sequences) * longest
    share = 1 / np.bincount(line_of, minlength=size)[line_of]
    gold = np.eye(2)[y] * on[:, :, None]
    gold_steps = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    total, cut = on.sum(), FEATURES * 2
    p = np.zeros(cut + BUCKETS + 4)
    penalty = np.concatenate((np.full(cut, 1e-4), np.full(BUCKETS, 2e-5), np.full(4, 1e-4)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for r in range(1, rounds + 1):
        weights, lexicon, steps = p[:cut].reshape(FEATURES, 2), p[cut:-4], p[-4:].reshape(2, 2)
        s = x @ weights
        s[:, :, 1] += np.bincount(line_of, lexicon[bucket] * share, size).reshape(s.shape[:2])
        node, edge, _ = marginals(s, steps, on)
        miss = gold - node
        by_word = np.bincount(bucket, miss[:, :, 1].ravel()[line_of] * share, BUCKETS)
        g = np.concatenate((np.einsum("ntf,ntl->fl", x, miss).ravel(), by_word, (gold_steps - edge.sum((0, 1))).ravel())) / total - penalty * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return Field(p[:cut].reshape(FEATURES, 2), p[cut:-4], p[-4:].reshape(2, 2))


def fit_field(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits on the sample; docs: (id, text)."""
    kinds = {"id": "long", "line": "long", "good": "long", "hash": "long", "features": "array<double>", "buckets": "array<long>"}
    schema = pa.schema([(c, {"long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}[k]) for c, k in kinds.items()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            words = words_of(texts)
            lines = lines_of(words, words.hashes(lower=False))
            number = np.arange(len(lines.text_of)) - np.searchsorted(lines.text_of, lines.text_of)
            some = np.flatnonzero(number < FIT_LINES)
            ends = np.cumsum(lines.words)
            buckets = [lines.bucket[a:b] for a, b in zip((ends - lines.words)[some].tolist(), ends[some].tolist(), strict=True)]
            of = lines.text_of[some]
            yield arrow_batch(schema, [batch.column(0).to_numpy()[of], number[some], batch.column(2).to_numpy()[of], lines.hash[some].view(np.int64), list(lines.features[some]), buckets])

    sample = labelled_sample(docs, labels, FIT_TEXTS).select("id", "text", F.col("quality").cast("long").alias("good"))
    rows = sample.mapInArrow(features, ", ".join(f"{c} {k}" for c, k in kinds.items())).toArrow().to_pandas().sort_values(["id", "line"], kind="stable")
    # Copies of a whole text have equal lines around each line, so they are one place of it.
    lines = rows.groupby("id")["hash"]
    with np.errstate(over="ignore"):
        place = lines.shift(1, fill_value=0).to_numpy() * 3 + lines.shift(-1, fill_value=1).to_numpy()
    places = rows.assign(place=place).groupby("hash")["place"].transform("nunique")
    content = (rows["good"] > 0) & (places < RECURRING) & np.array([f[10] == 0 for f in rows["features"]], bool)
    sequences = []
    for _, g in rows.assign(content=content.astype(np.int64)).groupby("id"):
        sizes = [len(b) for b in g["buckets"]]
        sequences.append(Sequence(np.stack(g["features"].to_list()), g["content"].to_numpy(), np.concatenate(g["buckets"].to_list()).astype(np.int64), np.repeat(np.arange(len(g)), sizes)))
    return fit(sequences)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_field(docs, labels))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]
    ddl = f"{id_col} long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in ddl.split(", ")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch, texts in text_chunks(batches, "text"):
            words = words_of(texts)
            h, k = words.hashes(lower=False), len(texts)
            n = np.diff(words.bounds)
            inside = np.zeros(len(words.raw) + 1, np.int64)
            np.add.at(inside, words.begin, 1)
            np.add.at(inside, words.end, -1)
            points = np.concatenate(([0], np.cumsum((np.cumsum(inside)[:-1] > 0) & ((words.raw & 0xC0) != 0x80))))
            symbols = np.concatenate(([0], np.cumsum(_CLASS[0][words.raw])))
            text_of = np.repeat(np.arange(k), n)
            lines = lines_of(words, h)
            content = np.bincount(lines.text_of, lines.words * label_lines(field, lines), k).astype(np.int64)
            repeat = np.bincount(text_of, repeated(h, text_of), k).astype(np.int64)
            failed = (n < 10) | (100 * repeat > 20 * n)
            over = lambda x: x[words.text_at[1:]] - x[words.text_at[:-1]]
            dup = np.bincount(lines.text_of, lines.features[:, 10], k).astype(np.int64)
            yield arrow_batch(schema, [batch.column(0), n, over(points), over(symbols), dup, repeat, content, failed, ~failed & (content >= CONTENT_SHARE * n)])

    out = docs.mapInArrow(judge, ddl)
    return out.select(id_col, *counts[:5], "base_failed", "content_words", "kept")


def repeated(h: np.ndarray, text_of: np.ndarray, n: int = 5) -> np.ndarray:
    """1 for the words that stand in an n-word window found twice or more in their text, else 0."""
    out = np.zeros(len(h) + 1, np.int64)
    g = ngrams(h, n)
    if len(g):
        whole = text_of[n - 1 :] == text_of[: len(g)]
        with np.errstate(over="ignore"):
            g = g ^ mix64((text_of[: len(g)] + 1).astype(np.uint64))
        found = np.sort(g[whole])
        found = found[1:][found[1:] == found[:-1]]
        if len(found):
            at = np.flatnonzero(whole & (found[np.minimum(np.searchsorted(found, g), len(found) - 1)] == g))
            np.add.at(out, at, 1)
            np.add.at(out, at + n, -1)
    return (np.cumsum(out)[:-1] > 0).astype(np.int64)


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
