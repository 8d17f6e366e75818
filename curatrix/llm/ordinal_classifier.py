"""Operator 4: ordinal cumulative-link regression on graded ratings over hashed text.

Grades: 0 for poor quality, 1 for good quality that is toxic, 2 for good quality that isn't. One weight for each hashed
feature is shared by all grades, and ordered thresholds cut the score: P(grade <= k) = 1 / (1 + exp(score - threshold k)).
Features are a text's distinct lower-cased words, the shapes of its words by share, and how much it repeats itself, each a
bucket of 2**HASH_BITS. The fit is by likelihood with an L1 term on at most FIT_TEXTS labelled texts; words in fewer than
MIN_TEXTS of them get no weight. All texts are scored whole; the expected grade and the tail probability of the top grade
are given, and a text is kept if the latter is at least MIN_TOP.

Cases: null and empty texts have no words but their shape features. Without labelled rows of at least two grades all texts
are kept with expected grade 2. Repeated rows are scored each; null ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, free_names, labelled_sample, mix64, ngrams, read, text_chunks, words_of

FIT_TEXTS, MIN_TEXTS, HASH_BITS, MIN_TOP = 6000, 4, 24, 0.5
_MASK = np.uint64((1 << HASH_BITS) - 1)
_SHAPE = np.zeros(256, np.uint8)  # bits: lower case or other letters, upper case, digits, plain marks, other marks
for _bit, _bytes in enumerate(([*range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), b".,;:'-", b"!?#*$%&|<>=_/\\@+~^()[]{}\"`")):
    _SHAPE[list(_bytes)] = 1 << _bit


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all features of the texts, sorted, each once."""
    words = words_of(texts)
    h, k, n = words.hashes(), len(texts), np.diff(words.bounds)
    text = np.repeat(np.arange(k), n)
    shape = np.bitwise_or.reduceat(_SHAPE[words.raw], words.begin) if len(h) else np.zeros(0, np.uint8)
    if len(h):  # reduceat runs on to the next word; what lies between is space, which has no bits
        shape[-1] = np.bitwise_or.reduce(_SHAPE[words.raw[words.begin[-1] : words.end[-1]]])
    rates = [np.bincount(text, (shape & 31) == s, k) for s in range(32)]
    pair = ngrams(h, 2)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    inner = np.unique(np.stack((text[: len(pair)], pair.view(np.int64)), 1)[text[1:] == text[: len(pair)]], axis=0) if len(pair) else np.zeros((0, 2), np.int64)
    rates += [np.bincount(text, same, k), np.maximum(n - 1, 0) - np.bincount(inner[:, 0], minlength=k)]
    made = [np.stack((text.astype(np.uint64), h & _MASK), 1)]
    for number, rate in enumerate(rates):
        level = np.where(rate > 0, 1 + np.minimum(np.floor(8 * rate / np.maximum(n, 1)), 7), 0).astype(np.uint64)
        bucket = mix64(np.uint64(0x5348415045000000) + np.uint64(number << 8) + level) & _MASK
        made.append(np.stack((np.arange(k, dtype=np.uint64), bucket), 1)[level > 0])
    code = np.concatenate([m[:, 0] << np.uint64(HASH_BITS) | m[:, 1] for m in made])
    code = np.unique(code)
    return (code >> np.uint64(HASH_BITS)).astype(np.int64), (code & _MASK).astype(np.int64)


class Model(NamedTuple):
    """Sorted buckets that have a weight, and the thresholds."""

    bucket: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def scores(self, text: np.ndarray, bucket: np.ndarray, k: int) -> np.ndarray:
        if not len(self.bucket):
            return np.zeros(k)
        at = np.minimum(np.searchsorted(self.bucket, bucket), len(self.bucket) - 1)
        return np.bincount(text, np.where(self.bucket[at] == bucket, self.weight[at], 0), k)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def fit(text: np.ndarray, bucket: np.ndarray, grade: np.ndarray, rounds: int = 300, l1: float = 2e-4) -> Model:
    """Proximal gradient with momentum on the mean log likelihood; text numbers index grade."""
    present = np.unique(grade)
    if len(present) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([-20.0, -20.0]))
    names, column, seen = np.unique(bucket, return_inverse=True, return_counts=True)
    some = seen[column] >= MIN_TEXTS
    text, column = text[some], column[some]
    n, width = len(grade), len(names)
    w, theta = np.zeros(width), np.array([-1.0, 1.0])
    wm, tm, t = w, theta, 1.0
    rate = 4.0 / max(1.0, np.sqrt(np.bincount(text, minlength=n).mean()))
    scale = rate / np.sqrt(np.maximum(seen / n, 1e-3)) / np.sqrt(np.bincount(text, minlength=n).mean())
    class_weight = (n / (len(present) * np.maximum(np.bincount(grade, minlength=3), 1)))[grade] ** 0.5
    lower, upper = np.arange(-1, 2)[grade], np.arange(0, 3)[grade]
    for _ in range(rounds):
        s = np.bincount(text, wm[column], n)
        cut = np.concatenate(([-np.inf], tm, [np.inf]))
        a, b = 1 / (1 + np.exp(-np.clip(cut[upper + 1] - s, -500, 500))), 1 / (1 + np.exp(-np.clip(cut[lower + 1] - s, -500, 500)))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) * class_weight / p, b * (1 - b) * class_weight / p
        ds = -(da - db)
        dt = np.array([da[upper == k].sum() - db[lower == k].sum() for k in (0, 1)]) / n
        step = wm + scale * np.bincount(column, ds[text], width) / n
        new = np.sign(step) * np.maximum(np.abs(step) - scale * l1, 0)
        now = tm + 0.5 * dt
        now[1] = max(now[1], now[0] + 1e-3)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wm, tm, w, theta, t = new + (t - 1) / after * (new - w), now + (t - 1) / after * (now - theta), new, now, after
        tm[1] = max(tm[1], tm[0] + 1e-3)
        if ((wm - w) * (w - new)).sum() > 0:
            t = 1.0
    on = np.flatnonzero(w)
    return Model(names[on], w[on], theta)


def fit_model(docs: DataFrame, labels: DataFrame, limit: int = FIT_TEXTS) -> Model:
    """Fits on the sample; docs: (id, text)."""
    schema = pa.schema([("grade", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            text, bucket = features_of(texts)
            yield arrow_batch(schema, [batch.column(2), np.split(bucket, np.searchsorted(text, np.arange(1, len(texts))))])

    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2).cast("long").alias("grade")
    rows = labelled_sample(docs, labels, limit).select("id", "text", grade).orderBy(F.xxhash64("id"), "id").mapInArrow(buckets, "grade long, buckets array<long>").toArrow().to_pandas()
    if not len(rows):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = [len(b) for b in rows["buckets"]]
    return fit(np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["buckets"].to_list()).astype(np.int64), rows["grade"].to_numpy(np.int64))


def _graded(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, its columns named c0, c1, ..., with the grades."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_model(ids, labels))
    schema = pa.schema([("p_good", pa.float64()), ("p_top", pa.float64())])
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, inner[at]):
            tails = sent.value.tails(sent.value.scores(*features_of(texts), len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails[:, 0]), pa.array(tails[:, 1])], names=[*inner, *schema.names])

    renamed = docs.toDF(*inner)
    made = renamed.mapInArrow(grade, ", ".join(f"{c} {t}" for c, t in renamed.dtypes) + ", p_good double, p_top double")
    return made.select(*inner, (F.col("p_good") + F.col("p_top")).alias("expected_grade"), "p_good", "p_top", (F.col("p_top") >= MIN_TOP).alias("kept"))


def grade_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with expected_grade, p_good (P(grade >= 1)), p_top (P(grade >= 2)) and kept; of these, names that docs have get
    a '_'. Nothing is shuffled. Very long texts are graded whole, a batch of rows at a time."""
    return _graded(docs, labels, id_col, text_col).toDF(*docs.columns, *free_names(docs.columns, "expected_grade", "p_good", "p_top", "kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that are kept."""
    graded = _graded(docs, labels, "doc_id", "text").where("kept")
    return graded.select(*graded.columns[: len(docs.columns)]).toDF(*docs.columns)


def op4_ordinal_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_documents(docs, read(spark, sf_dir, "labels")).drop("text")
