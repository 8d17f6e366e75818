"""Helpers shared by the operators: hashed words in numpy, tables in the shared folder, skew-safe lookups, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the words of every contract are maximal runs of characters other than these bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
PIECE = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls; n is about PIECE at most."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _span_sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of spans that lie within a piece of memory-friendly size: the polynomials, by prefix sums."""
    lo, hi = int(begin.min()), int(end.max())
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(table[data[lo:hi]] * _power(_BASE, hi - lo), out=total[1:])
    return (total[end - lo] - total[begin - lo]) * _power(_BASE_INVERSE, hi - lo + 1)[begin - lo]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, a polynomial over scrambled bytes. Spans are in order and don't overlap.

    Spans are taken PIECE bytes at a time, and a longer span in parts, so the memory is bounded for texts of any length.
    """
    table = mix64(_TABLE + _U(seed)) if seed else _TABLE
    value, first = np.zeros(len(begin), np.uint64), 0
    with np.errstate(over="ignore"):
        while first < len(begin):
            last = max(int(np.searchsorted(end, begin[first] + PIECE, side="right")), first + 1)
            if end[last - 1] - begin[first] <= PIECE:
                value[first:last] = _span_sums(data, begin[first:last], end[first:last], table)
            else:
                for at in range(int(begin[first]), int(end[first]), PIECE):
                    part = np.array([at]), np.array([min(at + PIECE, int(end[first]))])
                    value[first] += _span_sums(data, *part, table)[0] * _U(pow(_BASE, at - int(begin[first]), 1 << 64))
            first = last
        return mix64(value + (end - begin).astype(np.uint64))


class Words(NamedTuple):
    """Words of several texts. bounds[i]:bounds[i+1] are the words of text i; begin and end are byte offsets in raw."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    text_at: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if asked."""
        return span_hashes(_LOWER[self.raw] if lower else self.raw, self.begin, self.end)


def words_of(texts: list[str | None]) -> Words:
    """Splits texts (null: empty) into words, all at once."""
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = ~_IS_SPACE[raw]
    step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        step = np.concatenate(([0], step))
    begin, end = step[0::2], step[1::2]
    text_at = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded]))).astype(np.int64)
    return Words(raw, begin, end, np.searchsorted(begin, text_at), text_at)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text (or of texts in a row: the caller leaves out those that cross a border)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = (out + h[j : len(h) - n + 1 + j]) * _U(0x9E3779B97F4A7C15 + 2 * j)
    return mix64(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of a text; of fewer words the whole sequence is one; none without words."""
    if not len(h):
        return h
    return np.unique(ngrams(h, n)) if len(h) >= n else ngrams(h, len(h))


def digest(values: np.ndarray) -> int:
    """A 64-bit signed hash of a sorted array."""
    with np.errstate(over="ignore"):
        total = np.sum(mix64(values + _U(len(values))) * (values | _U(1)))
    return int(mix64(np.array([total + _U(len(values))], np.uint64)).view(np.int64)[0])


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def release() -> None:
    """Gives memory that is no longer used back to the machine: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that each holds about limit characters of text: bounds the numpy arrays made from one. At the end
    of a task what they took is released."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= limit:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0
        if first < len(texts):
            yield batch.slice(first), texts[first:]
    batch = texts = None
    release()


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where that is unset, one of our own, on one machine only."""
    small_batches(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: dict[int, str] = {}


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns it read back: cuts the lineage, and lost executors lose nothing.

    What the write shuffled is deleted when it is done, as nothing reads it again.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/curatrix/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of save() that nothing reads any more; what was made of them must be saved."""
    for table in tables:
        path = _paths.get(id(table))
        if path:
            store, at = fs.FileSystem.from_uri(path)
            store.delete_dir(at)


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions as the session sets them: the cluster sizes that to its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """left with the columns of right (unique on key, weight: how often left has the key), null where right has none.

    Keys that hold over 1/share of all rows are fewer than share, so they are broadcast; the others can't be hot and are
    shuffled. left is read twice: save it first.
    """
    bound = max(total // share, 100)
    hot = F.broadcast(right.where(F.col(weight) > bound).withColumn("_hot", F.lit(True)))
    marked = left.join(hot, key, "left")
    names = [c for c in right.columns if c != key]
    first = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").drop("_hot", *names).join(right.where(F.col(weight) <= bound), key, "left")
    return first.unionByName(rest.select(first.columns))


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CONTRACT, _FEW = 1 << 20, 1 << 17


def _stars_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), about _CONTRACT at a time, as stars: each end with the smallest that it reaches by these edges."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate(held), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(ids))
        while True:
            p, q = label[a], label[b]
            if (p == q).all():
                break
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
        up = np.flatnonzero(label != np.arange(len(ids)))
        return arrow_batch(EDGES, [ids[up], ids[label[up]]])

    for batch in batches:
        held.append(np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()), 1).ravel())
        if sum(map(len, held)) > 2 * _CONTRACT:
            yield stars()
            held = []
    if held:
        yield stars()
    held, batch = [], None
    release()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all ends of edges (a, b long): component is the smallest id that can be reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until only stars are left; edges are contracted
    within tasks first, every round is saved, and hubs are looked up apart, so that none of them is one task's work. Once
    no more edges are left than a task contracts at a time (_FEW), one does.
    """
    e = save(edges.where("a <> b").mapInArrow(_stars_within, "a long, b long").distinct(), "edges")
    for _ in range(rounds):
        if e.count() <= _FEW:
            stars = save(e.coalesce(1).mapInArrow(_stars_within, "a long, b long"), "edge-stars")
            discard(e)
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        ends = e.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(0).alias("up")))
        ends = save(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.count("*").alias("n"), F.sum("up").alias("up")), "edge-ends")
        # Stars only: whatever is an upper end is one once, and is no lower end.
        total, open_ends = ends.agg(F.sum("n"), F.coalesce(F.sum(((F.col("up") > 0) & (F.col("n") > 1)).cast("int")), F.lit(0))).first()
        if not open_ends:
            discard(e)
            return ends.select(F.col("x").alias("id"), F.col("m").alias("component"))
        least = ends.select(F.col("x").alias("b"), "m", "n")
        large = save(lookup(e, least, "b", "n", total // 2).select("a", F.col("m").alias("b")).where("a <> b").distinct(), "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        both = lookup(large, least, "a", "n", total // 2).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = save(both.where("a <> b").mapInArrow(_stars_within, "a long, b long").distinct(), "edges")
        discard(e, ends, large)
        e = new
    raise RuntimeError(f"components not found in {rounds} rounds")


def with_marks(rows: DataFrame, doc_id: str, text: str, marks: DataFrame) -> DataFrame:
    """rows with the columns of marks (saved; one row for each _id and _hash, the xxhash64 of a text), null without one.

    Rows that a filter says have no mark stay where they are; only the others move to be joined.
    """
    sent = rows.sparkSession.sparkContext.broadcast(Membership(marks.select(F.xxhash64("_id", "_hash").alias("key")), "key"))

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(sent.value.may_hold(key.to_numpy(np.int64)))

    own_id, own_hash = F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))
    rows = rows.withColumn("_may", may(F.xxhash64(own_id, own_hash)))
    moved = rows.where("_may").join(marks, own_id.eqNullSafe(F.col("_id")) & (own_hash == F.col("_hash")), "left")
    return moved.unionByName(rows.where("NOT _may"), allowMissingColumns=True).drop("_may", "_id", "_hash")


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts that go to Python are of few rows, so that long texts don't fill the executors' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def free_names(columns: list[str], *names: str) -> list[str]:
    """names, each with as many '_' after it as keeps it apart from the columns, whose case doesn't count."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(id, text, quality, toxic) of at most `limit` labelled ids, those first by a hash of the id, one row each.

    docs: (id, text). The ids are broadcast, as `limit` bounds them. Ids labelled more than once take the lowest quality and
    highest toxicity; of rows that share an id the least text counts.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    some = one.orderBy(F.xxhash64("id"), "id").limit(limit)
    return docs.join(F.broadcast(some), "id").groupBy("id", "quality", "toxic").agg(F.min("text").alias("text")).select("id", "text", "quality", "toxic")


class Membership:
    """A Bloom filter over scrambled 64-bit keys, to send to tasks: 16 bits a key, 2**MOST words (32 MB) at most.

    False hits, rare up to some 10 million keys, are for a join to remove.
    """

    LEAST, MOST = 12, 22

    def __init__(self, keys: DataFrame, key: str):
        """Built by aggregation: what comes back is a row for each word at most, whatever the number of keys."""
        log = int(min(max(self.LEAST, (keys.count() // 4).bit_length()), self.MOST))
        schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, bit = (np.concatenate(x) for x in zip(*_probes(batch.column(0).to_numpy(), log), strict=True))
                yield arrow_batch(schema, [word, (_U(1) << bit).view(np.int64)])

        rows = keys.select(F.col(key).cast("long").alias("key")).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.log, self.bits = log, np.zeros(1 << log, np.int64)
        self.bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy()

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For signed 64-bit keys."""
        found = np.ones(len(keys), bool)
        for word, bit in _probes(keys, self.log):
            found &= (self.bits.view(np.uint64)[word] >> bit & _U(1)).astype(bool)
        return found


def _probes(keys: np.ndarray, log: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words and bits of keys in a filter of 2**log words."""
    for probe in range(3):
        h = mix64(keys.view(np.uint64) ^ mix64(np.array([0x70726F62 + probe], np.uint64)))
        yield (h & _U((1 << log) - 1)).astype(np.int64), h >> _U(58)
