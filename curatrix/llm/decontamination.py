"""Operator 6: benchmark decontamination by SimHash windows of the items' sizes.

A window of as many words as an item is a leak of it if their weighted five-word shingles have a similarity (sum of
weighted minima over sum of weighted maxima) of at least `similarity`. Windows get 64-bit weighted SimHashes; a
multi-index over 8-bit blocks, probed within one bit of each block, finds every item fingerprint within RADIUS (15 bits
over 8 blocks leave some block with at most one), and exact similarity verifies what it finds. Only windows that share a
shingle with an item are looked at, as no other can be similar at all.

A shingle's weight is log(1 + items / items that hold it), counted over the whole benchmark; one that a single item holds
weighs as much as an unknown one, so only those of several items are listed (16 bytes each), and sent to the tasks once.
The benchmark is a stated query set: it is read in blocks of ITEMS_A_BLOCK items, each sent to the tasks in turn, with the
same results for any size of block; documents are never shuffled.

Cases: null and empty texts and texts shorter than any item have no leaks. Items without at least five words (or null)
are too short to tell and are left out. Repeated rows are each reported; null ids are reported as null. Of several
windows for an item in one text the most similar, then the first, is reported. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, mix64, ngrams, read, text_chunks, words_of

_U = np.uint64
WORDS, SIMILARITY, RADIUS, ITEMS_A_BLOCK = 5, 0.8, 15, 20_000
_BITS = _U(1) << np.arange(64, dtype=_U)
_FILTER = 1 << 22


def simhash(shingles: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of `width` shingles: the signs of the weighted sums of their bits."""
    signs = np.where(shingles[:, None] & _BITS, weights[:, None], -weights[:, None])
    total = np.concatenate((np.zeros((1, 64)), np.cumsum(signs, 0)))
    return ((total[width:] - total[:-width] > 1e-9) * _BITS).sum(1, dtype=_U)


class Weights:
    """Weights of shingles by the whole benchmark. keys: sorted, those that several items hold, and how many do."""

    def __init__(self, items: int, keys: np.ndarray, holders: np.ndarray):
        self.keys, self.weight, self.unknown = keys, np.log1p(items / holders), float(np.log1p(items))

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(shingles), self.unknown)
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return np.where(self.keys[at] == shingles, self.weight[at], self.unknown)


def item_shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text its shingles in order; none of those too short to tell."""
    words = words_of(texts)
    h = words.hashes()
    return [ngrams(h[a:b], WORDS) for a, b in zip(words.bounds, words.bounds[1:], strict=False)]


def benchmark_weights(benchmark: DataFrame, text_col: str) -> Weights:
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, "text"):
            sets = [np.unique(g) for g in item_shingles(texts) if len(g)]
            if sets:
                keys, n = np.unique(np.concatenate(sets), return_counts=True)
                yield arrow_batch(schema, [[None, *keys.view(np.int64).tolist()], [len(sets), *n.tolist()]])  # null: the items

    counts = benchmark.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.where("shingle IS NULL OR n > 1").toArrow()
    shingles, n = found.column(0), found.column(1).to_numpy()
    none = shingles.is_null().to_numpy()
    keys, holders = shingles.fill_null(0).to_numpy()[~none].view(_U), n[~none]
    order = np.argsort(keys)
    return Weights(int(n[none].sum()), keys[order], holders[order])


class Benchmark:
    """A block of items, indexed. Weights are of these items alone where none are given; they aren't pickled."""

    def __init__(self, items: list[tuple[int, str]], by: Weights | None = None):
        self.ids, self.shingles = [], []
        for (i, _), g in zip(items, item_shingles([t for _, t in items]), strict=True):
            if len(g):
                self.ids.append(i)
                self.shingles.append(g)
        holders = Counter(int(g) for s in self.shingles for g in np.unique(s))
        self.known = np.array(sorted(holders), _U)
        self.by = by or Weights(len(self.ids), self.known, np.array([holders[int(g)] for g in self.known]))
        self.filter = np.zeros(_FILTER, bool)
        self.filter[(self.known % _U(_FILTER)).astype(np.int64)] = True
        self.sizes: dict[int, set[int]] = defaultdict(set)  # shingle -> sizes of the items that hold it
        self.blocks: dict[tuple[int, int, int], list[int]] = defaultdict(list)  # (size, block, value) -> items
        self.print: list[int] = []
        for n, s in enumerate(self.shingles):
            self.print.append(int(simhash(mix64(s), self.by.of(s), len(s))[0]))
            for g in s:
                self.sizes[int(g)].add(len(s))
            for block in range(8):
                self.blocks[len(s), block, self.print[-1] >> 8 * block & 255].append(n)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"by": None}

    def weighed(self, by: Weights) -> Benchmark:
        self.by = by
        return self

    def within(self, size: int, fingerprint: int) -> list[tuple[int, int]]:
        """(item, distance) of all items of that size within RADIUS."""
        found = set()
        for block in range(8):
            value = fingerprint >> 8 * block & 255
            for probe in (value, *(value ^ 1 << bit for bit in range(8))):
                found.update(self.blocks.get((size, block, probe), ()))
        return [(n, d) for n in sorted(found) if (d := (self.print[n] ^ fingerprint).bit_count()) <= RADIUS]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        x, y = Counter(a.tolist()), Counter(b.tolist())
        every = np.array(sorted(x.keys() | y.keys()), _U)
        w = self.by.of(every)
        p, q = (np.array([c[int(g)] for g in every]) for c in (x, y))
        return float((w * np.minimum(p, q)).sum() / (w * np.maximum(p, q)).sum())

    def leaks(self, shingles: np.ndarray, hits: np.ndarray, similarity: float) -> list[tuple]:
        """(item id, first word, words, distance, similarity) for the shingles of one text; hits: where some item has them."""
        starts: dict[int, set[int]] = defaultdict(set)
        for at in hits.tolist():
            for size in self.sizes.get(int(shingles[at]), ()):
                starts[size].update(range(max(0, at - size + 1), min(at, len(shingles) - size) + 1))
        best: dict[int, tuple] = {}
        for size, at in starts.items():
            at = np.array(sorted(at), np.int64)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if not len(run):
                    continue
                part = shingles[run[0] : run[-1] + size]
                for first, fingerprint in zip(run.tolist(), simhash(mix64(part), self.by.of(part), size).tolist(), strict=True):
                    for n, distance in self.within(size, fingerprint):
                        how = self.similarity(shingles[first : first + size], self.shingles[n])
                        if how >= similarity - 1e-12 and (n not in best or how > best[n][4]):
                            best[n] = (self.ids[n], first, size + WORDS - 1, distance, how)
        return [best[n] for n in sorted(best)]

    def of_texts(self, texts: list[str | None], similarity: float) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        words = words_of(texts)
        g = ngrams(words.hashes(), WORDS)
        hits = np.flatnonzero(self.filter[(g % _U(_FILTER)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, g[hits]), len(self.known) - 1)
        hits = hits[self.known[at] == g[hits]]
        text = np.searchsorted(words.bounds, hits, side="right") - 1
        whole = hits + WORDS <= words.bounds[text + 1]  # not across a border
        hits, text = hits[whole], text[whole]
        for i in np.unique(text).tolist():
            a, b = words.bounds[i], words.bounds[i + 1]
            out[i] = self.leaks(g[a : b - WORDS + 1], hits[text == i] - a, similarity)
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Callable[[], Benchmark]]:
    """For each block, what gives it within a task."""
    context, by = benchmark.sparkSession.sparkContext, benchmark_weights(benchmark, text_col)
    sent_by = context.broadcast(by)

    def sent(block: list[tuple]) -> Callable[[], Benchmark]:
        items = context.broadcast(Benchmark(block, by))
        return lambda: items.value.weighed(sent_by.value)

    block = []
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(item_col).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_A_BLOCK:
            yield sent(block)
            block = []
    if block:
        yield sent(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, start_word, n_words, distance, similarity): the best window of each text for each item that leaks into it."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"{id_col} long, {item_col} long, start_word long, n_words long, distance long, similarity double"
    schema = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in ddl.split(", ")])

    def with_block(block: Callable[[], Benchmark]) -> DataFrame:
        def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block()
            for batch, texts in text_chunks(batches, "text"):
                found = [(i, *x) for i, leaks in zip(batch.column(0).to_pylist(), items.of_texts(texts, similarity), strict=True) for x in leaks]
                if found:
                    yield arrow_batch(schema, [list(c) for c in zip(*found, strict=True)])

        return rows.mapInArrow(leaks, ddl)

    parts = [with_block(b) for b in _blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, that hold no leak. Nothing is shuffled."""
    for block in _blocks(benchmark, "item_id", "text"):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block()
            for batch, texts in text_chunks(batches, "text"):
                yield batch.filter(pa.array([not x for x in items.of_texts(texts, similarity)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
