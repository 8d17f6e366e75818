"""Operator 2: language-model scoring by a probabilistic suffix tree over words.

A context is a run of words. It is tried if it occurs LEAST times in the training texts, the context without its first word
is retained, and the one without its last word was tried; single words are tried first. It is retained if its next-word
distribution differs from its parent's (the context without its first word): occurrences times divergence of at least
DIVERGENCE nats. Contexts get longer until none is retained, or up to DEPTH words. A distribution keeps the next words seen
LEAST times, by count; its other mass, with ALPHA pseudo-counts, goes to the parent's distribution, and at the root to
(c + 0.5) / (N + 0.5 * (V + 1)). So every distribution sums to one over all words and one unknown word. A token is scored in
the state of the longest retained suffix of what stands before it in its text.

The thresholds are counts, so the tree grows with the corpus. It is a table and never as a whole in one place: log10 of a
token's probability is a sum over the runs of words that end in it. A context adds its back-off (the share of its parent),
a next word that it keeps adds log10 of its probability over the backed-off one, and the root adds the word's own. So a text
is scored by looking up its runs in a table of sums. Runs above SHARE of all tokens (1/SHARE at most of a length) are sent to
the tasks; rarer ones that a Bloom filter may hold move to the task that has the table's part for the slot of their key. Runs
are counted by slots as well. They move as packed numbers, a row for each slot, so that none is a row of its own.

Cases: a null text is empty and holds the end token alone; null ids are trained on; repeated rows count and are scored
each; very long texts are cut at no point, only tables of runs grow. Without training texts N and V are 0 and every token is
unknown. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Membership, arrow_batch, discard, mix64, partitions_for, read, release, save, text_chunks, words_of

LEAST, DIVERGENCE, ALPHA, DEPTH, SHARE = 3, 4.0, 1.0, 5, 2e-7
END = np.uint64(0x656E64206F662074)  # stands for the end of a text
ALONE = 0x616C6F6E65  # the suffix that stands for none
_BUFFER, _BATCH = 3_000_000, 1 << 22
_LONG = pa.int64()


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in a row, and the number of each one's text."""
    words = words_of(texts)
    sizes = np.diff(words.bounds) + 1
    last = np.cumsum(sizes) - 1
    h = np.empty(int(sizes.sum()), np.uint64)
    inside = np.ones(len(h), bool)
    inside[last] = False
    h[inside], h[last] = words.hashes(), END
    return h, np.repeat(np.arange(len(texts)), sizes)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n tokens: of longer ones made of those of their first and last n - 1."""
    key = h.view(np.int64)
    for _ in range(n - 1):
        key = run_keys(key[:-1], key[1:])
    return key


def run_keys(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(suffix.view(np.uint64))).view(np.int64)


def slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each key, one of `slots` ranges of the keys taken as unsigned: keys in order have slots in order."""
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int32)


def packed(schema: pa.Schema, slot: np.ndarray, arrays: list[np.ndarray], more: tuple = ()) -> Iterator[pa.RecordBatch]:
    """A row (slot, data, more, nulls) for each slot, with its part of the arrays: many numbers move as a row. Slots are in order."""
    ends = np.append(np.flatnonzero(slot[1:] != slot[:-1]) + 1, len(slot)) if len(slot) else []
    rows, size, begin = [], 0, 0
    for end in ends:
        rows.append((int(slot[begin]), b"".join(x[begin:end].tobytes() for x in arrays)))
        size, begin = size + len(rows[-1][1]), end
        if size > _BATCH or end == len(slot):
            fixed = [pa.array([x] * len(rows), f.type) for x, f in zip(more, list(schema)[2:], strict=False)]
            nulls = [pa.nulls(len(rows), f.type) for f in list(schema)[2 + len(more) :]]
            yield arrow_batch(schema, [*(list(x) for x in zip(*rows, strict=True)), *fixed, *nulls])
            rows, size = [], 0


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


_PACKED = pa.schema([("slot", pa.int32()), ("data", pa.binary())])


class Sieve:
    """A filter like Membership, as large, with three bits of one word for each key; these move packed, and each slice of the
    words is made by a task."""

    def __init__(self, keys: DataFrame, key: str):
        log = int(min(max(Membership.LEAST, (keys.count() // 4).bit_length()), Membership.MOST))
        few = min((partitions_for(keys) - 1).bit_length(), log)

        make = Sieve._word_and_bits

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, bits = make(batch.column(0).to_numpy(), log)
                order = np.argsort(word)
                yield from packed(_PACKED, word[order] >> (log - few), [bits[order], word[order].astype(np.int32)])

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    mask, word = unpacked(data.as_buffer(), "u8", "i4")
                    own = bits.setdefault(slot, np.zeros(1 << (log - few), np.uint64))
                    np.bitwise_or.at(own, word - (slot << (log - few)), mask)
            for slot, own in bits.items():
                yield arrow_batch(_PACKED, [[slot], [own.tobytes()]])
            release()

        ddl = "slot int, data binary"
        rows = keys.select(F.col(key).cast("long").alias("key")).mapInArrow(probes, ddl)
        rows = rows.repartitionById(1 << few, F.col("slot")).mapInArrow(slices, ddl).toArrow()
        self.log, self.bits = log, np.zeros(1 << log, np.uint64)
        for slot, data in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            self.bits[slot << (log - few) : (slot + 1) << (log - few)] = np.frombuffer(data.as_buffer(), np.uint64)

    @staticmethod
    def _word_and_bits(keys: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
        h, one, last = mix64(keys.view(np.uint64) ^ np.uint64(0x7369657665)), np.uint64(1), np.uint64(63)
        bits = one << (h >> np.uint64(58)) | one << (h >> np.uint64(52) & last) | one << (h >> np.uint64(46) & last)
        return (h & np.uint64((1 << log) - 1)).astype(np.int64), bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For signed 64-bit keys."""
        word, bits = self._word_and_bits(keys, self.log)
        return self.bits[word] & bits == bits


def token_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """tokens_of() the column text, or what stretches() has kept of them."""
    first = next(batches, None)
    if first is None:
        return
    batches = itertools.chain((first,), batches)
    if "text" in first.schema.names:
        for _, texts in text_chunks(batches, "text"):
            yield tokens_of(texts)
        return
    for batch in batches:
        for tokens, sizes in zip(batch.column(0), batch.column(1), strict=True):
            sizes = np.frombuffer(sizes.as_buffer(), np.int32)
            yield np.frombuffer(tokens.as_buffer(), np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    release()


def places(h: np.ndarray, text: np.ndarray, n: int, tried: Membership | Sieve, known: Membership | Sieve) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of n tokens, and where runs of n + 1 begin whose first n may be tried and last n known."""
    short = runs(h, n)
    at = np.flatnonzero(text[n:] == text[:-n])
    at = at[tried.may_hold(short[at])]
    return short, at[known.may_hold(short[at + 1])]


def stretches(docs: DataFrame, tried: Sieve, known: Sieve) -> DataFrame:
    """(tokens, sizes) of the stretches of the texts in which a run of three tokens or more may be counted."""
    schema = pa.schema([("tokens", pa.binary()), ("sizes", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast((tried, known))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, text in token_arrays(batches):
            if len(h) <= 2:
                continue
            _, at = places(h, text, 2, *sent.value)
            kept = np.zeros(len(h), bool)
            for i in range(3):
                kept[at + i] = True
            at = np.flatnonzero(kept)
            if len(at):
                begin = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(text[at]) > 0))))
                yield arrow_batch(schema, [[h[at].tobytes()], [np.diff(np.append(begin, len(at))).astype(np.int32).tobytes()]])

    return docs.select("text").mapInArrow(keep, "tokens binary, sizes binary")


def summed(prefix: np.ndarray, suffix: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, prefix, suffix, c) of each distinct run, in order of its unsigned key; c: how often, once if None."""
    key = run_keys(prefix, suffix)
    order = np.argsort(key.view(np.uint64))
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key))) if c is None or not len(key) else np.add.reduceat(c[order], begin)
    at = order[begin]
    return key[begin], prefix[at], suffix[at], times.astype(np.int64)


def counted_runs(docs: DataFrame, n: int, tried: Membership | Sieve | None = None, known: Membership | Sieve | None = None, words: bool = False) -> DataFrame:
    """(key, prefix, suffix, c) of runs of n + 1 tokens seen LEAST times whose first n may be tried and last n known.

    Prefix and suffix say which run it is, so the many that are seen too seldom move without a key. They move packed, are
    summed by the task that has all of a slot, and leave it if they reach LEAST. A task with more of them than it holds
    passes on what it has summed so far, for the aggregation after it. docs: texts, or stretches of them. With words, all
    single tokens are counted too, as runs with the suffix ALONE.
    """
    schema = pa.schema([(c, _LONG) for c in ("key", "prefix", "suffix", "c")])
    moved = pa.schema([schema.field(c) for c in ("prefix", "suffix", "c")])
    slots, sent = partitions_for(docs), docs.sparkSession.sparkContext.broadcast((tried, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried, known = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        single: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if single:
                word, c = np.unique(np.concatenate(single), return_counts=True)
                single.clear()
                yield from pack(*summed(word, np.full(len(word), ALONE), c))
            if held:
                runs_held = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                yield from pack(*summed(*runs_held))

        def pack(key: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from packed(_PACKED, slot_of(key, slots), [prefix, suffix, c.astype(np.int32)])

        for h, text in token_arrays(batches):
            if words:
                single.append(h.view(np.int64))
            if len(h) <= n:
                continue
            if tried is None:
                short, at = runs(h, n), np.flatnonzero(text[n:] == text[:-n])
            else:
                short, at = places(h, text, n, tried, known)
            held.append((short[at], short[at + 1]))
            if sum(len(x[0]) for x in held) > _BUFFER:
                yield from flush()
        yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, True
        for batch in batches:
            for data in batch.column(1):
                held.append(unpacked(data.as_buffer(), "i8", "i8", "i4"))
                size += len(held[-1][0])
                if size > 2 * _BUFFER:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))[1:]]
                    size = len(held[0][0])
                    if size > _BUFFER:
                        yield from in_batches(moved, held[0])
                        held, size, whole = [], 0, False
        if held:
            out = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))[1:]
            if whole:
                enough = (out[2] >= LEAST) | (out[1] == ALONE)
                out = [x[enough] for x in out]
            yield from in_batches(moved, out)
        held = out = None
        release()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_batch(schema, [run_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy()), *batch.columns])

    columns = [c for c in ("text", "tokens", "sizes") if c in docs.columns]
    rows = docs.select(*columns).mapInArrow(count, "slot int, data binary").repartitionById(slots, F.col("slot"))
    rows = rows.mapInArrow(total, "prefix long, suffix long, c long").groupBy("prefix", "suffix").agg(F.sum("c").alias("c"))
    return rows.where((F.col("c") >= LEAST) | (F.col("suffix") == ALONE)).mapInArrow(keyed, "key long, prefix long, suffix long, c long")


def in_batches(schema: pa.Schema, columns: list[np.ndarray], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), size):
        yield arrow_batch(schema, [x[at : at + size] for x in columns])


def words_among(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("suffix") == ALONE).select(F.col("prefix").alias("key"), "c")


def counted_words(docs: DataFrame) -> DataFrame:
    """(key, c) of all tokens."""
    return words_among(counted_runs(docs, 1, words=True))


def fit(docs: DataFrame) -> tuple[int, int, list[DataFrame]]:
    """N, V and, for runs of 1, 2, ... tokens, tables (key, c, base, value) of the training rows (columns text, held_out).

    base and value are what a run adds to log10 of a text's probability at the root and in the tree, over unknown words.
    """
    training = docs.where("NOT held_out")
    pieces, first = training, save(counted_runs(training, 1, words=True), "lm-first")
    words = words_among(first)
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    more = F.log10((F.col("c") + 0.5) / 0.5)
    root = (F.col("c") + 0.5) / (n + 0.5 * (v + 1))
    known = words.where(F.col("c") >= LEAST).select("key", "c", root.alias("p"))
    tried, levels, used = known.select("key", "c"), [], [first]
    rows = first.where(F.col("suffix") != ALONE)
    adds = words.select("key", "c", more.alias("base"), more.alias("value"), F.lit(True).alias("kept"))
    for length in range(1, DEPTH + 1):
        if length > 1:
            sieves = Sieve(tried, "key"), Sieve(known, "key")
            if length == 2:
                pieces = save(stretches(training, *sieves), "lm-stretches")
                used.append(pieces)
            rows = save(counted_runs(pieces, length, *sieves), "lm-runs")
        if rows.isEmpty():
            discard(rows)
            break
        # What the parent gives to the same word, then what the context itself gives to it.
        context = rows.groupBy("prefix").agg(F.sum("c").alias("kept")).join(tried.select(F.col("key").alias("prefix"), F.col("c").alias("n")), "prefix")
        back = (F.col("n") - F.col("kept") + ALPHA) / (F.col("n") + ALPHA)
        own = F.col("c") / (F.col("n") + ALPHA) + F.col("back") * F.col("q")
        rows_p = rows.join(context.select("prefix", "n", back.alias("back")), "prefix").join(known.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
        rows_p = save(rows_p.withColumn("p", own), "lm-own")
        sums = rows_p.groupBy("prefix").agg(
            F.first("n").alias("n"), F.first("back").alias("back"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("d")
        )
        rest_p, rest_q = F.greatest(1 - F.col("p"), F.lit(1e-12)), F.greatest(1 - F.col("q"), F.lit(1e-12))
        differs = F.col("n") * (F.col("d") + rest_p * F.ln(rest_p / rest_q)) >= DIVERGENCE
        retained = save(sums.where(differs).select("prefix", F.log10("back").alias("back_off")), "lm-retained")
        # Runs with a retained context are kept: their probabilities are the next level's parents. Runs with a retained
        # suffix are the contexts that the next level tries; of one that isn't kept only its back-off counts.
        after = retained.select(F.col("prefix").alias("suffix"), F.lit(True).alias("longer"))
        both = rows_p.join(retained, "prefix", "left").join(after, "suffix", "left").where("back_off IS NOT NULL OR longer")
        more = F.coalesce(F.log10(F.col("p") / F.col("q")) - F.col("back_off"), F.lit(0.0))
        both = save(both.select("key", "c", "p", more.alias("more"), F.col("back_off").isNotNull().alias("kept"), F.coalesce("longer", F.lit(False)).alias("longer")), "lm-kept")
        value = (F.col("value") + F.coalesce("back_off", F.lit(0.0))).alias("value")
        values = adds.where(F.col("c") >= LEAST).join(retained.withColumnRenamed("prefix", "key"), "key", "left").where("kept OR back_off IS NOT NULL").select("key", "c", "base", value)
        levels.append(save(values.unionByName(adds.where(F.col("c") < LEAST).select(*values.columns)), "lm-values"))
        adds = both.select("key", "c", F.lit(0.0).alias("base"), F.col("more").alias("value"), "kept")
        discard(rows, rows_p)  # (of the first length, rows are no table of their own)
        used += [retained, both]
        known, tried = both.where("kept").select("key", "c", "p"), both.where("longer").select("key", "c")
        if tried.isEmpty():
            break
    levels.append(save(adds.where("kept").drop("kept"), "lm-values"))
    discard(*used)
    return n, v, levels


def found_among(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sought are among the keys (in order, distinct), and where those are. Sought in order, as that's faster."""
    if not len(keys) or not len(sought):
        return np.zeros(len(sought), bool), np.zeros(0, np.int64)
    order = np.argsort(sought)
    at = np.empty(len(sought), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, sought[order]), len(keys) - 1)
    seen = keys[at] == sought
    return seen, at[seen]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; trained on the rows not held out."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    n, v, levels = fit(docs)
    often = F.col("c") >= max(SHARE * n, LEAST)
    top, rare = [], []
    for level in levels:
        found = level.where(often).select("key", "base", "value").toArrow().sort_by("key")
        top.append([found.column(i).to_numpy() for i in range(3)])
        rare.append(Sieve(level.where(~often), "key"))
    unknown = math.log10(0.5 / (n + 0.5 * (v + 1)))
    slots, sent = partitions_for(docs), docs.sparkSession.sparkContext.broadcast((top, rare))
    ddl = "slot int, data binary, row long, id long, held_out boolean, n_tokens long, known long, base double, value double"
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": _LONG, "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    plain = pa.schema(list(schema)[2:])

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text from its frequent runs, and its rarer runs packed by the slot of their key."""
        top, rare = sent.value
        for batch, texts in text_chunks(batches, "text"):
            h, text = tokens_of(texts)
            sizes, row = np.bincount(text, minlength=len(texts)), batch.column(3)
            base, value, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
            end, sought = np.arange(len(h)), []  # where the runs end that the tree may hold
            key = h.view(np.int64)
            for length, ((keys, of_base, of_value), more) in enumerate(zip(top, rare, strict=True), 1):
                end = end[end >= length - 1]
                end = end[text[end] == text[end - length + 1]]
                if not len(end):
                    break
                key = key if length == 1 else run_keys(key[:-1], key[1:])
                own = key[end - length + 1]
                seen, at = found_among(keys, own)
                where = text[end[seen]]
                if len(at):
                    base += np.bincount(where, of_base[at], len(texts))
                    value += np.bincount(where, of_value[at], len(texts))
                    known += np.bincount(where, of_base[at] > 0, len(texts))
                maybe = np.flatnonzero(~seen)
                maybe = maybe[more.may_hold(own[maybe])]
                sought.append((text[end[maybe]], own[maybe]))
                seen[maybe] = True
                end = end[seen]
            row_slot = pa.array((row.to_numpy() % slots).astype(np.int32))
            yield arrow_batch(schema, [row_slot, pa.nulls(len(texts), pa.binary()), row, batch.column(0), batch.column(2), sizes, known.astype(np.int64), base, value])
            where, key = (np.concatenate(x) for x in zip(*sought, strict=True))
            order = np.argsort(key.view(np.uint64))
            # Rows of a batch are numbered in a row: a place is a number beyond the first.
            yield from packed(schema, slot_of(key[order], slots), [key[order], (row.to_numpy() - row[0].as_py())[where[order]].astype(np.int32)], (row[0].as_py(),))

    def packed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, of_base, of_value = (x.to_numpy() for x in batch.columns)
            order = np.argsort(key.view(np.uint64))
            yield from packed(schema, slot_of(key[order], slots), [x[order] for x in (key, of_base, of_value)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts as they are, and what the rarer runs of a slot add to each text."""
        values, keys, rows = [], [], []
        for batch in batches:
            packs = batch.column(1).is_valid()
            yield batch.filter(pc.invert(packs))
            batch = batch.filter(packs)
            for data, first in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if first is None:
                    values.append(unpacked(data.as_buffer(), "i8", "f8", "f8"))
                else:
                    key, row = unpacked(data.as_buffer(), "i8", "i4")
                    keys.append(key)
                    rows.append(row.astype(np.int64) + first)
        if keys and values:
            key, of_base, of_value = (np.concatenate(x) for x in zip(*values, strict=True))
            order = np.argsort(key)
            seen, at = found_among(key[order], np.concatenate(keys))
            of_base, of_value = of_base[order][at], of_value[order][at]
            rows, where = np.unique(np.concatenate(rows)[seen], return_inverse=True)
            known = np.bincount(where, of_base > 0, len(rows)).astype(np.int64)
            sums = [rows, known, np.bincount(where, of_base, len(rows)), np.bincount(where, of_value, len(rows))]
            order = np.argsort(rows % slots, kind="stable")
            yield from packed(schema, (rows[order] % slots).astype(np.int32), [x[order] for x in sums])
        values = keys = rows = None
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of texts of a slot, with what all tasks of meet() add to them."""
        texts, sums = [], []
        for batch in batches:
            packs = batch.column(1).is_valid()
            texts.append(batch.filter(pc.invert(packs)).select(plain.names))
            sums += [unpacked(data.as_buffer(), "i8", "i8", "f8", "f8") for data in batch.filter(packs).column(1)]
        texts = pa.Table.from_batches(texts, plain).combine_chunks()
        if sums and len(texts):
            own, (row, *more) = texts["row"].to_numpy(), (np.concatenate(x) for x in zip(*sums, strict=True))
            order = np.argsort(own)
            at = order[np.searchsorted(own[order], row)]
            for name, x in zip(("known", "base", "value"), more, strict=True):
                i = texts.schema.get_field_index(name)
                total = texts[name].to_numpy() + np.bincount(at, x, len(own))
                texts = texts.set_column(i, plain.field(i), pa.array(total.astype(x.dtype)))
        yield from texts.to_batches(max_chunksize=100_000)
        texts = sums = None
        release()

    parts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score_texts, ddl)
    for level in levels:
        parts = parts.unionByName(level.where(~often).select("key", "base", "value").mapInArrow(packed_values, ddl))
    # A text's own row is in the slot that what is added to it goes to.
    met = parts.repartitionById(slots, F.col("slot")).mapInArrow(meet, ddl).repartitionById(slots, F.col("slot"))
    sums = met.mapInArrow(add, ddl.split(", ", 2)[2])
    return save(sums, "lm-scores").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("n_tokens") * F.lit(unknown) + F.col("base")).alias("base_score"), (F.col("n_tokens") * F.lit(unknown) + F.col("value")).alias("score"),
    )


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
