"""Operator 1: removal of repeated passages by MinHash banding of paragraphs and of windows.

Paragraphs are the lines of a text and the blocks between its blank lines; as passages may stand within a long line, one of
more than 104 words is cut into windows of 52 and 104 words as well. Paragraphs get MinHashes in BANDS bands of ROWS (at a
Jaccard similarity of 0.8 99 in 100 pairs collide); those of a band are compared exactly as sets of five-word shingles, by
signature trees, and link at a similarity of 0.8 or more. As passages may also run across lines, windows of 26 words link
where they are equal: any passage of 45 words or more that two texts share gives them one. Windows start at anchors, the
places of the smallest five-word hashes among so many places in a row, so they depend on the words around them alone.
Components of linked units that stand in two documents or more are repeated passages: the occurrence in the smallest
doc_id stays, the others are removed.

Cases: null and empty texts and lines, blocks and texts of fewer than SHORTEST words have no units. Very long texts and
lines are hashed piece by piece; what a task holds of one is some arrays of its length in words.
Rows with one id are one document, and a passage that repeats within one document alone isn't touched; all null ids are one
document, which sorts last. Spans are of each row's own text, told once for rows that repeat an id and a text. Other columns
are ignored (spans) or kept (removal). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Membership, arrow_batch, discard, lookup, mix64, ngrams, read, release, save, text_chunks, with_marks, words_of
from .jaccard_join import group_components

_U = np.uint64
SHINGLE, SHORTEST, BANDS, ROWS, SIMILARITY = 5, 26, 5, 2, (80, 100)
_BUFFER = 2_000_000  # units counted at once
SHORT, LONG = (26, 20), ((52, 40), (104, 80))  # words of the windows, and places that an anchor is the least of


class Units(NamedTuple):
    """Units of several texts, by text and place: of text `text` the `words` words from `pos`; shingles g[begin:end].

    kind: 0 for the short windows, which equal ones alone meet, else 1.
    """

    text: np.ndarray
    pos: np.ndarray
    words: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    g: np.ndarray

    def digests(self) -> np.ndarray:
        """The same for equal sets of shingles (repeats within a unit count)."""
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(self.g ^ _U(0x756E6974)), dtype=_U)))
            return mix64(total[self.end] - total[self.begin] + (self.end - self.begin).astype(_U) + (self.kind.astype(_U) << _U(40))).view(np.int64)

    def banded(self) -> np.ndarray:
        return np.flatnonzero(self.kind)

    def only(self, at: np.ndarray) -> Units:
        return Units(*(x[at] for x in self[:6]), self.g)

    def sets(self) -> list[np.ndarray]:
        return [np.unique(self.g[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]

    def distinct(self) -> np.ndarray:
        """Sizes of the sets: shingles that don't stand earlier in the unit."""
        before = np.full(len(self.g), -1)  # where a shingle stands last before
        # Only shingles that share a slot of a table with another can be repeated.
        slot, place = (self.g >> _U(44)).astype(np.int32), np.arange(len(self.g), dtype=np.int32)
        table = np.zeros(1 << 20, np.int32)
        table[slot] = place
        taken = np.zeros(1 << 20, bool)
        taken[slot[table[slot] != place]] = True
        maybe = np.flatnonzero(taken[slot])
        by = maybe[np.argsort(self.g[maybe], kind="stable")]
        before[by[1:]] = np.where(self.g[by[1:]] == self.g[by[:-1]], by[:-1], -1)
        n = self.end - self.begin
        if not len(n):
            return n
        latest = np.maximum.reduceat(np.append(before, -1), np.stack((self.begin, self.end), 1).ravel())[::2]
        some = np.flatnonzero(latest >= self.begin)
        if len(some):
            size, first = n[some], np.concatenate(([0], np.cumsum(n[some])[:-1]))
            at = np.repeat(self.begin[some] - first, size) + np.arange(size.sum())
            n[some] = np.add.reduceat(before[at] < np.repeat(self.begin[some], size), first, dtype=np.int64)
        return n


def anchors(order: np.ndarray, begin: np.ndarray, words: np.ndarray, unit: int, window: int) -> np.ndarray:
    """First words of the windows of `unit` words of stretches of so many words: the places that are least, by the numbers
    `order` of all places, among any `window` in a row (or among all, if there are fewer)."""
    places = words - unit + 1
    begin, places = begin[places > 0], places[places > 0]
    if not len(begin):
        return begin
    # Smallest of 2**k, then of `window` places from each place on, by its number with its place in the lowest bits.
    least = order << _U(26) | np.arange(len(order), dtype=_U) & _U((1 << 26) - 1)
    few = places <= window
    ends = np.stack((begin[few], begin[few] + places[few]), 1).ravel()
    found = [np.minimum.reduceat(np.append(least, _U(0)), ends)[::2]] if few.any() else []
    step = 1
    while 2 * step <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if window > step and len(least) > window - step:
        least = np.minimum(least[: step - window], least[window - step :])
    begin, starts = begin[~few], places[~few] - window + 1
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(starts)[:-1])), starts) + np.arange(starts.sum())
    at, place = np.concatenate((np.zeros(len(ends) // 2, np.int64), at)), np.concatenate([*found, least[at]]) & _U((1 << 26) - 1)
    # Texts of over 2**26 words: the place is the only one from the start of the window on with these lowest bits.
    return np.unique(at + ((place.astype(np.int64) - at) & ((1 << 26) - 1)))


def units_of(texts: list[str | None], short: bool = True) -> Units:
    """The units of texts; without `short` those that get bands alone."""
    words = words_of(texts)
    h = words.hashes()
    g = ngrams(h, SHINGLE)  # those across a border are in no unit
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    line = np.searchsorted(np.flatnonzero(words.raw == 10), words.begin)  # newlines before each word, one after each text
    order = mix64(g ^ _U(0x616E63686F727321))

    def stretches(least: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and words of what `least` newlines part, or the ends of texts."""
        new = (np.diff(line) >= least) | (np.diff(text) > 0)
        begin = np.concatenate((np.zeros(min(len(h), 1), np.int64), np.flatnonzero(new) + 1))
        size = np.diff(np.append(begin, len(h)))
        return begin[size >= SHORTEST], size[size >= SHORTEST]

    begin, size = stretches(1)
    found = [(begin, size), stretches(2)]
    long = size > LONG[-1][0]
    for unit, window in LONG:
        first = anchors(order, begin[long], size[long], unit, window)
        found.append((first, np.full(len(first), unit)))
    begin, size = np.unique(np.concatenate([np.stack(x, 1) for x in found]), axis=0).T
    first = anchors(order, words.bounds[:-1], np.diff(words.bounds), *SHORT) if short else begin[:0]
    kind = np.repeat([1, 0], [len(begin), len(first)])
    begin, size = np.concatenate((begin, first)), np.concatenate((size, np.full(len(first), SHORT[0])))
    return Units(text[begin], begin - words.bounds[text[begin]], size, kind, begin, begin + size - SHINGLE + 1, g)


def band_hashes(units: Units) -> np.ndarray:
    """(units, BANDS): hashes of the bands' MinHashes."""
    out = np.zeros((len(units.pos), BANDS), _U)
    if not len(out):
        return out.view(np.int64)
    borders, last = np.stack((units.begin, units.end), 1).ravel(), np.full(1, np.iinfo(_U).max, _U)
    with np.errstate(over="ignore"):
        for p in range(BANDS * ROWS):
            least = np.minimum.reduceat(np.concatenate((mix64(units.g ^ mix64(np.array([p + 1], _U))), last)), borders)[::2]
            out[:, p // ROWS] = mix64(out[:, p // ROWS] * _U(0x9E3779B97F4A7C15) + least + _U(p // ROWS))
    return out.view(np.int64)


def joined(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers of a column of arrays in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def lengths(column: pa.Array) -> np.ndarray:
    """How many numbers of 64 bits each row of a column of arrays has."""
    return pc.binary_length(column).to_numpy() // 8


def sliced(of: np.ndarray, rows: int, *values: np.ndarray) -> list[list[bytes]]:
    """Columns of arrays: for each row those of the values that are of it."""
    cuts = np.searchsorted(of, np.arange(rows + 1)).tolist()
    return [[v[a:b].tobytes() for a, b in pairwise(cuts)] for v in values]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, component_id, removed): spans of words of a document that stand in other documents too.

    Neighbouring units make one span; component_id is the smallest id of the documents that share a unit of it; removed is
    false where the span is the first occurrence.
    """
    return _passages(docs, id_col, text_col).drop("text_hash")


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As repeated_passages, with a hash of each text: rows that share an id have spans of their own texts."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    spark = docs.sparkSession
    # A row for each text: its short windows and then its other units, as arrays; n and bands are of the others alone.
    arrays = {"short": np.int64, "short_pos": np.int32, "d": np.int64, "pos": np.int32, "words": np.int32, "n": np.int32, "bands": np.int64}
    unit_schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), *((c, pa.binary()) for c in arrays)])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            u = units_of(texts)
            if not len(u.pos):
                continue
            d, own = u.digests(), u.banded()
            short, banded = np.flatnonzero(u.kind == 0), u.only(own)
            values = [d[short], u.pos[short], d[own], banded.pos, banded.words, banded.distinct(), band_hashes(banded)]
            values = [np.ascontiguousarray(v, k) for v, k in zip(values, arrays.values(), strict=True)]
            columns = sliced(u.text[short], len(texts), *values[:2]) + sliced(banded.text, len(texts), *values[2:])
            yield arrow_batch(unit_schema, [batch.column(0), batch.column(2), *columns])

    table = save(docs.mapInArrow(units, "id long, text_hash long, " + ", ".join(f"{c} binary" for c in arrays)), "units")

    def counted(names: list[str], wide: list[str]) -> DataFrame:
        """(d, rows, low, high, none, ...) of each distinct unit: counts within a task before the shuffle. low, high and none
        say which documents hold it: the smallest and largest id, and whether one has none."""
        ddl = "d long, rows long, low long, high long, none int" + "".join(f", {c} long" for c in wide)
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in ddl.split(", ")])

        def flush(held: list[tuple]) -> pa.RecordBatch:
            d, row_id, none, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(d, kind="stable")
            d, row_id, none = d[order], row_id[order], none[order]
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            low = np.minimum.reduceat(np.where(none, np.iinfo(np.int64).max, row_id), first)
            high = np.maximum.reduceat(np.where(none, np.iinfo(np.int64).min, row_id), first)
            unknown = np.logical_and.reduceat(none, first)
            rest = [column for x in more for column in (x[order[first]].T if x.ndim > 1 else [x[order[first]]])]
            rows = np.diff(np.append(first, len(d)))
            return arrow_batch(schema, [d[first], rows, pa.array(low, mask=unknown), pa.array(high, mask=unknown), np.logical_or.reduceat(none, first).astype(np.int32), *(x.astype(np.int64) for x in rest)])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for batch in batches:
                of = np.repeat(np.arange(batch.num_rows), lengths(batch.column(1)))
                if len(of):
                    none = np.array(batch.column(0).is_null())
                    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                    found = [joined(batch.column(i + 1), arrays[c]) for i, c in enumerate(names)]
                    held.append((found[0], ids[of], none[of], *(x.reshape(-1, BANDS) if c == "bands" else x for c, x in zip(names[1:], found[1:], strict=True))))
                if sum(len(x[0]) for x in held) > _BUFFER:
                    yield flush(held)
                    held = []
            if held:
                yield flush(held)
            held, batch = [], None
            release()

        rows = table.select("id", *names).mapInArrow(count, ddl)
        return rows.groupBy("d").agg(F.sum("rows").alias("rows"), *holders, *(F.max(c).alias(c) for c in wide))

    holders = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("none").alias("none")]
    several = "(low <> high OR none = 1 AND low IS NOT NULL)"
    alike = save(counted(["short"], []).where(several), "units-alike")  # short windows of one document meet nothing
    band_columns = [f"band{i}" for i in range(BANDS)]
    each = save(counted(["d", "n", "bands"], ["n", *band_columns]), "units-each")

    # Places go on without bands, and without most short windows of one document.
    sought = spark.sparkContext.broadcast(Membership(alike, "d"))
    slim = ["id", "text_hash", "short", "short_pos", "d", "pos", "words"]
    slim_schema = pa.schema([unit_schema.field(c) for c in slim])

    def slimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, pos = joined(batch.column(2), np.int64), joined(batch.column(3), np.int32)
            at = np.flatnonzero(sought.value.may_hold(short))
            of = np.repeat(np.arange(batch.num_rows), lengths(batch.column(2)))
            yield arrow_batch(slim_schema, [*batch.columns[:2], *sliced(of[at], batch.num_rows, short[at], pos[at]), *batch.columns[4:]])
        batch = None
        release()

    wide, table = table, save(table.select(*slim).mapInArrow(slimmed, "id long, text_hash long, " + ", ".join(f"{c} binary" for c in slim[2:])), "units-placed")
    discard(wide)

    # Units of one document overlap, so they often share a band among themselves; such bands say nothing. Of bands that
    # collect the same units one is enough.
    banded = each.select("d", "low", "high", "none", F.explode(F.array(*band_columns)).alias("met"))
    met = banded.groupBy("met").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("d")).alias("units"), *holders).where(f"m > 1 AND {several}")
    met = save(met.groupBy("m", "units").agg(F.min("met").alias("met")).drop("units"), "units-met")
    kept = spark.sparkContext.broadcast(Membership(met, "met"))
    member_schema = pa.schema([("d", pa.int64()), ("n", pa.int64()), ("met", pa.int64())])

    def in_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units with the bands that may collect several."""
        for batch in batches:
            for column in batch.columns[2:]:
                at = np.flatnonzero(kept.value.may_hold(column.to_numpy()))
                if len(at):
                    found = batch.take(pa.array(at))
                    yield arrow_batch(member_schema, [found.column(0), found.column(1), column.take(pa.array(at))])

    maybe = save(each.select("d", "n", *band_columns).mapInArrow(in_bands, "d long, n long, met long"), "units-maybe")
    members = save(lookup(maybe, met, "met", "m", maybe.count()).where("m IS NOT NULL").drop("m"), "unit-members")
    # Bands have done their work: a narrower table goes on without them.
    wide, each = each, save(each.select("d", "rows", "low", "high", "none"), "units-counted")
    discard(met, maybe, wide)

    # Shingles of the units that collided.
    sent = spark.sparkContext.broadcast(Membership(members.select("d").distinct(), "d"))
    set_schema = pa.schema([("d", pa.int64()), ("shingles", pa.binary())])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are told once
        for _, texts in text_chunks(batches, "text"):
            u = units_of(texts, short=False)
            d, where = np.unique(u.digests(), return_index=True)
            fresh = sent.value.may_hold(d)
            fresh[fresh] = [x not in seen for x in d[fresh].tolist()]
            seen.update(d[fresh].tolist())
            if fresh.any():
                yield arrow_batch(set_schema, [d[fresh], [s.tobytes() for s in u.only(where[fresh]).sets()]])
            if len(seen) > 1_000_000:
                seen.clear()

    label = save(group_components(members, docs.mapInArrow(with_sets, "d long, shingles binary"), *SIMILARITY, disjoint=False), "unit-labels")

    # Classes of equal or linked units that stand in several documents, and the first of these.
    linked = each.join(label, "d")
    alone = each.where(several).join(label.select("d"), "d", "left_anti").unionByName(alike).withColumn("component", F.col("d"))
    classes = save(linked.unionByName(alone), "unit-classes")
    discard(each, alike, members)
    shared = classes.groupBy("component").agg(*holders, F.count("*").alias("m")).where(several).select("component", "low", "m")
    named = save(lookup(classes.select("d", "rows", "component"), shared, "component", "m", classes.count()).where("low IS NOT NULL").select("d", "rows", "low"), "unit-names")
    discard(classes)
    # Of all places most are of units that no other document has: a filter leaves them where they are.
    known = spark.sparkContext.broadcast(Membership(named.select("d"), "d"))
    place_schema = pa.schema([("d", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("end", pa.int32())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, pos, words in ((2, 3, None), (4, 5, 6)):
                of = np.repeat(np.arange(batch.num_rows), lengths(batch.column(d)))
                d, pos = joined(batch.column(d), np.int64), joined(batch.column(pos), np.int32)
                end = pos + (SHORT[0] if words is None else joined(batch.column(words), np.int32))
                at = np.flatnonzero(known.value.may_hold(d))
                if len(at):
                    rows = pa.array(of[at])
                    yield arrow_batch(place_schema, [d[at], batch.column(0).take(rows), batch.column(1).take(rows), pos[at], end[at].astype(np.int32)])
        batch = None
        release()

    placed = save(table.mapInArrow(places, "d long, id long, text_hash long, pos int, end int"), "unit-places")
    discard(table)
    hits = lookup(placed, named, "d", "rows", placed.count()).where("low IS NOT NULL")
    order = W.partitionBy("id", "text_hash").orderBy("pos", "end")
    spans = hits.withColumn("new", F.when(F.col("pos") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = spans.groupBy("id", "text_hash", "span").agg(F.min("pos").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("low").alias("component_id"), F.max(~F.col("low").eqNullSafe(F.col("id"))).alias("removed"))
    return found.select(F.col("id").alias(id_col), "start_word", "end_word", "component_id", "removed", "text_hash")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed spans cut out of the texts; the rest of each text stays as it is."""
    spans = _passages(docs, id_col, text_col).where("removed").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"))
    spans = save(spans.agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_spans")), "passages")
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = names.index(text_col)
    marked = with_marks(docs.toDF(*inner), inner[names.index(id_col)], inner[at], spans).select(*inner, "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, inner[at]):
            out = list(texts)
            for i, spans in enumerate(batch.column(len(inner)).to_pylist()):
                if spans:
                    raw, words = texts[i].encode(), words_of([texts[i]])
                    kept, since = [], 0
                    for s in spans:
                        kept.append(raw[since : words.begin[s["start_word"]]])
                        since = words.end[s["end_word"] - 1]
                    out[i] = b"".join([*kept, raw[since:]]).decode()
            columns = [pa.array(out, pa.string()) if c == at else batch.column(c) for c in range(len(inner))]
            yield pa.RecordBatch.from_arrays(columns, names=inner)

    return marked.mapInArrow(cut, ", ".join(f"{c} {t}" for c, t in marked.dtypes[:-1])).toDF(*names)


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
