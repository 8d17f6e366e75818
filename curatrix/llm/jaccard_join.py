"""Operator 9: n-gram Jaccard self-join by signature trees.

Which texts meet: the shingles of a text are dealt into k parts by hash, k above the largest symmetric difference that
two texts of its size class may have, so linked texts agree on a whole part (small parts are left out where others must
agree as well). Texts that agree on a part form groups
(by components of part-to-smallest edges); each group, in blocks of bounded size, is joined by a signature tree.
Which texts link: tree nodes hold OR-combined bitmaps and size ranges; a dual traversal drops node pairs whose largest
possible overlap is too small, and node pairs already in one component; leaves are compared exactly.

Nothing is dropped: any linked pair is either compared or already joined through other links, so components are exact
(up to collisions of 64-bit hashes). Exact copies are one class from the start.

Cases: null and empty texts, or texts without words, have n_shingles 0 and are linked with nothing (component_id is the
row's own id). Repeated rows are classed together. Rows with a null id take part; their own id is null, and a component
takes its smallest id that is not null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES, Membership, arrow_batch, connected_components, digest, discard, lookup, mix64, partitions_for, read, release, save, shingle_set, text_chunks, with_marks, words_of

_U = np.uint64
_KEYS = pa.schema([("signature", pa.int64()), ("next", pa.int8()), ("d", pa.int64())])
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2_000_000
#: Shingles of large groups that are counted at a time, which bounds what is shuffled for it, and about how many of them one task's slot holds.
COUNTED, SLOT = 1 << 27, 1 << 20


def size_classes(num: int, den: int, upto: int) -> list[int]:
    """Lower bounds of size classes: linked sizes lie in one class or in neighbours."""
    bounds = [1]
    while bounds[-1] <= upto:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * den // num)))
    return [*bounds, max(bounds[-1] + 1, -(-bounds[-1] * den // num))]


def part_signatures(shingles: np.ndarray, num: int, den: int, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set for its own size class and for the next: any set linked with it (|A n B| * den >= num * |A u B|)
    has one of them too, and for one of both sets that is one of its own class."""
    out = []
    own = int(np.searchsorted(bounds, len(shingles), side="right")) - 1
    spread = mix64(shingles ^ _U(0xA5A5F00DC0FFEE11))
    value = mix64(shingles ^ _U(0x1234567887654321))
    for group in (own, own + 1):
        differ = 2 * (bounds[group + 1] - 1) * (den - num) // (den + num)
        parts = differ + 1 + (2 * differ // 5 + 1 if differ else 0)
        at = ((spread >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        sums, counts = np.zeros(parts, _U), np.bincount(at, minlength=parts)
        with np.errstate(over="ignore"):
            np.add.at(sums, at, value)
            signature = mix64(sums + mix64(np.arange(parts, dtype=_U) + _U(group << 32)))
        # Parts of up to so many shingles, which common passages share, aren't needed where they can't be all that agree:
        # of the parts that agree (parts - differ at least) no more than this side has of them are that small.
        small = np.flatnonzero(np.cumsum(np.bincount(counts)) < parts - differ)
        out.append(signature[counts > small[-1]] if len(small) else signature)
    return out[0], out[1]


class _Tree:
    """Signature tree over sets: leaves are sets; a node has the OR of its bitmaps, its sizes' range and the largest excess
    (set size less bits, for shingles that share a bit)."""

    FANOUT = 8

    def __init__(self, sets: list[np.ndarray], ids: list[int], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]) >> 58, len(sets[i]), ids[i]))
        self.sets, self.ids = [sets[i] for i in order], [ids[i] for i in order]
        sizes = np.array([len(s) for s in self.sets])
        flags = np.zeros((len(order), bits), np.uint8)
        flags[np.repeat(np.arange(len(order)), sizes), (np.concatenate(self.sets) % _U(bits)).astype(np.int64)] = 1
        maps = np.packbits(flags, axis=1).view(np.uint64)
        levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(1).astype(np.int64))]
        while len(levels[-1][0]) > 1:
            m, lo, hi, excess = levels[-1]
            cut = np.arange(0, len(m), self.FANOUT)
            levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(excess, cut)))
        self.levels = levels

    def top(self) -> tuple[int, int]:
        return len(self.levels) - 1, 0

    def children(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        level, i = node
        return [(level - 1, j) for j in range(i * self.FANOUT, min((i + 1) * self.FANOUT, len(self.levels[level - 1][0])))]


class _Links:
    """Union-find over ids, with the links that joined anything."""

    def __init__(self, label: dict[int, int] | None = None):
        self.parent: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []
        for i, c in (label or {}).items():
            self.parent[self.find(i)] = self.find(c)

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, a: int, b: int) -> None:
        self.made.append((a, b))
        self.parent[self.find(a)] = self.find(b)


def similar(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    if len(s) * den < num * len(t):
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return both * den >= num * (len(s) + len(t) - both)


def dual_traversal(x: _Tree, y: _Tree, links: _Links, num: int, den: int) -> None:
    """Links all sets of x with sets of y that are similar enough and not yet in one component."""
    whole: dict[tuple[int, int, int], int] = {}

    def one(tree: _Tree, node: tuple[int, int]) -> int | None:
        """An id of the node if all of it is in one component."""
        if node[0] == 0:
            return tree.ids[node[1]]
        key = (id(tree), *node)
        if key not in whole:
            found = [one(tree, c) for c in tree.children(node)]
            if None in found or len({links.find(f) for f in found}) > 1:
                return None
            whole[key] = found[0]
        return whole[key]

    def possible(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> np.ndarray:
        """Which pairs of nodes, each side of one level, may hold a link: by their sizes and their largest overlap."""
        (ma, la, ha, ea), (mb, lb, hb, eb) = x.levels[a[0][0]], y.levels[b[0][0]]
        i, j = slice(a[0][1], a[-1][1] + 1), slice(b[0][1], b[-1][1] + 1)
        high = np.minimum(ha[i, None], hb[None, j])
        ok = num * np.maximum(la[i, None], lb[None, j]) <= den * high
        if ok.any():
            shared = np.bitwise_count(ma[i, None] & mb[None, j]).sum(2, dtype=np.int64) + np.minimum(ea[i, None], eb[None, j])
            ok &= np.minimum(shared, high) * (den + num) >= num * (la[i, None] + lb[None, j])
        return ok

    def visit(a: tuple[int, int], b: tuple[int, int]) -> None:
        """Of a pair that may hold links."""
        same = x is y and a == b
        if a[0] == 0 and b[0] == 0:
            if not same and links.find(x.ids[a[1]]) != links.find(y.ids[b[1]]):
                if similar(x.sets[a[1]], y.sets[b[1]], num, den):
                    links.link(x.ids[a[1]], y.ids[b[1]])
            return
        left = x.children(a) if a[0] >= b[0] and a[0] else [a]
        right = y.children(b) if b[0] >= a[0] and b[0] else [b]
        if same:
            for c in left:
                visit(c, c)
        for n, m in np.argwhere(possible(left, right)).tolist():
            if same and m <= n:
                continue
            c, d = left[n], right[m]
            p, q = one(x, c), one(y, d)
            if p is None or q is None or links.find(p) != links.find(q):
                visit(c, d)

    if x.sets and y.sets:
        visit(x.top(), y.top())


def _tree(pdf: pd.DataFrame, bits: int) -> _Tree:
    return _Tree([np.frombuffer(b, _U) for b in pdf["shingles"]], [int(i) for i in pdf["d"]], bits)


def _bits(most: int) -> int:
    """Bits of the bitmaps for sets of up to `most` shingles."""
    return 64 * min(max(4, most * 4 // 64), 256)


def _stars(links: _Links) -> list[tuple[int, int]]:
    """The ids that were linked, each with the smallest of its component."""
    ids = {i for pair in links.made for i in pair}
    least: dict[int, int] = {}
    for i in ids:
        least[links.find(i)] = min(least.get(links.find(i), i), i)
    return [(i, c) for i in ids if (c := least[links.find(i)]) != i]


def to_smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, next, d) in order: each d but the first of its key, with the first.

    Keys that have only sets of the class below (next) say nothing: those meet by the keys of their own class.
    """
    key = pivot = own = None
    for batch in batches:
        k, after, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        new = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, d[at], d[0] if pivot is None else pivot)
        has_own = np.where(at >= 0, after[at] == 0, own or False)
        key, pivot, own = k[-1], first[-1], has_own[-1]
        pairs = np.unique(np.stack((d, first), 1)[(d != first) & has_own], axis=0)
        if len(pairs):
            yield arrow_batch(EDGES, [pairs[:, 0], pairs[:, 1]])


def blocked(rows: DataFrame, num: int, den: int, seed: int = 0) -> DataFrame:
    """rows (d, met, n, ...) with blocks of bounded rows and shingles of each group `met`: by size class, then by hash."""
    rows = rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(den / num))))
    sized = rows.groupBy("met").agg(F.count("*").alias("_m"), F.sum("n").alias("_s"))
    by_class = rows.groupBy("met", "class").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("_k"))
    large = sized.where((F.col("_m") > BLOCK_ROWS) | (F.col("_s") > BLOCK_SHINGLES)).select("met").join(by_class, "met")
    return rows.join(large, ["met", "class"], "left").withColumn("block", F.when(F.col("_k").isNull(), F.lit("")).otherwise(F.concat_ws(":", "class", F.pmod(F.xxhash64("d", F.lit(seed)), "_k")))).drop("_k")


_PACKED = pa.schema([("slot", pa.int64()), ("s", pa.binary()), ("d", pa.binary()), ("df", pa.binary())])
_PACKED_DDL = "slot long, s binary, d binary, df binary"


def _slots(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((mix64(keys.view(_U) ^ _U(0x0DDB1A5E5BAD5EED)) >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)


def _packed(at: np.ndarray, s: np.ndarray, d: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """A row for each slot of `at`, with the arrays of its entries."""
    order = np.argsort(at, kind="stable")
    at, s, d, df = at[order], s[order], d[order], df[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    pieces = [[x.tobytes() for x in np.split(a, cut[1:])] for a in (s, d, df)]
    return arrow_batch(_PACKED, [at[cut], *pieces])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(s, d, df) of all entries of each slot, of rows in order of slots."""
    key, held = None, []

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (_U, np.int64, np.int32), strict=True))

    for batch in batches:
        for k, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key and held:
                yield whole()
                held = []
            key = k
            held.append(row)
    if held:
        yield whole()
    held, batch = [], None
    release()


def rarest_meet(sets: DataFrame, num: int, den: int, total: int) -> DataFrame:
    """(d, met) of those of sets (d, shingles; d once, `total` shingles) that may link: linked ones have one `met`.

    By prefixes: of all shingles in one order, the first that two linked sets share is so early in both that
    size - ceil(num / den * size) of either at most come before it. The order is by how many of the sets hold a shingle, so
    what is in a set alone comes first and common passages come last: sets that share passages alone don't meet. Shingles
    move packed, COUNTED at a time.
    """
    spread, rounds, bounds = partitions_for(sets), -(-total // COUNTED), size_classes(num, den, 1 << 40)
    slots = max(spread, total // SLOT)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, sizes, shingles) of about SLOT shingles at a time."""
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy() // 8
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(np.cumsum(size) // SLOT)) + 1):
                if len(part):
                    yield ids[part], size[part], np.frombuffer(b"".join(batch.column(1).slice(part[0], len(part)).to_pylist()), _U)
        batch = None
        release()

    def dealt(turn: int):  # noqa: ANN202
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, size, s in flat(batches):
                d, mine = np.repeat(ids, size), np.flatnonzero(mix64(s) % _U(rounds) == _U(turn))
                if len(mine):
                    yield _packed(_slots(s[mine], slots), s[mine], d[mine], np.ones(len(mine), np.int32))

        return deal

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a slot of shingles those that several sets hold, with how many do, in the slots of their sets."""
        for s, d, _ in _unpacked(batches):
            order = np.argsort(s, kind="stable")
            s, d = s[order], d[order]
            count = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
            df = np.repeat(count, count)
            if (many := df > 1).any():
                yield _packed(_slots(d[many], slots), s[many], d[many], df[many].astype(np.int32))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets' sizes, as entries that no set holds."""
        for ids, size, _ in flat(batches):
            yield _packed(_slots(ids, slots), size.astype(_U), ids, np.zeros(len(ids), np.int32))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, d, df in _unpacked(batches):
            order = np.lexsort((s, df, d))
            s, d = s[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            length = np.diff(np.append(first, len(d)))
            size = s[first].astype(np.int64)
            take = np.maximum(length - 1 + (-num * size // den) + 1, 0)  # shared ones less those that a link needs, and one
            place = np.arange(len(d)) - np.repeat(first, length)
            mine = np.flatnonzero((place > 0) & (place <= np.repeat(take, length)))
            if len(mine):
                own = np.repeat(np.searchsorted(bounds, size, side="right") - 1, length)[mine].astype(_U)
                for after in (0, 1):
                    key = mix64(s[mine] ^ mix64(own + _U(after + 1)))
                    yield arrow_batch(_KEYS, [key.view(np.int64), np.full(len(mine), after, np.int8), d[mine]])

    by_slot = lambda rows: rows.repartition(spread, "slot").sortWithinPartitions("slot")
    shared = [save(by_slot(sets.mapInArrow(dealt(turn), _PACKED_DDL)).mapInArrow(counted, _PACKED_DDL), "jaccard-shared") for turn in range(rounds)]
    signed = save(by_slot(reduce(DataFrame.unionByName, shared, sets.mapInArrow(sized, _PACKED_DDL))).mapInArrow(keys, "signature long, next byte, d long"), "jaccard-rarest")
    discard(*shared)
    dealt_keys = signed.repartition(spread, "signature").sortWithinPartitions("signature", "next", "d")
    met = connected_components(dealt_keys.mapInArrow(to_smallest, "a long, b long"))
    discard(signed)
    return met.select(F.col("id").alias("d"), F.col("component").alias("met"))


def group_components(members: DataFrame, sets: DataFrame, num: int, den: int, disjoint: bool = True) -> DataFrame:
    """(d, component) of the linked among members (d, met, n): sets of one group `met` may link, by d.

    sets: (d, shingles), for each member once or more; disjoint says that no set is in several groups. Large groups, which
    are mostly chains of sets with common passages, are dealt anew by rare shingles first (rarest_meet). Groups are joined by
    signature trees in blocks of bounded size. For a group of several blocks, one set of each component found goes on to
    the next level, until that joins little more; what is then outside the group's largest component is compared with all
    of the group, block by block. Components of all links are made once; what later levels find joins components. Sets move to their block and are written for groups of several blocks alone.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block of rows in order (met, block, d, shingles)."""
        key, ids, sets = None, [], []
        made: list[tuple[int, int]] = []

        def join() -> None:
            if len(ids) == 2:
                made.extend([(max(ids), min(ids))] if similar(*sets, num, den) else [])
            elif len(ids) > 2:
                links = _Links()
                if len(ids) <= _Tree.FANOUT:  # a tree would have its root alone
                    for i, j in combinations(range(len(ids)), 2):
                        if links.find(ids[i]) != links.find(ids[j]) and similar(sets[i], sets[j], num, den):
                            links.link(ids[i], ids[j])
                    made.extend(_stars(links))
                    return
                tree = _Tree(sets, ids, _bits(max(map(len, sets))))
                dual_traversal(tree, tree, links, num, den)
                made.extend(_stars(links))

        for batch in batches:
            met, block, d, shingles = (batch.column(i).to_pylist() for i in range(4))
            for k, i, s in zip(zip(met, block, strict=True), d, shingles, strict=True):
                if k != key:
                    join()
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(np.frombuffer(s, _U))
            if made:
                yield arrow_batch(EDGES, [list(c) for c in zip(*made, strict=True)])
                made.clear()
        join()
        if made:
            yield arrow_batch(EDGES, [list(c) for c in zip(*made, strict=True)])
        ids, sets, made, batch = [], [], [], None
        release()

    def joined(rows: DataFrame) -> DataFrame:
        dealt = rows.select("met", "block", "d", "shingles").repartition(partitions_for(rows), "met", "block").sortWithinPartitions("met", "block")
        return save(dealt.mapInArrow(within, "a long, b long"), "jaccard-links")

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        label = {int(d): int(c) for f in (left, right) for d, c in zip(f["d"], f["component"], strict=True)}
        links = _Links(label)
        bits = _bits(max(len(b) // 8 for f in (left, right) for b in f["shingles"]))
        dual_traversal(_tree(left, bits), _tree(right, bits), links, num, den)
        return pd.DataFrame([(label[a], label[b]) for a, b in _stars(links)], columns=["a", "b"], dtype="int64")

    blocks = save(blocked(members, num, den), "jaccard-blocks")
    sets = sets.groupBy("d").agg(F.first("shingles").alias("shingles"))
    large = blocks.where("block <> ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if disjoint else 0
    if large:
        sets = save(sets.join(blocks.select("d", F.col("block").alias("_block")), "d"), "jaccard-met")
        met = rarest_meet(sets.where("_block <> ''").drop("_block"), num, den, large)
        small, rest = blocks.where("block = ''").select("d", "met", "n"), blocks.where("block <> ''").select("d", "n")
        fewer = save(blocked(small.unionByName(rest.join(met, "d").select("d", "met", "n")), num, den), "jaccard-blocks")
        discard(blocks)
        blocks, whole = fewer, sets
        sets = save(sets.drop("_block").join(blocks.select("d"), "d"), "jaccard-sets")
        discard(whole)
    filled = sets.join(blocks, "d")
    several = blocks.where("block <> ''").limit(1).count() > 0
    if not several:
        links = joined(filled)
        if not disjoint:
            return connected_components(links).withColumnRenamed("id", "d")
        # Each group was one block, whose links are stars already.
        return links.select(F.col("a").alias("d"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("d"), F.col("b").alias("component")).distinct())
    filled = save(filled, "jaccard-sets")
    label = save(connected_components(joined(filled)).withColumnRenamed("id", "d"), "jaccard-labels")
    # From here on links are of components, so each level takes what it found itself and not all links once more.
    now = save(filled.where("block <> ''").drop("class", "block").join(label, "d", "left").withColumn("component", F.coalesce("component", "d")), "jaccard-large")
    discard(filled)
    left, level, tops, found = now.count(), 1, now, []
    while True:  # one text of each component found goes on to the next level, until that joins little more
        tops = save(tops.join(tops.groupBy("met", "component").agg(F.min("d").alias("d")), ["met", "component", "d"]), "jaccard-tops")
        before, left = left, tops.count()
        found.append(joined(blocked(tops, num, den, level).withColumn("d", F.col("component"))))
        if left > 0.9 * before or not found[-1].limit(1).count():
            break
        tops, level = save(_relabelled(tops, connected_components(found[-1])), "jaccard-tops"), level + 1
    # What is outside the largest component of its group is compared with all of the group.
    whole, now = now, save(_relabelled(now, connected_components(reduce(DataFrame.unionByName, found))), "jaccard-now")
    discard(whole)
    sizes = now.groupBy("met", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("met").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    minor = save(blocked(now.join(main, "met").where("component <> main").drop("main"), num, den), "jaccard-minor")
    if minor.limit(1).count():
        every = save(blocked(now.join(minor.select("met").distinct(), "met", "left_semi"), num, den), "jaccard-every")
        one, other = (x.select("met", F.col("class").alias(f"{s}_class"), F.col("block").alias(s)).distinct() for s, x in (("lb", minor), ("rb", every)))
        pairs = save(one.join(other, "met").where("lb = '' OR rb = '' OR abs(lb_class - rb_class) <= 1").select("met", "lb", "rb").distinct(), "jaccard-pairs")
        keys = ["met", "lb", "rb"]
        l = minor.withColumnRenamed("block", "lb").join(pairs, ["met", "lb"])
        r = every.withColumnRenamed("block", "rb").join(pairs, ["met", "rb"])
        found.append(save(l.groupBy(keys).cogroup(r.groupBy(keys)).applyInPandas(across, "a long, b long"), "jaccard-links"))
        discard(every, pairs)
    discard(now, minor)
    merged = save(connected_components(reduce(DataFrame.unionByName, found)), "jaccard-merged")
    # Sets that no link of the first level joined are components of their own.
    alone = merged.select(F.col("id").alias("d"), "component").join(label, "d", "left_anti")
    return _relabelled(label, merged).unionByName(alone)


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; texts link when den * |A n B| >= num * |A u B|."""
    return _components(docs, n, num, den, id_col, text_col).drop("text_hash")


def _components(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """As jaccard_components, with a hash of each text."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    bounds = size_classes(num, den, 1 << 40)

    def sets(texts: list) -> Iterator[np.ndarray]:
        words = words_of(texts)
        h = words.hashes()
        for i in range(len(texts)):
            yield shingle_set(h[words.bounds[i] : words.bounds[i + 1]], n)

    row_schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("d", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            found = [(len(s), digest(s) if len(s) else None) for s in sets(texts)]
            yield arrow_batch(row_schema, [batch.column(0), batch.column(2), [f[0] for f in found], [f[1] for f in found]])

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are told once
        for _, texts in text_chunks(batches, "text"):
            keys, after, ids = [], [], []
            for s in sets(texts):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    own_next = part_signatures(s, num, den, bounds)
                    keys += own_next
                    after.append(np.repeat(np.array([0, 1], np.int8), [len(x) for x in own_next]))
                    ids.append(np.full(len(after[-1]), d))
            if len(seen) > 1_000_000:
                seen.clear()
            if keys:
                yield arrow_batch(_KEYS, [np.concatenate(keys).view(np.int64), np.concatenate(after), np.concatenate(ids)])

    table = save(docs.mapInArrow(rows, "id long, text_hash long, n long, d long"), "jaccard-rows")
    signed = docs.select("text").mapInArrow(signatures, "signature long, next byte, d long").repartition(partitions_for(docs), "signature").sortWithinPartitions("signature", "next", "d")
    met = connected_components(signed.mapInArrow(to_smallest, "a long, b long"))

    # The sets of those that met, one of each class.
    sent = docs.sparkSession.sparkContext.broadcast(Membership(met, "id"))
    set_schema = pa.schema([("d", pa.int64()), ("shingles", pa.binary())])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_chunks(batches, "text"):
            found = [(digest(s), s) for s in sets(texts) if len(s)]
            may = sent.value.may_hold(np.array([d for d, _ in found], np.int64))
            found = [x for x, m in zip(found, may, strict=True) if m and x[0] not in seen]
            found = list({d: (d, s.tobytes()) for d, s in found}.values())
            seen.update(d for d, _ in found)
            if len(seen) > 1_000_000:
                seen.clear()
            if found:
                yield arrow_batch(set_schema, [list(c) for c in zip(*found, strict=True)])

    each = save(table.where("d IS NOT NULL").groupBy("d").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("n")), "jaccard-each")
    members = met.select(F.col("id").alias("d"), F.col("component").alias("met")).join(each.select("d", "n"), "d")
    label = group_components(members, docs.select("text").mapInArrow(with_sets, "d long, shingles binary"), num, den)
    classes = save(each.drop("n").join(label, "d", "left").where("component IS NOT NULL OR copies > 1").withColumn("component", F.coalesce("component", "d")), "jaccard-classes")
    discard(each, met)
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("_classes"))
    named = lookup(classes, lowest, "component", "_classes", classes.count()).select("d", "copies", "component_id")
    out = lookup(table, named, "d", "copies", table.count())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "text_hash")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with a component in place of each that merged (id, component) has; both are saved or cheap to make."""
    sizes = rows.groupBy("component").agg(F.count("*").alias("_w"))
    new = merged.select(F.col("id").alias("component"), F.col("component").alias("_new")).join(sizes, "component")
    return lookup(rows, new, "component", "_w", rows.count()).withColumn("component", F.coalesce("_new", "component")).drop("_new", "_w")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents with all their columns, one of each group: that with the smallest doc_id.

    Of rows that repeat an id and a text one stays; rows of one id with other texts are judged apart. Rows without id go if
    their group has a document with one.
    """
    found = _components(docs, n, num, den, "doc_id", "text")
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_gone"), F.count("*").alias("_n"))
    marks = save(rows.where("_gone OR _n > 1").drop("_n").withColumn("_row", F.monotonically_increasing_id()), "jaccard-marks")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (inner.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    out = with_marks(inner, doc_id, text, marks)
    again = out.where("NOT _gone").dropDuplicates(["_row"])
    return out.where("_gone IS NULL").unionByName(again).select(*inner.columns).toDF(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), 4, 85, 100)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
counts AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM counts WHERE 100 * both_have >= 85 * (na + nb - both_have)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.c = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
