"""Hard negatives by an R-tree that is packed by sort-tile-recursive.

Vectors become integers, so scores (inner products) are exact. The tree's first tiles are range partitions by the coordinate
that spreads most, the shards; each is tiled on by further coordinates until a leaf holds LEAF vectors. Bounding boxes give an
interval of the inner product with any anchor, coordinate by coordinate. A queue visits the boxes of the highest bound first
and prunes those outside all score windows of the anchors, or strictly below the kth score that each has already.

The anchors are a stated part of the rows. They meet the shards in blocks: a task holds one shard and one block, so its memory
is bounded, and a block only visits shards whose box may hold something for it. Each search first looks through the anchor's
own shard; the kth score found there prunes the other shards. Only pairs of a block and a shard move, and k rows an anchor
and a shard come back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors in a leaf, boxes in a node, anchors that share a queue, anchors in a block.
LEAF, FANOUT, TOGETHER, BLOCK = 64, 16, 256, 4096
#: Vectors in a shard at least and at most, until there are MOST_SHARDS, whose boxes are sent to all tasks; then shards grow.
LEAST, USUAL, MOST_SHARDS = 4096, 65_536, 16_384
#: The coordinates' spread is taken from so many vectors; it decides how fast a search is, not what it finds.
SAMPLE = 4096
_LOW, _HIGH = -(1 << 62), 1 << 62

PACKED = "shard long, pos long, vec_id long, label long, v binary"
_PACKED = pa.schema([("shard", pa.int64()), ("pos", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])
FOUND = "anchor_id long, want int, score long, vec_id long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("want", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
_INTEGERS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as a type in which their inner products are exact."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return a, b
    if most >= 2.0**62:
        raise OverflowError("inner products of these vectors don't fit into 64 bits")
    return a.astype(np.int64), b.astype(np.int64)


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, dim, v) of rows that take part: each component is floor(scale * x), as 32-bit numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values * scale)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            ends = ends.astype(np.int64)
            keep = np.flatnonzero(bad[ends] == bad[starts])
            if any((np.abs(scaled[starts[i] : ends[i]]) >= 2.0**31).any() for i in keep):
                raise OverflowError("components times the scale must fit into 32 bits")
            v = [scaled[starts[i] : ends[i]].astype("<i4").tobytes() for i in keep.tolist()]
            yield common.arrow_batch(_INTEGERS, [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), (ends - starts)[keep].astype(np.int32), v])

    valid = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    one = valid.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))).alias("r"))
    return one.select("vec_id", "r.label", "r.e").mapInArrow(convert, "vec_id long, label long, dim int, v binary")


def tiled(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The order of vectors in which each LEAF of them are a leaf: sorted by an axis, cut into slabs, each tiled by the next."""

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or depth == len(axes):
            return [rows]
        rows = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / (len(axes) - depth))))
        each = -(-leaves // slabs) * LEAF
        return [part for i in range(0, len(rows), each) for part in tile(rows[i : i + each], depth + 1)]

    return np.concatenate(tile(np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)


def packed(vectors: DataFrame) -> DataFrame:
    """(shard, pos, vec_id, label, v) in the order of the leaves; the row at pos -1 has the shard's box: its least, then its
    greatest coordinates. Vectors of different lengths are in different shards."""
    spark, total = vectors.sparkSession, vectors.count()
    dims: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").toArrow().to_pylist():
        dims.setdefault(r["dim"], []).append(np.frombuffer(r["v"], "<i4"))
    first = {dim: int(np.argmax(np.var(np.array(some, np.float64), axis=0))) for dim, some in dims.items() if dim}
    shards = max(-(-total // max(USUAL, -(-total // MOST_SHARDS))), min(common.partitions_for(vectors), -(-total // LEAST)), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = pa.Table.from_batches(batches, pa.schema(_INTEGERS)), TaskContext.get().partitionId()
        sizes = rows.column("dim").to_numpy()
        for dim in np.unique(sizes).tolist():
            own = rows.filter(pa.array(sizes == dim))
            x = matrix(own.column("v"), dim) if dim else np.zeros((len(own), 0))
            spread = np.argsort(-np.var(x, axis=0), kind="stable")[: max(1, int(np.log2(max(len(x) / LEAF, 2))))]
            order = tiled(x, spread) if dim else np.arange(len(own))
            shard = part << 32 | dim
            yield common.arrow_batch(_PACKED, [[shard], [-1], [None], [None], [np.concatenate((x.min(axis=0), x.max(axis=0))).astype("<i4").tobytes()]])
            for at in range(0, len(order), 10_000):
                some = pa.array(order[at : at + 10_000])
                yield common.arrow_batch(_PACKED, [np.full(len(some), shard), np.arange(at, at + len(some)), *[own.column(c).take(some).combine_chunks() for c in ("vec_id", "label", "v")]])

    @F.pandas_udf("int")
    def along(dim: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, "<i4")[first.get(d, 0)]) if d else 0 for d, b in zip(dim, v, strict=True)], dtype="int32")

    laid = vectors.withColumn("_k", along("dim", "v")).repartitionByRange(shards, "dim", "_k", "vec_id").drop("_k")
    return common.save(laid.mapInArrow(pack, PACKED), "packed")


def _bounds(low: np.ndarray, high: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors (their parts above and below 0) and boxes: the least and the greatest inner product."""
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """The boxes of one shard, level by level from the leaves up; its vectors are in the order of the leaves."""

    def __init__(self, x: np.ndarray):
        self.levels = [(np.minimum.reduceat(x, np.arange(0, len(x), LEAF)), np.maximum.reduceat(x, np.arange(0, len(x), LEAF)))]
        while len(self.levels[-1][0]) > FANOUT:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


class _Best:
    """The best k (score, id) of each slot, the slots of the anchors' windows."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.new, self.waiting = floor, k, [], 0
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((slot, score, ids))
        self.waiting += len(slot)
        if self.waiting > self.k * len(self.floor):
            self.settle()

    def settle(self) -> None:
        """Keeps the best and raises what a slot that is full asks for."""
        slot, score, ids = (np.concatenate(c) for c in zip((self.slot, self.score, self.id), *self.new, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        self.slot, self.score, self.id = slot[rank < self.k], score[rank < self.k], ids[rank < self.k]
        self.new, self.waiting = [], 0


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, score, id): for each window of each anchor (slot: anchor * windows + window) the best k vectors of a score within
    low..high, with the anchor's own label (but not itself) or another one; higher scores first, then smaller ids."""
    x, q = _exact(x, q)
    tree, up, down = Tree(x), np.maximum(q, 0), np.minimum(q, 0)
    windows, best = low.shape[1], _Best(low.ravel().copy(), k)
    floor = best.floor.reshape(low.shape)
    queue: list[tuple] = []

    def offer(level: int, nodes: np.ndarray, who: np.ndarray) -> None:
        """Queues boxes that may hold something for an anchor, with the anchors it may be for."""
        least, most = _bounds(tree.levels[level][0][nodes], tree.levels[level][1][nodes], up[who], down[who])
        may = ((most[:, :, None] >= floor[who][:, None, :]) & (least[:, :, None] <= high[who][:, None, :])).any(axis=2)
        top = np.where(may, most, -np.inf).max(axis=0)
        for i in np.flatnonzero(may.any(axis=0)).tolist():
            heapq.heappush(queue, (-float(top[i]), level, int(nodes[i]), who[may[:, i]], most[may[:, i], i]))

    offer(len(tree.levels) - 1, np.arange(len(tree.levels[-1][0])), np.arange(len(q)))
    while queue:
        _, level, node, who, most = heapq.heappop(queue)
        who = who[(most[:, None] >= floor[who]).any(axis=1)]
        if not len(who):
            continue
        if level:
            offer(level - 1, np.arange(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][0]))), who)
            continue
        rows = slice(node * LEAF, (node + 1) * LEAF)
        score = q[who] @ x[rows].T
        alike = anchor_labels[who][:, None] == labels[rows][None, :]
        allowed = alike & (anchor_ids[who][:, None] != ids[rows][None, :]) if same else ~alike
        hit = allowed[:, :, None] & (score[:, :, None] >= floor[who][:, None, :]) & (score[:, :, None] <= high[who][:, None, :])
        a, r, w = np.nonzero(hit)
        if len(a):
            best.add(who[a] * windows + w, score[a, r].astype(np.int64), ids[rows][r])
    best.settle()
    return best.slot, best.score, best.id


def _searched(rows: pa.Table, anchors: pa.Table, same: bool, k: int) -> pa.Table:
    """One shard and one block of anchors."""
    out = []
    if len(rows) and len(anchors):
        rows = rows.sort_by("pos")
        dim = int(rows.column("shard")[0].as_py()) & 0xFFFFFFFF
        x, ids, labels = matrix(rows.column("v"), dim) if dim else np.zeros((len(rows), 1)), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        anchors = anchors.sort_by("pos")
        for at in range(0, len(anchors), TOGETHER):
            some = anchors.slice(at, TOGETHER)
            q, wants = matrix(some.column("v"), dim) if dim else np.zeros((len(some), 1)), some.column("wants").to_pylist()
            most = max(map(len, wants))
            low, high, want = np.full((len(some), most), _HIGH), np.full((len(some), most), _LOW), np.zeros((len(some), most), np.int64)
            for i, each in enumerate(wants):
                for j, w in enumerate(each):
                    low[i, j], high[i, j], want[i, j] = w["low"], w["high"], w["want"]
            own = some.column("vec_id").to_numpy()
            slot, score, found = search(x, ids, labels, q, own, some.column("label").to_numpy(), low, high, same, k)
            out.append(common.arrow_batch(_FOUND, [own[slot // most], want.ravel()[slot].astype(np.int32), score, found]))
    return pa.Table.from_batches(out, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor's window, numbered from 1: of at most k rows a shard."""
    order = W.partitionBy("anchor_id", "want").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(anchors: DataFrame, boxes: DataFrame) -> DataFrame:
    """anchors with each shard whose box may hold a score within one of their windows. The boxes are sent: MOST_SHARDS at most,
    but for shards of another length."""
    held: dict[int, tuple] = {}
    for row in boxes.collect():
        held.setdefault(row["shard"] & 0xFFFFFFFF, []).append((row["shard"], np.frombuffer(row["v"], "<i4").astype(np.float64)))
    ready = {dim: (np.array([s for s, _ in some]), np.array([v[:dim] for _, v in some]), np.array([v[dim:] for _, v in some])) for dim, some in held.items()}
    sent = anchors.sparkSession.sparkContext.broadcast(ready)

    @F.pandas_udf("array<long>")
    def shards(home: pd.Series, v: pd.Series, wants: pd.Series) -> pd.Series:
        out = []
        for h, b, asked in zip(home, v, wants, strict=True):
            ids, low, high = sent.value[h & 0xFFFFFFFF]
            q = np.frombuffer(b, "<i4").astype(np.float64)[None, :]
            least, most = _bounds(low, high, np.maximum(q, 0), np.minimum(q, 0))
            # Far beyond what doubles hold exactly, a bound may be off by its last bits: 1 part in 2**40 is allowed for.
            slack = np.abs(most).max(initial=0) * 2.0**-40 + np.abs(least).max(initial=0) * 2.0**-40
            may = np.zeros(len(ids), bool)
            for w in asked:
                may |= (most[0] + slack >= w["low"]) & (least[0] - slack <= w["high"])
            out.append(ids[may].tolist())
        return pd.Series(out)

    return anchors.withColumn("shard", F.explode(shards("home", "v", "wants")))


def _round(rows: DataFrame, boxes: DataFrame | None, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, want, score, vec_id, rank): what each window of the anchors asks for, of all shards or the anchor's own."""
    visits = common.save(anchors.withColumn("shard", F.col("home")) if boxes is None else _visits(anchors, boxes), "visits")
    pairs = visits.select("shard", "block").distinct().toDF("shard", "block")
    both = rows.join(pairs, "shard").groupBy("shard", "block").cogroup(visits.groupBy("shard", "block"))
    return common.save(_best(both.applyInArrow(lambda a, b: _searched(a, b, same, k), FOUND), k), "found")


def _asked(anchors: DataFrame, wants: DataFrame) -> DataFrame:
    """anchors with the list of their windows; those without any leave."""
    listed = wants.where("low <= high").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("want", "low", "high"))).alias("wants"))
    return anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id")


def _searches(rows: DataFrame, boxes: DataFrame, anchors: DataFrame, wants: DataFrame, same: bool, k: int) -> DataFrame:
    """First in each anchor's own shard; the kth score there is the least that is asked of all shards."""
    seen = _round(rows, None, _asked(anchors, wants), same, k).where(F.col("rank") == k).select("anchor_id", "want", F.col("score").alias("_kth"))
    raised = wants.join(seen, ["anchor_id", "want"], "left").withColumn("low", F.greatest("low", F.coalesce("_kth", "low"))).drop("_kth")
    return _round(rows, boxes, _asked(anchors, raised), same, k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    An anchor's positives are its best `positives` other rows of its label; for each, the best `negatives` rows of other labels
    score between `low` and `high` percent of it. Higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a
    vec_id the one of the least (label, vector) counts. Vectors of different lengths aren't compared; empty ones score 0. A
    component times the scale must fit into 32 bits, and scores into 62, else the job fails and says so. Without rows or
    anchors there is no result. Other columns are left out, whatever their names.
    """
    common.small_batches(vectors.sparkSession)
    tree = packed(common.save(integers(vectors, scale), "integers"))
    rows, boxes = tree.where("pos >= 0"), tree.where("pos < 0").select("shard", "v")
    chosen = common.save(rows.where(is_anchor), "anchors")
    each = max(1, BLOCK * boxes.count() // max(chosen.count(), 1))  # shards whose anchors share a block
    anchors = chosen.withColumnRenamed("shard", "home").withColumn("block", F.floor(F.shiftright("home", 32) / each).cast("long"))
    every = anchors.select(F.col("vec_id").alias("anchor_id"), F.lit(0).alias("want"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))
    near = _searches(rows, boxes, anchors, every, True, positives).select("anchor_id", F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    percent = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")  # noqa: E731  rounded down; a quotient of longs is exact here
    score = F.col("positive_score")
    wants = near.select("anchor_id", "want", (-percent(-score * low)).alias("low"), percent(score * high).alias("high"))
    found = _searches(rows, boxes, anchors, wants, False, negatives)
    return found.join(near, ["anchor_id", "want"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50, from all rows; every seventh row has another label."""
    rows = common.read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
