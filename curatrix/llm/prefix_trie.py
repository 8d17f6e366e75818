"""The trie of all prefixes of rebuilt conversations, by collapsing whole sequences first.

Conversations that are rebuilt alike become one weighted sequence, so the prefixes of each sequence are made once. Sequences
that are proper prefixes of others are found by an anti-join; the rest are the leaves, and every node lies on the path of one.
A sum over a subtree is made on leaf paths: each node counts on the path of the least leaf below it alone, running sums from
the end of each path give what lies below a node on it, and these add up by node.

A prefix is known by 128 bits, the exclusive or of two hashes of each turn with its place, so its parent's are had by one
more exclusive or. Running values are made in range partitions of (conversation, place), with what earlier partitions hold
added, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

_ENDS = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("part", pa.string())])
_DIGESTS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: A conversation takes less than this many turns of another.
SHARED = 6


def running(rows: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with running values, the own row included: name -> (column, 'sum' or 'xor'), by key (not null) in order.

    A key's rows may lie in many range partitions. Those that begin within a key, of which there is one a border at most, get
    what the key's earlier partitions hold by a broadcast.
    """
    total = {"sum": F.sum, "xor": F.bit_xor}
    joined: dict[str, object] = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    laid = common.save(rows.repartitionByRange(common.partitions_for(rows), key, *order).withColumn("_part", F.spark_partition_id()), "laid")
    each = laid.groupBy("_part", key).agg(*[total[kind](c).alias(f"_{name}") for name, (c, kind) in values.items()])
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    held = each.select("_part", key, F.count("*").over(before).alias("_n"), *[total[kind](f"_{name}").over(before).alias(f"_{name}") for name, (_, kind) in values.items()]).where("_n > 0").drop("_n")
    own = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    made = {name: joined[kind](total[kind](c).over(own), F.coalesce(F.col(f"_{name}"), F.lit(0).cast("long"))) for name, (c, kind) in values.items()}
    return laid.join(F.broadcast(held), ["_part", key], "left").withColumns(made).drop("_part", *[f"_{name}" for name in values])


def hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, size) of each turn: two hashes of role and text, and the text's code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    two = [F.xxhash64(F.lit(i), role, text).alias(name) for i, name in enumerate("ab")]
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *two, F.length(text).cast("long").alias("size"))


def rebuilt(turns: DataFrame, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns rebuilt, conversations) of hashed turns: each conversation c begins with the first h turns of c - c % group, where
    h is the checksum of c modulo SHARED, and goes on with its own turns after its first h. Both are saved."""
    placed = common.save(running(turns.withColumn("one", F.lit(1).cast("long")), "conv_id", ["turn", "a", "b"], {"pos": ("one", "sum")}).drop("one", "turn"), "placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = sizes.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = common.save(sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    own = common.lookup(placed, convs.select("conv_id", "h", "taken", "n"), "conv_id", "n", placed.count()).where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("p"), "a", "b", "size")
    lent = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), F.col("pos").alias("p"), "a", "b", "size")
    borrowed = lent.join(convs.select("conv_id", "base", "taken"), "base").where("p <= taken").select(own.columns)
    return common.save(own.unionByName(borrowed), "rebuilt"), convs.select("conv_id")


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)]))


def _root() -> Column:
    return F.unhex(F.lit("0" * 32))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, conv_id) in order: a row for each key of a batch, its ids joined."""
    for batch in batches:
        keys, ids, out, first = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                out.append((keys[first], ids[first], ",".join(map(str, ids[first:i]))))
                first = i
        if out:
            yield common.arrow_batch(_ENDS, list(zip(*out, strict=True)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, first, part) in order: the digest of each key's parts, joined by commas, one part at a time."""
    at, sha = None, hashlib.sha256()
    for batch in batches:
        out = []
        for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == at:
                sha.update(b",")
            else:
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = key, hashlib.sha256()
            sha.update(part.encode())
        if out:
            yield common.arrow_batch(_DIGESTS, list(zip(*out, strict=True)))
    if at is not None:
        yield common.arrow_batch(_DIGESTS, [[at], [sha.hexdigest()]])


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids in order, joined in parts by range, so that a key's last step reads few rows."""
    n = common.partitions_for(ends)
    parts = common.save(ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_parts, "key binary, first long, part string"), "end-lists")
    return parts.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations. turns: (conv_id, p from 1, a, b, size), convs: (conv_id), the turnless ones too.

    (conv_id, depth) names a node: the first `depth` turns of that conversation, the smallest that begins so. Without
    conversations there are no nodes; with any there is a root.
    """
    salted = turns.withColumns({c: F.xxhash64("p", c) for c in "ab"})
    paths = common.save(running(salted, "conv_id", ["p"], {"ka": ("a", "xor"), "kb": ("b", "xor")}).select("conv_id", "p", "size", _key(F.col("ka"), F.col("kb")).alias("key"), _key(F.col("ka").bitwiseXOR(F.col("a")), F.col("kb").bitwiseXOR(F.col("b"))).alias("parent")), "paths")
    ends = paths.groupBy("conv_id").agg(F.max("p").alias("n"), F.max_by("key", "p").alias("key"))
    ends = common.save(convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("key", _root()).alias("key")), "ends")
    sequences = common.save(ends.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("n").alias("n"), F.count("*").alias("weight")), "sequences")
    # Prefixes of each distinct sequence, then those of the leaves.
    steps = common.save(common.lookup(paths, sequences.select("conv_id", "n", "weight"), "conv_id", "n", paths.count()).where("weight IS NOT NULL"), "steps")
    leaves = sequences.where("n > 0").join(steps.where("p < n").select("key").distinct(), "key", "left_anti").select("conv_id", "n", F.lit(True).alias("leaf"))
    total = steps.count()
    on_leaves = common.save(common.lookup(steps.drop("n"), leaves, "conv_id", "n", total).where("leaf").drop("leaf", "weight", "n"), "leaf-steps")
    nodes = steps.groupBy("key").agg(F.max("p").alias("depth"), F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("size").alias("size"))
    above = on_leaves.groupBy("key").agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("owner"))
    nodes = common.save(nodes.join(above, "key").withColumn("own", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    counted = common.lookup(on_leaves, nodes.select("key", "own", "owner", "n_leaves"), "key", "n_leaves", total)
    counted = counted.select("conv_id", "key", (-F.col("p")).alias("up"), F.when(F.col("owner") == F.col("conv_id"), F.col("own")).otherwise(0).alias("v"))
    saved = running(counted, "conv_id", ["up"], {"below": ("v", "sum")}).groupBy("key").agg(F.sum("below").alias("saved_tokens"))
    nodes = nodes.join(saved, "key").select("key", "parent", "depth", "n_convs", "conv_id", "n_leaves", "saved_tokens")
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").join(F.broadcast(leaves.agg(F.count("*").alias("n_leaves")).crossJoin(steps.where("p = 1").join(saved, "key").select("key", "saved_tokens").distinct().agg(F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")))))
    root = root.select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    nodes = common.save(nodes.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    parents = common.save(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(children, "parent"), "parents")
    whole = common.lookup(nodes, parents, "parent", "n_children", total).drop("n_children")
    whole = whole.join(children.withColumnRenamed("parent", "key"), "key", "left").join(end_lists(ends.select("key", "conv_id")), "key", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    Turns are ordered by number, null first; equal numbers by a hash of role and text, so repeated rows stay side by side.
    Null roles and texts are empty, turns without conversation take no part, and an empty table gives no node. Only hashes and
    lengths of texts move, so very long ones cost no more. Other columns are left out, whatever their names.
    """
    return trie(*rebuilt(hashed(common.read(spark, sf_dir, "conversations"))))


# The checksum byte by byte, eight steps of the reflected polynomial each.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda v, x: list_reduce(list_prepend(xor(v, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"

ORACLE_SQL = f"""WITH o AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), h AS (SELECT c, s, {_CRC} % {SHARED} AS h FROM o
), q AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100
), p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM q
), n AS (SELECT s[1:d] AS k, d AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = d) AS ends FROM p GROUP BY 1, 2
), m AS (SELECT n.*, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(k[depth]['t']) END AS own, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.k[1:n.depth] = n.k) AS n_children FROM n
), u AS (SELECT a.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.own) AS saved FROM m a JOIN m x ON x.depth >= a.depth AND x.k[1:a.depth] = a.k GROUP BY a.k
)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.k = m.k LEFT JOIN m up ON m.depth > 0 AND up.depth = m.depth - 1 AND up.k = m.k[1:m.depth - 1]"""
