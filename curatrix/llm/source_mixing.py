"""Operator 7: mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash of their id and may be taken up to three times (epochs). The virtual finish
time of a copy is the source's cumulative words up to it, divided by the source's target; copies are taken in the order of
finish time (then source) until the next would exceed the total budget, which is the number of words of all documents.

Running totals need no global sort in one task: within a source they are prefix sums over hash buckets, and the cut is
found by totals of finish-time buckets and an exact running total within the one bucket that holds the cut.

Cases: a null text has size 0; a null source is a source of its own and sorts last; null ids sort first in the shuffle.
Repeated rows each count. Documents of size 0 are never taken (taken 0). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_names, read, save

WEIGHTS = (5, 2, 1)
REPEATS = 3
_TIMES = 2048  # finish-time buckets for each time the budget; times over four budgets share the last


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source, source_size) -> with target: shares of the total by weight, none above REPEATS times its size.

    Water filling: sources in the order of cap per weight are capped as long as the level, that the rest would get by
    weight, exceeds their cap.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEATS)
    everything, before = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("key")).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    out = out.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("level")))).over(everything)["level"]
    return out.withColumn("target", F.least(F.col("cap").cast("double"), reached * F.col("weight"))).select("key", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs; with row_col, a key of the rows, that as `row` too."""
    carried = [] if row_col is None else [F.xxhash64(text_col).alias("text_hash"), F.col(row_col).alias("row")]
    tie = [] if row_col is None else ["text_hash", "row"]  # rows of one id and size: by text, whatever the partitions
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), *carried,
    )
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = save(rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")), "order": order, "bucket": F.substring(order, 1, 3)}), "mix-rows")
    sizes = targets(rows.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")))
    start = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    start = start.withColumn("start", F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    within = F.sum("size").over(W.partitionBy("key", "bucket").orderBy("order", F.col("id").asc_nulls_first(), "size", *tie).rowsBetween(W.unboundedPreceding, 0))
    queue = rows.withColumn("within", within).join(start, ["key", "bucket"]).join(sizes, "key")
    finish = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda e: F.when(F.col("size") > 0, (e * F.col("source_size") + F.col("start") + F.col("within")).cast("double") / F.col("target")))
    queue = save(queue.select("id", *tie[1:], "key", "size", "source_size", "target", finish.alias("finish")), "mix-queue")

    at = F.least(F.floor(F.col("f") * _TIMES), F.lit(4 * _TIMES))
    copies = queue.where("size > 0").select("key", "size", F.explode("finish").alias("f")).withColumn("at", at)
    budget = queue.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    upto = copies.groupBy("at").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("at")))
    cut = upto.crossJoin(budget).where("upto > budget").agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"), "budget")).alias("cut")).select("cut.*")
    # Within the bucket of the cut: the last copy, by finish time and source, that the budget still holds.
    total = F.sum("size").over(W.partitionBy("at").orderBy("f", "key").rowsBetween(W.unboundedPreceding, 0))
    last = copies.join(F.broadcast(cut), "at").withColumn("total", F.col("before") + total).where("total <= budget").agg(F.max(F.struct("f", "key")).alias("last"))
    bound = F.broadcast(cut.select("at").crossJoin(last))
    taken = F.aggregate(
        "finish", F.lit(0).cast("long"),
        lambda n, f: n + F.when(F.floor(f * _TIMES) < F.col("at"), 1).when(F.coalesce(F.struct(f.alias("f"), F.col("key").alias("key")) <= F.col("last"), F.lit(False)), 1).otherwise(0),
    )
    out = queue.join(bound, F.lit(True), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, taken * F.col("size")).otherwise(F.lit(0)).cast("long").alias("taken"), *tie[1:])


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of the mix with all their columns, and `repeats`, how often each is taken (`repeats_` where they have
    a column of that name).

    Counts come back to their rows by a key that is written with the rows first, as ids may be null or repeat.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = save(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    doc_id, text, source = (inner[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    taken = mix(rows, doc_id, text, source, seed, "row").where("taken > 0").select("row", F.expr("taken div nullif(size, 0)").alias("times"))
    return rows.join(taken, "row").select(*inner, "times").toDF(*docs.columns, *free_names(docs.columns, "repeats"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 't') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('1:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY max(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY key
), l AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM s WINDOW b AS (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), reached AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, key LIMIT 1),
t AS (SELECT key, source_size, least(cap::DOUBLE, (SELECT level FROM reached) * weight) AS target FROM l),
c AS (
  SELECT d.*, t.source_size, t.target, e,
    (e * t.source_size + sum(size) OVER (PARTITION BY d.key, e ORDER BY ord, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::DOUBLE / t.target AS finish
  FROM d JOIN t ON d.key = t.key CROSS JOIN (SELECT unnest([0, 1, 2]) AS e) x
), q AS (SELECT *, sum(size) OVER (ORDER BY finish, key, e, ord ROWS UNBOUNDED PRECEDING) AS total FROM c WHERE size > 0)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(x.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.key = t.key LEFT JOIN (
  SELECT doc_id, sum(size) AS taken FROM q WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id
) x ON d.doc_id = x.doc_id
"""
