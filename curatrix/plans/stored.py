"""Cards written to tables and read back: queries of the sinks and of reads by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store, tables
from ..sources.buckets import BucketTable
from . import adapters as A
from .queries import query

_ROW = "id string, seq bigint, likes bigint, title string, raw_content string"


def _table(spark, name: str) -> BucketTable:  # noqa: ANN001
    return BucketTable(store.scratch(spark, name), _ROW, ("id",), buckets=16)


@query("snk1_append", A.cards, f"WITH {A.CARDS} SELECT seq, likes, 1::BIGINT AS n_ids, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_rows FROM cards")
def _(c):
    """All cards, then every third again: rows add up, ids are new each time, and one is given back for each row."""
    path = store.scratch(c.sparkSession, "appended")
    tables.append(c.select("seq", "likes"), path, ids="row_id")
    tables.append(c.where("seq % 3 = 0").select("seq", "likes"), path, ids="row_id")
    rows = tables.read_table(c.sparkSession, path, ["seq", "likes", "row_id"])
    return rows.groupBy("seq", "likes").agg((F.count_distinct("row_id") - F.count("*") + 1).alias("n_ids"), F.count("*").alias("n_rows"))


@query("snk2_upsert_buckets", A.cards, f"WITH {A.CARDS} SELECT id, CASE WHEN seq % 5 = 0 THEN likes + 1000000 ELSE likes END AS likes, CASE WHEN seq % 5 = 0 THEN 'new' ELSE md5(raw_content) END AS text FROM cards WHERE seq % 2 = 0 OR seq % 5 = 0")
def _(c):
    """Cards with even numbers, then a change of every fifth, twice: the last counts, others are as they were."""
    table, rows = _table(c.sparkSession, "upserted"), c.select("id", "seq", "likes", "title", F.md5("raw_content").alias("raw_content"))
    table.upsert(c.sparkSession, rows.where("seq % 2 = 0"), "likes")
    fifth = rows.where("seq % 5 = 0").withColumn("raw_content", F.lit("new"))
    table.upsert(c.sparkSession, fifth.unionByName(fifth.withColumn("likes", F.col("likes") + 1_000_000)), "likes")
    return table.read(c.sparkSession, ["id", "likes", "raw_content"]).withColumnRenamed("raw_content", "text")


@query("snk3_delete_buckets", A.cards, f"WITH {A.CARDS} SELECT id, seq FROM cards WHERE seq % 3 <> 0")
def _(c):
    table, rows = _table(c.sparkSession, "deleted"), c.select("id", "seq", "likes", "title", F.lit("").alias("raw_content"))
    table.upsert(c.sparkSession, rows, "likes")
    table.delete(c.sparkSession, rows.where("seq % 3 = 0"))
    return table.read(c.sparkSession, ["id", "seq"])


# An id of the form that stored rows have, for all but every seventh card.
_ID = "CASE WHEN seq % 7 <> 0 THEN '123e4567-e89b-42d3-a456-' || lpad(seq::VARCHAR, 12, '0') END"


@query("snk4_to_storage", A.cards, f"""WITH {A.CARDS} SELECT seq, {_ID} AS id, CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 2 = 0 AND seq % 7 <> 0 THEN md5(raw_content || '!') WHEN seq % 2 = 0 THEN NULL ELSE md5(raw_content) END AS raw_content,
  CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 2 = 0 AND seq % 7 <> 0 THEN 'old' WHEN seq % 2 = 0 THEN NULL ELSE user_notes END AS user_notes FROM cards""")
def _(c):
    """Details of even cards weren't loaded: they keep what is stored, if anything is; every fourth card isn't stored."""
    number = F.lpad(F.col("seq").cast("string"), 12, "0")
    named = c.withColumn("id", F.when(F.col("seq") % 7 != 0, F.concat(F.lit("123e4567-e89b-42d3-a456-"), number)).otherwise(F.concat(F.lit("draft"), number)))
    old = named.where("seq % 4 <> 0 AND seq % 7 <> 0").select("id", F.md5(F.concat("raw_content", F.lit("!"))).alias("raw_content"), F.lit("old").alias("user_notes"))
    now = named.select("id", "seq", F.md5("raw_content").alias("raw_content"), "user_notes", (F.col("seq") % 2 == 1).alias("detail_loaded"))
    return tables.to_storage(now, old).select("seq", "id", "raw_content", "user_notes")


@query("src5_read_table", A.cards, f"WITH {A.CARDS} SELECT platform, count(*)::BIGINT AS n, sum(likes)::BIGINT AS likes FROM cards GROUP BY platform")
def _(c):
    """A whole scan of a stored table, of two of its columns."""
    path = store.scratch(c.sparkSession, "scanned")
    tables.append(c.select("id", "platform", "likes", "raw_content"), path)
    return tables.read_table(c.sparkSession, path, ["platform", "likes"]).groupBy("platform").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))


@query("src6_lookup", A.cards, f"WITH {A.CARDS} SELECT id, title, md5(raw_content) AS text FROM cards WHERE id = 'k42'")
def _(c):
    """The detail of one card of a stored table: one bucket of 16 is read."""
    table = _table(c.sparkSession, "looked-up")
    table.upsert(c.sparkSession, c.select("id", "seq", "likes", "title", "raw_content"), "likes")
    return table.lookup(c.sparkSession, ["k42"], ["id", "title", "raw_content"]).select("id", "title", F.md5("raw_content").alias("text"))
