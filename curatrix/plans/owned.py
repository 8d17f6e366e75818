"""Funnel and selection of many owners, whose lists are made of the events: queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import owners
from . import adapters as A
from .queries import query

TERMS = ("Ther", "eau", "ung", "ción", "tion", "sch", "ated", "ente", "ando", "heit", "ique", "ness", "ment")


def owned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, lists, handles): each event gives its user a term, of a type by the event's, and a trusted author."""
    e = A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id"), "event_id", "event_type")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "topic").when(F.col("event_type") == "error", "blacklist").otherwise("positive")
    lists = e.select("owner_id", kind.alias("type"), F.element_at(F.array(*map(F.lit, TERMS)), (F.col("event_id") % len(TERMS) + 1).cast("int")).alias("keyword"))
    return A.posts(spark, sf_dir), lists, e.select("owner_id", F.concat(F.lit("@Src"), (F.col("event_id") % 11).cast("string")).alias("handle"))


OWNED = f"""{A.POSTS}, lists AS (
  SELECT DISTINCT 'u' || user_id AS owner_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'topic' WHEN event_type = 'error' THEN 'blacklist' ELSE 'positive' END AS type, lower({list(TERMS)!r}[event_id % {len(TERMS)} + 1]) AS term FROM events
), handles AS (SELECT DISTINCT 'u' || user_id AS owner_id, 'src' || (event_id % 11) AS handle FROM events)"""


@query("fl5_candidates_by_owner", owned, f"""WITH {OWNED}, f AS (
  SELECT *, likes + comments AS score, lower(concat(title, chr(10), descr)) AS topic_text, lower(concat(title, ' ', descr)) AS good_text FROM posts
  WHERE published_at IS NULL OR epoch(TIMESTAMP '2024-01-31') - epoch(published_at) <= 86400 * CASE WHEN platform = 'notes' THEN 3 ELSE 7 END
), t AS (SELECT DISTINCT l.owner_id, f.seq FROM f JOIN lists l ON l.type = 'topic' AND contains(f.topic_text, l.term)
), q AS (SELECT l.owner_id, f.seq, bool_or(l.type = 'positive') AS pos, bool_or(l.type = 'blacklist') AS bad FROM f JOIN lists l ON l.type <> 'topic' AND contains(f.good_text, l.term) GROUP BY 1, 2
), x AS (SELECT t.owner_id, f.seq, f.score, f.platform = 'microblog' AND h.handle IS NOT NULL AS trusted, coalesce(q.pos, false) AS pos, coalesce(q.bad, false) AS bad, t.owner_id IN (SELECT owner_id FROM lists WHERE type = 'positive') AS asks
  FROM t JOIN f USING (seq) LEFT JOIN q ON q.seq = t.seq AND q.owner_id = t.owner_id LEFT JOIN handles h ON h.owner_id = t.owner_id AND h.handle = lower(f.author))
SELECT owner_id, count(*)::BIGINT AS n, sum(seq)::BIGINT AS seqs, sum(score)::BIGINT AS scores, (count(*) FILTER (WHERE trusted))::BIGINT AS n_trusted FROM x
WHERE score >= CASE WHEN trusted THEN 1000 ELSE 500 END AND CASE WHEN score >= 5000 THEN true WHEN bad THEN false WHEN trusted THEN true ELSE NOT asks OR pos END GROUP BY owner_id""")
def _(tables):
    return owners.totals(*tables, A.PARAMS)


@query("jn2_select_by_owner", owned, f"""WITH {OWNED}, k AS (SELECT DISTINCT term FROM lists WHERE type = 'topic'), r AS (SELECT term, seq, row_number() OVER (PARTITION BY term ORDER BY published_at DESC NULLS LAST, seq)::INTEGER AS rank FROM posts JOIN k ON contains(lower(descr), term))
SELECT owner_id, term AS keyword, seq, rank FROM r JOIN lists USING (term) WHERE type = 'topic' AND rank <= 12""")
def _(tables):
    posts, lists, _ = tables
    return owners.select_by_keyword(posts, lists, 12)
