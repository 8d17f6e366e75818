"""The given tables as posts, cards, collections, calls and logs, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.funnel import Params

# What the sample runs ask for: terms and handles that occur in the given tables.
PARAMS = Params(now=datetime(2024, 1, 31), handles=("@src3", " SRC7"), topic=("ai", "sd"), positive=("ther", "eau"), blacklist=("ad",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for each document, with an address of a page: addresses repeat."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.count("*").alias("_n"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("doc_id") % F.col("_n"))
    metric = lambda k, m: (F.col("doc_id") * k % m).alias
    return d.join(pages, "page_id").select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "notes").otherwise("microblog").alias("platform"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30)).otherwise("").alias("title"),
        F.col("text").alias("descr"), F.col("source").alias("author"), metric(7919, 9000)("likes"), metric(1299709, 3000)("bookmarks"), metric(104729, 900)("comments"), metric(15485863, 500)("shares"),
        F.when(F.col("doc_id") % 50 != 7, F.timestamp_add("HOUR", (F.col("doc_id") % 720).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("published_at"),
        F.when(F.col("doc_id") % 50 != 7, F.date_format(F.timestamp_add("HOUR", (F.col("doc_id") % 720).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")).alias("publish_time"), F.col("url").alias("source_url"), F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("cover_image"), F.array().cast("array<string>").alias("images"),
    )


POSTS = """posts AS (
  SELECT d.doc_id AS seq, CASE WHEN d.doc_id % 3 = 0 THEN 'notes' ELSE 'microblog' END AS platform, CASE WHEN d.doc_id % 3 = 0 THEN substring(d.text, 1, 30) ELSE '' END AS title, d.text AS descr, d.source AS author,
    d.doc_id * 7919 % 9000 AS likes, d.doc_id * 1299709 % 3000 AS bookmarks, d.doc_id * 104729 % 900 AS comments, d.doc_id * 15485863 % 500 AS shares,
    CASE WHEN d.doc_id % 50 <> 7 THEN TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 720)::INTEGER) END AS published_at,
    CASE WHEN d.doc_id % 50 <> 7 THEN strftime(TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 720)::INTEGER), '%Y-%m-%d %H:%M') END AS publish_time, p.url AS source_url, [d.lang, d.source] AS tags
  FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
)"""

# The funnel's steps over posts; s1..s4 as in Params.
FLAGS = """f AS (
  SELECT *, likes + comments AS score, platform = 'microblog' AND lower(author) IN ('src3', 'src7') AS trusted, lower(concat(title, chr(10), descr)) AS topic_text, lower(concat(title, ' ', descr)) AS good_text FROM posts
), g AS (
  SELECT *, score >= CASE WHEN trusted THEN 1000 ELSE 500 END AS s1,
    published_at IS NULL OR epoch(TIMESTAMP '2024-01-31') - epoch(published_at) <= 86400 * CASE WHEN platform = 'notes' THEN 3 ELSE 7 END AS r2,
    contains(topic_text, 'ai') OR contains(topic_text, 'sd') AS r3,
    CASE WHEN score >= 5000 THEN true WHEN contains(good_text, 'ad') THEN false WHEN trusted THEN true ELSE contains(good_text, 'ther') OR contains(good_text, 'eau') END AS r4 FROM f
), flags AS (SELECT *, s1 AND r2 AS s2, s1 AND r2 AND r3 AS s3, s1 AND r2 AND r3 AND r4 AS s4 FROM g)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    seq = F.col("seq")
    tag = F.concat(F.lit("snapshot:2024-01-"), F.lpad((seq % 7 + 1).cast("string"), 2, "0"))
    return p.select(
        F.concat(F.lit("k"), seq.cast("string")).alias("id"), F.when(seq % 13 != 0, F.concat(F.lit("o"), (seq % 5).cast("string"))).alias("owner_id"), (seq % 4 == 1).alias("is_public"), F.when(F.col("title") == "", F.substring("descr", 1, 40)).otherwise(F.col("title")).alias("title"),
        F.when(seq % 10 == 0, "#").otherwise(F.col("source_url")).alias("source_url"), "platform", "author", F.when(seq % 6 == 0, F.concat(F.lit("/fallback-covers/cover-"), F.lpad((seq % 1000).cast("string"), 3, "0"), F.lit(".svg"))).otherwise("").alias("cover_image"),
        "likes", "bookmarks", "comments", F.col("descr").alias("raw_content"), F.when(seq % 9 == 0, F.col("author")).otherwise("").alias("user_notes"), F.when(seq % 8 == 0, "").otherwise(F.substring("descr", 1, 160)).alias("summary"),
        F.when((seq % 2 == 0) & (seq % 11 != 0), F.array_append("tags", tag)).otherwise(F.col("tags")).alias("tags"), F.array(F.concat(F.lit("c"), (seq % 7).cast("string")), F.concat(F.lit("c"), (seq % 11).cast("string")), F.lit(" ")).alias("collections"),
        F.when(seq % 5 == 0, F.array("author")).otherwise(F.array().cast("array<string>")).alias("usage_scenarios"), F.array().cast("array<string>").alias("core_knowledge"), F.array().cast("array<string>").alias("extracted_prompts"), F.array().cast("array<string>").alias("images"),
        (seq % 2 == 0).alias("is_trending"), F.timestamp_add("MINUTE", seq.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"), seq.alias("seq"),
    )


CARDS = (
    POSTS
    + """, cards AS (
  SELECT 'k' || seq AS id, CASE WHEN seq % 13 <> 0 THEN 'o' || (seq % 5) END AS owner_id, seq % 4 = 1 AS is_public, CASE WHEN title = '' THEN substring(descr, 1, 40) ELSE title END AS title,
    CASE WHEN seq % 10 = 0 THEN '#' ELSE source_url END AS source_url, platform, author, CASE WHEN seq % 6 = 0 THEN '/fallback-covers/cover-' || lpad((seq % 1000)::VARCHAR, 3, '0') || '.svg' ELSE '' END AS cover_image,
    likes, bookmarks, comments, descr AS raw_content, CASE WHEN seq % 9 = 0 THEN author ELSE '' END AS user_notes, CASE WHEN seq % 8 = 0 THEN '' ELSE substring(descr, 1, 160) END AS summary,
    CASE WHEN seq % 2 = 0 AND seq % 11 <> 0 THEN list_append(tags, 'snapshot:2024-01-' || lpad((seq % 7 + 1)::VARCHAR, 2, '0')) ELSE tags END AS tags, ['c' || (seq % 7), 'c' || (seq % 11), ' '] AS collections,
    CASE WHEN seq % 5 = 0 THEN [author] ELSE [] END AS usage_scenarios, seq % 2 = 0 AS is_trending, TIMESTAMP '2024-01-01' + to_minutes(seq::INTEGER) AS created_at, seq FROM posts
)"""
)

# The library's normal form of an address (the given tables hold no note addresses), and its dedup key.
STRIPPED = "CASE WHEN {0} IN ('', '#') THEN '' WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+$') THEN lower({0}) || '/' ELSE lower(regexp_extract(regexp_replace({0}, '[?#].*$', ''), '^([a-z]+://[^/]+)', 1)) || regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[a-z]+://[^/]+', '') END"
META = "concat_ws('|', lower(platform), lower(trim(title, ' ' || chr(10))), lower(author), substring(lower(trim(raw_content, ' ' || chr(10))), 1, 120))"
KEYS = CARDS + f", u AS (SELECT *, {STRIPPED.format('source_url')} AS url FROM cards), k AS (SELECT *, CASE WHEN url <> '' THEN 'url:' || url ELSE 'meta:' || {META} END AS key FROM u)"
SCORE = "length(user_notes) * 0.2::DOUBLE + length(summary) * 0.2::DOUBLE + (len(usage_scenarios) * {w}::DOUBLE) + length(raw_content) * 0.02::DOUBLE + len(tags) * 8.0::DOUBLE + len(collections) * 20.0::DOUBLE + (likes + bookmarks + comments) * 0.01::DOUBLE + CASE WHEN cover_image <> '' THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END"


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each number 0..10 that the cards' membership names, from the documents' ids: names repeat."""
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") % 11).alias("n")).distinct()
    n = F.col("n").cast("string")
    return ids.select(F.concat(F.lit("c"), n).alias("id"), F.when(F.col("n") % 2 == 0, "o1").alias("owner_id"), F.concat(F.lit(" Name "), (F.col("n") % 4).cast("string")).alias("name"), F.lit("").alias("cover_image"), F.col("n").alias("item_count"), F.timestamp_add("DAY", (11 - F.col("n")).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"))


COLLECTIONS = """collections AS (
  SELECT 'c' || n AS id, CASE WHEN n % 2 = 0 THEN 'o1' END AS owner_id, ' Name ' || (n % 4) AS name, '' AS cover_image, n AS item_count, TIMESTAMP '2024-01-01' + to_days((11 - n)::INTEGER) AS created_at
  FROM (SELECT DISTINCT doc_id % 11 AS n FROM documents) x
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "microblog").when(F.col("user_id") % 7 != 0, "notes").alias("platform"), F.col("event_type").alias("provider"), (F.col("event_id") % 11).alias("result_count"))


CALLS = "calls AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'microblog' WHEN user_id % 7 <> 0 THEN 'notes' ELSE 'unknown' END AS platform, event_type AS provider, event_id % 11 AS result_count FROM events)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each hour of events: its time is their values, it failed if one was an error."""
    hour = F.date_trunc("HOUR", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("created_at")
    error = F.col("event_type") == "error"
    g = table(spark, sf_dir, "events").groupBy(hour).agg((F.count("*") * 700).cast("int").alias("runtime_ms"), F.count_if(error).alias("errors"), F.max(F.when(error, F.col("event_id"))).alias("last"))
    none = F.array().cast("array<struct<platform:string,error:string>>")
    return g.select(
        F.date_format("created_at", "yyyyMMddHH").alias("id"), "created_at", "runtime_ms", (F.hour("created_at") == 5).alias("runtime_guard_triggered"), (F.col("errors") == 0).alias("success"),
        F.when(F.col("errors") > 0, F.concat(F.lit("timeout of "), F.col("last").cast("string"))).alias("error_message"), F.when(F.col("errors") > 2, F.array(F.struct(F.lit("notes").alias("platform"), F.col("errors").cast("string").alias("error")))).otherwise(none).alias("platform_errors"),
    )


LOGS = """logs AS (
  SELECT strftime(h, '%Y%m%d%H') AS id, h AS created_at, n * 700 AS runtime_ms, hour(h) = 5 AS guard, errors = 0 AS success, CASE WHEN errors > 0 THEN 'timeout of ' || last END AS error_message, errors
  FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_id) FILTER (WHERE event_type = 'error') AS last FROM events GROUP BY 1) x
)"""
