"""From fetched posts to candidates: scores, filters, the funnel's counts, selection by keyword and author."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times

MICROBLOG, NOTES = "microblog", "notes"


@dataclass(frozen=True)
class Params:
    """What a run is asked for."""

    now: datetime
    handles: Sequence[str] = ()
    topic: Sequence[str] = ()
    positive: Sequence[str] = ()
    blacklist: Sequence[str] = ()
    min_interaction: int = 500
    trusted_min: int = 1000
    bypass: int = 5000
    days: Mapping[str, int] = field(default_factory=lambda: {MICROBLOG: 7, NOTES: 3})

    @property
    def now_column(self) -> Column:
        return F.lit(self.now.isoformat(" ")).cast("timestamp_ntz")


def number(c: Column) -> Column:
    """A metric as a number; blank and unreadable ones count 0."""
    n = F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(n) | n.isin(float("inf"), float("-inf")), 0).otherwise(n).cast("long")


def interaction(posts: DataFrame) -> Column:
    """Likes and comments; on the microblog the raw metrics count first, if the posts carry them."""
    likes, comments = F.col("likes"), F.col("comments")
    if "metrics_raw" in posts.columns:
        micro = F.col("platform") == MICROBLOG
        likes = F.when(micro, F.coalesce("metrics_raw.like_count", likes.cast("string"))).otherwise(likes.cast("string"))
        comments = F.when(micro, F.coalesce("metrics_raw.reply_count", comments.cast("string"))).otherwise(comments.cast("string"))
    return number(likes) + number(comments)


def is_trusted(handles: Sequence[str]) -> Column:
    """Microblog posts of the handles, in any case, with or without a leading @."""
    names = sorted({h.lstrip("@").strip().lower() for h in handles} - {""})
    return (F.col("platform") == MICROBLOG) & T.handle(F.col("author")).isin(*names) if names else F.lit(False)


def mark_trusted(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """posts with `trusted`, by a table of handles: a dimension of one owner, of a few hundred rows at most."""
    names = handles.select(T.handle(F.col("handle")).alias("_handle")).where("_handle <> ''").distinct().withColumn("_known", F.lit(True))
    joined = posts.withColumn("_handle", T.handle(F.col("author"))).join(names, "_handle", "left")
    return joined.withColumn("trusted", F.coalesce("_known", F.lit(False)) & (F.col("platform") == MICROBLOG)).drop("_handle", "_known")


def enough(score: Column, trusted: Column, p: Params) -> Column:
    """The bar for posts of trusted authors is their own; no bar at all if the general one isn't positive."""
    return F.lit(True) if p.min_interaction <= 0 else score >= F.when(trusted, p.trusted_min).otherwise(p.min_interaction)


def on_topic(p: Params) -> Column:
    return T.relevant(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("descr", F.lit(""))), p.topic)


def good(score: Column, trusted: Column, p: Params) -> Column:
    """High engagement passes; the blacklist fails; trusted authors pass; else one positive term, if there are any."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("descr", F.lit(""))))
    low = lambda words: [w.lower() for w in words if w]
    passes = F.lit(True) if not low(p.positive) else T.any_keyword(text, low(p.positive))
    return F.when(score >= p.bypass, True).when(T.any_keyword(text, low(p.blacklist)), False).when(trusted, True).otherwise(passes)


def flags(posts: DataFrame, p: Params) -> DataFrame:
    """posts with score, trusted and s1..s4: whether they pass the first one to four filters."""
    marked = posts if "trusted" in posts.columns else posts.withColumn("trusted", is_trusted(p.handles))
    marked = marked.withColumn("score", interaction(marked))
    score, trusted = F.col("score"), F.col("trusted")
    steps = [enough(score, trusted, p), times.recent(F.col("published_at"), p.now_column, F.col("platform"), p.days), on_topic(p), good(score, trusted, p)]
    passed = None
    for i, step in enumerate(steps, 1):
        # Later steps, which read the texts, run only for what passed so far.
        passed = step if passed is None else F.when(F.col(f"s{i - 1}"), step).otherwise(False)
        marked = marked.withColumn(f"s{i}", passed)
    return marked


def candidates(posts: DataFrame, p: Params) -> DataFrame:
    """What passes all filters, one post for each address, the last."""
    return dedup_last(flags(posts, p).where("s4"))


def dedup_last(posts: DataFrame) -> DataFrame:
    """The last post, by seq, of each address; blank addresses go. max_by combines before the shuffle."""
    rows = posts.where("coalesce(source_url, '') <> ''")
    return rows.groupBy("source_url").agg(F.max_by(F.struct(*[c for c in posts.columns if c != "source_url"]), "seq").alias("p")).select(*[F.col("source_url") if c == "source_url" else F.col(f"p.{c}") for c in posts.columns])


def funnel(posts: DataFrame, p: Params) -> DataFrame:
    """Counts after each step by platform, and over all (platform 'all'): one pass, one shuffle of small rows."""
    by_url = flags(posts, p).groupBy("platform", F.when(F.col("s4"), F.nullif(F.col("source_url"), F.lit(""))).alias("url")).agg(F.count("*").alias("fetched"), *[F.count_if(f"s{i}").alias(f"s{i}") for i in range(1, 5)])
    total = by_url.groupingSets([["platform"], []], "platform").agg(F.grouping_id().alias("_all"), *[F.sum(c).alias(c) for c in ("fetched", "s1", "s2", "s3", "s4")], F.count_distinct("url").alias("candidates"))
    return total.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("platform")).alias("platform"), "fetched", "s1", "s2", "s3", "s4", "candidates")


def task_minimum(posts: DataFrame, minimum: str | None) -> DataFrame:
    """Posts whose likes, bookmarks and comments reach a minimum given as text; no filter if it isn't a number."""
    try:
        bar = float((minimum or "").strip())
    except ValueError:
        return posts
    return posts.where(number(F.col("likes")) + number(F.col("bookmarks")) + number(F.col("comments")) >= bar)


def clamp(n: int, low: int = 10, high: int = 100) -> int:
    return max(low, min(high, n))


def select_by_keyword(posts: DataFrame, keywords: Sequence[str], n: int, salts: int = 16) -> DataFrame:
    """For each keyword its n newest posts that hold it; a post may come under several keywords.

    Keywords are few and popular, so each one's best are found within salts first and then among those.
    """
    words = [k for k in keywords if k]
    held = F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda k: F.contains(F.lower("descr"), F.lower(k)))
    rows = posts.withColumn("keyword", F.explode(held)).withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(salts)))
    newest = [F.col("published_at").desc_nulls_last(), F.col("seq")]
    some = rows.withColumn("_rank", F.row_number().over(W.partitionBy("keyword", "_salt").orderBy(*newest))).where(F.col("_rank") <= clamp(n))
    return some.withColumn("rank", F.row_number().over(W.partitionBy("keyword").orderBy(*newest))).where(F.col("rank") <= clamp(n)).drop("_salt", "_rank")


def select_combined(posts: DataFrame, keywords: Sequence[str], n: int, tasks: int = 3) -> DataFrame:
    """The n newest posts that hold any of the first `tasks` keywords."""
    return posts.where(T.any_keyword(F.lower("descr"), [k.lower() for k in keywords[:tasks]])).orderBy(F.col("published_at").desc_nulls_last(), "seq").limit(clamp(n))


def trusted_feed(posts: DataFrame, handles: Sequence[str], limit: int) -> DataFrame:
    """The newest posts of trusted authors."""
    names = sorted({h.lstrip("@").strip().lower() for h in handles} - {""})
    return posts.where(is_trusted(handles)).orderBy(F.col("published_at").desc_nulls_last(), "seq").limit(clamp(limit * min(len(names), 3)))


def matches_query(keywords: Sequence[str], required: Sequence[str], text: str = "descr") -> Column:
    """Any keyword and any required term, quotes stripped; an empty list asks nothing. With media, neither repost nor reply."""
    t = F.lower(F.coalesce(text, F.lit("")))
    groups = [[w.replace('"', "").strip().lower() for w in words] for words in (keywords, required)]
    out = F.lit(True)
    for words in groups:
        if any(words):
            out = out & T.any_keyword(t, words)
    return out & (F.size("images") > 0) & ~F.coalesce("is_repost", F.lit(False)) & ~F.coalesce("is_reply", F.lit(False))


# The weights of a search's sort codes.
SORTS = {"popular": "likes + 2 * comments + bookmarks + 2 * shares", "likes": "likes", "comments": "comments", "bookmarks": "bookmarks", "latest": "published"}


def rank_posts(posts: DataFrame, sort: str, limit: int) -> DataFrame:
    """The best posts by a code, in order; zero scores go if enough others remain; unknown codes keep the input's order."""
    n = max(1, min(100, limit))
    if sort not in SORTS:
        return posts.orderBy("seq").limit(n)
    if sort == "latest":
        return posts.orderBy(F.col("published_at").desc_nulls_last(), "seq").limit(n)
    top = posts.withColumn("score", F.expr(SORTS[sort]).cast("long")).orderBy(F.col("score").desc(), "seq").limit(n)
    # Among the n best, zeros are last: they go if at least min(n, 5) of them aren't zero.
    marked = top.withColumn("_some", F.count_if(F.col("score") > 0).over(W.partitionBy()))
    return marked.where((F.col("score") > 0) | (F.col("_some") < min(n, 5))).drop("_some")


def audit_samples(posts: DataFrame, p: Params, n: int = 40) -> DataFrame:
    """The first posts of a run with the decisions on them."""
    return flags(posts, p).orderBy("seq").limit(n).select("seq", "platform", "score", "trusted", "s1", "s2", "s3", "s4")


def platform_totals(posts: DataFrame, p: Params) -> DataFrame:
    return flags(posts, p).groupBy("platform").agg(F.count("*").alias("fetched"), F.count_if("s4").alias("output"))


def platform_stats(posts: DataFrame) -> DataFrame:
    """Fetched posts by platform, and by keyword on notes, with how many came from trusted authors."""
    return posts.groupBy("platform", F.when(F.col("platform") == NOTES, F.col("keyword")).alias("keyword")).agg(F.count("*").alias("n"), F.count_if("trusted").alias("n_trusted"))


def unseen(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Posts whose address is in none of the known tables, the first of each address; blank ones go."""
    rows = posts.where("coalesce(source_url, '') <> ''").join(known.select("source_url").distinct(), "source_url", "left_anti")
    return rows.groupBy("source_url").agg(F.min_by(F.struct(*[c for c in posts.columns if c != "source_url"]), "seq").alias("p")).select(*[F.col("source_url") if c == "source_url" else F.col(f"p.{c}") for c in posts.columns])
