"""One query for each operator that the given tables can show, with the same rows in SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import prompts as P
from ..functions import text as T
from ..functions import times
from ..functions import urls as U
from ..operators import audit, cards, collections, funnel
from ..sources import tables
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARAMS = A.PARAMS
KEYWORDS = ("ther", "eau", "ung", "ción")


def query(name: str, source: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> Callable:
    """Registers a query: a function of the table that `source` makes."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(source(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def with_collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.cards(spark, sf_dir), A.collections(spark, sf_dir)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", "url")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "conversations")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# White space of all scripts, as a class of DuckDB's patterns.
_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _once(values: str) -> str:
    """A list in SQL with each value once, where it comes first."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def _any(text: str, words: Sequence[str]) -> str:
    """Whether a text in SQL holds any of the words."""
    return f"len(list_filter({list(words)!r}, lambda w: contains({text}, w))) > 0"


def _first_category(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(text, words)} THEN '{name}'" for name, words in K.FIRST_MATCH.items()) + " ELSE '' END"


# The funnel.


@query("fl6_funnel", A.posts, f"""WITH {A.POSTS}, {A.FLAGS}
SELECT coalesce(platform, 'all') AS platform, count(*)::BIGINT AS fetched, (count(*) FILTER (WHERE s1))::BIGINT AS s1, (count(*) FILTER (WHERE s2))::BIGINT AS s2, (count(*) FILTER (WHERE s3))::BIGINT AS s3,
  (count(*) FILTER (WHERE s4))::BIGINT AS s4, count(DISTINCT CASE WHEN s4 THEN source_url END)::BIGINT AS candidates FROM flags GROUP BY GROUPING SETS ((platform), ())""")
def _(posts):
    return funnel.funnel(posts, PARAMS)


@query("fl1_interaction", A.posts, f"WITH {A.POSTS} SELECT seq, likes + comments AS score FROM posts")
def _(posts):
    return posts.select("seq", funnel.interaction(posts).alias("score"))


@query("fl2_min_interaction", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq, score, trusted FROM flags WHERE s1")
def _(posts):
    return funnel.flags(posts, PARAMS).where("s1").select("seq", "score", "trusted")


@query("fl3_recent", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq, platform FROM flags WHERE r2")
def _(posts):
    return posts.where(times.recent(F.col("published_at"), PARAMS.now_column, F.col("platform"), PARAMS.days)).select("seq", "platform")


@query("fl4_topic", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq FROM flags WHERE r3")
def _(posts):
    return posts.where(funnel.on_topic(PARAMS)).select("seq")


@query("fl5_quality", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq, score, trusted FROM flags WHERE r4")
def _(posts):
    marked = posts.withColumns({"trusted": funnel.is_trusted(PARAMS.handles), "score": funnel.interaction(posts)})
    return marked.where(funnel.good(F.col("score"), F.col("trusted"), PARAMS)).select("seq", "score", "trusted")


@query("fl7_task_minimum", A.posts, f"WITH {A.POSTS} SELECT seq FROM posts WHERE likes + bookmarks + comments >= 6000.5")
def _(posts):
    return funnel.task_minimum(posts, " 6000.5 ").select("seq")


@query("fl10_matches_query", A.posts, f"WITH {A.POSTS} SELECT seq FROM posts WHERE (contains(lower(descr), 'ther') OR contains(lower(descr), 'eau')) AND contains(lower(descr), 'and')")
def _(posts):
    media = posts.withColumns({"images": F.array("source_url"), "is_repost": F.lit(False), "is_reply": F.lit(False)})
    return media.where(funnel.matches_query(['"ther"', "eau"], ["and"])).select("seq")


@query("fl11_published_within", A.posts, f"WITH {A.POSTS} SELECT seq FROM posts WHERE epoch(TIMESTAMP '2024-01-31') - epoch(published_at) BETWEEN 20 AND 604820")
def _(posts):
    return posts.where(times.published_within(F.col("published_at"), PARAMS.now_column, "6m")).select("seq")


@query("jn5_mark_trusted", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq, trusted FROM flags")
def _(posts):
    handles = posts.sparkSession.createDataFrame([("@src3",), (" SRC7",)], "handle string")
    return funnel.mark_trusted(posts, handles).select("seq", "trusted")


@query("dd1_candidates", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT source_url, max(seq) AS seq, arg_max(score, seq) AS score, arg_max(platform, seq) AS platform FROM flags WHERE s4 AND source_url <> '' GROUP BY source_url")
def _(posts):
    return funnel.candidates(posts, PARAMS).select("source_url", "seq", "score", "platform")


@query("ag3_platform_totals", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT platform, count(*)::BIGINT AS fetched, (count(*) FILTER (WHERE s4))::BIGINT AS output FROM flags GROUP BY platform")
def _(posts):
    return funnel.platform_totals(posts, PARAMS)


@query("ag4_platform_stats", A.posts, f"""WITH {A.POSTS}, {A.FLAGS}, x AS (SELECT *, unnest([w for w in ['ther', 'eau', 'ung', 'ción'] if contains(lower(descr), w)]) AS keyword FROM flags)
SELECT platform, CASE WHEN platform = 'notes' THEN keyword END AS keyword, count(*)::BIGINT AS n, (count(*) FILTER (WHERE trusted))::BIGINT AS n_trusted FROM x GROUP BY 1, 2""")
def _(posts):
    held = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower("descr"), k))
    return funnel.platform_stats(posts.select("platform", funnel.is_trusted(PARAMS.handles).alias("trusted"), F.explode(held).alias("keyword")))


@query("jn2_select_by_keyword", A.posts, f"""WITH {A.POSTS}, x AS (SELECT seq, published_at, unnest([w for w in ['ther', 'eau', 'ung', 'ción'] if contains(lower(descr), w)]) AS keyword FROM posts),
r AS (SELECT seq, keyword, row_number() OVER (PARTITION BY keyword ORDER BY published_at DESC NULLS LAST, seq)::INTEGER AS rank FROM x) SELECT * FROM r WHERE rank <= 30""")
def _(posts):
    return funnel.select_by_keyword(posts, KEYWORDS, 30).select("seq", "keyword", "rank")


@query("jn3_select_combined", A.posts, f"WITH {A.POSTS} SELECT seq FROM posts WHERE contains(lower(descr), 'ther') OR contains(lower(descr), 'eau') OR contains(lower(descr), 'ung') ORDER BY published_at DESC NULLS LAST, seq LIMIT 100")
def _(posts):
    return funnel.select_combined(posts, KEYWORDS, 500).select("seq")


@query("jn4_trusted_feed", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq FROM flags WHERE trusted ORDER BY published_at DESC NULLS LAST, seq LIMIT 60")
def _(posts):
    return funnel.trusted_feed(posts, PARAMS.handles, 30).select("seq")


@query("wn3_rank_posts", A.posts, f"WITH {A.POSTS} SELECT seq, likes + 2 * comments + bookmarks + 2 * shares AS score FROM posts ORDER BY score DESC, seq LIMIT 50")
def _(posts):
    return funnel.rank_posts(posts, "popular", 50).select("seq", "score")


@query("wn8_audit_samples", A.posts, f"WITH {A.POSTS}, {A.FLAGS} SELECT seq, platform, score, trusted, s1, s2, s3, s4 FROM flags ORDER BY seq LIMIT 40")
def _(posts):
    return funnel.audit_samples(posts, PARAMS)


@query("stu_union", A.posts, f"""WITH {A.POSTS}, {A.FLAGS} SELECT origin, count(*)::BIGINT AS n FROM (SELECT 'keyword' AS origin FROM posts WHERE contains(lower(descr), 'ther') UNION ALL SELECT 'trusted' FROM flags WHERE trusted) x GROUP BY origin""")
def _(posts):
    found = posts.where(T.any_keyword(F.lower("descr"), ["ther"])).select(F.lit("keyword").alias("origin"))
    return found.unionByName(posts.where(funnel.is_trusted(PARAMS.handles)).select(F.lit("trusted").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("jn8_unseen_posts", A.posts, f"WITH {A.POSTS} SELECT source_url, min(seq) AS seq FROM posts WHERE source_url NOT IN (SELECT source_url FROM posts WHERE seq % 5 = 0) AND source_url <> '' GROUP BY source_url")
def _(posts):
    return funnel.unseen(posts, posts.where("seq % 5 = 0")).select("source_url", "seq")


@query("ag10_task_stats", A.posts, f"WITH {A.POSTS} SELECT author AS id, (count(*) FILTER (WHERE likes + bookmarks + comments >= 6000))::BIGINT AS items_found FROM posts GROUP BY author")
def _(posts):
    return audit.task_stats(funnel.task_minimum(posts, "6000").select(F.col("author").alias("task_id")), posts.select(F.col("author").alias("id")).distinct())


# Cards.


@query("sc1_card_defaults", A.cards, f"WITH {A.CARDS} SELECT id, source_url, coalesce(summary, '') AS summary, len(usage_scenarios)::INTEGER AS n_scenarios FROM cards")
def _(c):
    return cards.with_defaults(c).select("id", "source_url", "summary", F.size("usage_scenarios").alias("n_scenarios"))


@query("sc2_trending_rows", A.posts, f"""WITH {A.POSTS} SELECT seq, 'o1' AS owner_id, true AS is_public, CASE WHEN title <> '' THEN title ELSE substring(descr, 1, 40) END AS title, source_url, platform, author, coalesce(publish_time, '') AS date, 'ToolReview' AS content_type,
CASE WHEN descr = '' THEN '暂无摘要' WHEN length(descr) > 160 THEN substring(descr, 1, 160) || '...' ELSE descr END AS summary, likes, bookmarks, comments, md5(descr) AS raw_content, '' AS cover_image, true AS is_trending, '' AS user_notes, 0 AS n_lists FROM posts""")
def _(posts):
    rows = cards.trending_rows(posts, "snapshot:2024-01-31", "o1").withColumns({"raw_content": F.md5("raw_content"), "cover_image": F.coalesce("cover_image", F.lit("")), "n_lists": sum((F.size(c) for c in ("collections", *cards.ANALYSED)), F.lit(0))})
    return rows.drop("tags", "collections", *cards.ANALYSED)


@query("sc2_trending_tags", A.posts, f"""WITH {A.POSTS}, b AS (SELECT *, lower(CASE WHEN coalesce(descr, '') <> '' THEN descr ELSE coalesce(title, '') END) AS base FROM posts),
t AS (SELECT *, CASE WHEN {_any('base', K.RELEVANT)} THEN {_first_category('base')} ELSE '' END AS category FROM b),
l AS (SELECT seq, list_concat(CASE WHEN category <> '' THEN [category] ELSE [] END, [t for t in tags if t <> ''], regexp_extract_all(coalesce(descr, ''), '#([^{_BLANK}#]+)', 1), ['snapshot:2024-01-31']) AS found FROM t)
SELECT seq, array_to_string({_once('found')}, '|') AS tags FROM l""")
def _(posts):
    return cards.trending_rows(posts, "snapshot:2024-01-31", "o1").select("seq", joined(F.col("tags")).alias("tags"))


def analysed(posts: DataFrame) -> DataFrame:
    """An analysis of every third post."""
    some = posts.where("seq % 3 = 0")
    return some.select(
        "seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("About "), F.substring("descr", 1, 20))).alias("summary"), F.concat(F.lit(" Title of "), F.col("seq").cast("string")).alias("suggested_title"), F.when(F.col("seq") % 4 == 0, "My VIBE work").when(F.col("seq") % 4 == 1, "videos").otherwise("Other").alias("category"),
        F.array(F.lit("Tool"), F.lit(""), F.lit("Image Gen"), F.col("author")).alias("tool_tags"), F.array(F.lit("use")).alias("usage_scenarios"), F.when(F.col("seq") % 9 == 0, F.array(F.lit("runway sora"), F.lit("kling"))).otherwise(F.array(F.lit("plain"))).alias("core_knowledge"),
        F.when(F.col("seq") % 5 == 0, F.array("descr")).otherwise(F.array().cast("array<string>")).alias("extracted_prompts"),
    )


_COUNTS = ", ".join(f"len(list_filter({words!r}, lambda w: contains(t, w))) AS s{i}" for i, words in enumerate(K.SCORED.values()))
_UNTIED = "CASE " + " ".join(f"WHEN s{i} > s{j} AND s{i} > s{k} THEN '{name}'" for (i, name), (j, k) in zip(enumerate(K.SCORED), ((1, 2), (0, 2), (0, 1)), strict=True)) + " END"


@query("sc3_library_rows", lambda spark, sf_dir: A.posts(spark, sf_dir).withColumn("cover_image", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("https://i/"), F.col("seq").cast("string"))).when(F.col("seq") % 7 == 1, "/fallback-covers/cover-007.svg")), f"""WITH {A.POSTS}, a AS (
  SELECT *, seq % 3 = 0 AS y, CASE WHEN seq % 6 = 0 THEN 'About ' || substring(descr, 1, 20) ELSE '' END AS told, CASE WHEN seq % 9 = 0 THEN 'runway sora kling' WHEN seq % 3 = 0 THEN 'plain' ELSE '' END AS core,
    CASE WHEN seq % 7 = 0 THEN 'https://i/' || seq ELSE '' END AS cover FROM posts
), b AS (SELECT *, lower(array_to_string([x for x in [title, descr, told, core] if x <> ''], chr(10))) AS t FROM a
), c AS (SELECT *, {_COUNTS} FROM b
), d AS (SELECT *, coalesce({_UNTIED}, CASE WHEN y AND seq % 4 = 0 THEN 'Vibe Coding' WHEN y AND seq % 4 = 1 THEN 'Video Gen' ELSE '' END) AS category,
  CASE WHEN s1 > 0 AND s1 >= s0 AND s1 >= s2 THEN 'Video Gen' WHEN s0 > 0 AND s0 >= s2 THEN 'Image Gen' WHEN s2 > 0 THEN 'Vibe Coding' ELSE '' END AS scored FROM c
), e AS (SELECT *, CASE WHEN category <> '' THEN category WHEN scored <> '' THEN scored ELSE 'Vibe Coding' END AS semantic,
  list_concat([x for x in tags if x <> '' AND x NOT IN ('Image Gen', 'Video Gen', 'Vibe Coding')], [x for x in regexp_extract_all(descr, '#([^{_BLANK}#]+)', 1)[1:5] if x NOT IN ('Image Gen', 'Video Gen', 'Vibe Coding')], CASE WHEN y THEN ['Tool', author] ELSE [] END) AS found FROM d)
SELECT seq, CASE WHEN trim(title) <> '' THEN trim(title, ' ' || chr(10)) WHEN title = '' AND y THEN 'Title of ' || seq ELSE trim(substring(descr, 1, 30), ' ' || chr(10)) END AS title, source_url, platform, author, coalesce(publish_time, '') AS date,
  CASE WHEN cover <> '' THEN cover ELSE '/dashboard-fallbacks/semantic-' || replace(lower(semantic), ' ', '-') || '.svg' END AS cover_image, likes, bookmarks, comments, CASE WHEN y AND seq % 5 = 0 THEN 'PromptShare' ELSE 'ToolReview' END AS content_type, md5(descr) AS raw_content,
  CASE WHEN told <> '' THEN told WHEN length(descr) > 150 THEN substring(descr, 1, 150) || '...' ELSE descr END AS summary, CASE WHEN y THEN 'use' ELSE '' END AS usage_scenarios, CASE WHEN seq % 9 = 0 THEN 'runway sora|kling' WHEN y THEN 'plain' ELSE '' END AS core_knowledge,
  CASE WHEN y AND seq % 5 = 0 THEN 1 ELSE 0 END AS n_prompts, array_to_string(list_concat({_once('found')}, CASE WHEN category <> '' THEN [category] ELSE [] END), '|') AS tags FROM e""")
def _(posts):
    rows = cards.library_rows(posts, analysed(posts)).withColumns({"raw_content": F.md5("raw_content"), "n_prompts": F.size("extracted_prompts"), **{c: joined(F.col(c)) for c in ("tags", "usage_scenarios", "core_knowledge")}})
    return rows.drop("extracted_prompts", "images", "user_notes", "collections")


@query("sc4_ensured_tags", A.cards, f"""WITH {A.CARDS}, b AS (SELECT id, lower(raw_content) AS t, CASE WHEN seq % 3 = 0 THEN [t for t in tags if starts_with(t, 'snapshot:')] ELSE tags END AS bare FROM cards),
c AS (SELECT *, {_first_category('t')} AS category FROM b)
SELECT id, array_to_string(CASE WHEN len([t for t in bare if NOT starts_with(t, 'snapshot:')]) > 0 THEN bare ELSE list_prepend(CASE WHEN category = '' THEN 'Vibe Coding' ELSE category END, bare) END, '|') AS tags FROM c""")
def _(c):
    bare = F.when(F.col("seq") % 3 == 0, F.filter("tags", lambda t: t.startswith(cards.SNAPSHOT))).otherwise(F.col("tags"))
    return c.select("id", joined(cards.ensured_tags(bare, F.col("raw_content"))).alias("tags"))


@query("sc5_needs_analysis", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE summary = '' OR len(usage_scenarios) = 0")
def _(c):
    return c.where(cards.needs_analysis()).select("id")


@query("sc6_preferred_title", A.cards, f"WITH {A.CARDS} SELECT id, CASE WHEN platform = 'microblog' AND user_notes <> '' THEN user_notes ELSE trim(title, ' ' || chr(10)) END AS title FROM cards")
def _(c):
    return c.select("id", cards.preferred_title(F.col("platform"), F.col("title"), F.col("user_notes")).alias("title"))


@query("sc7_backfill_owner", A.cards, f"WITH {A.CARDS} SELECT id, coalesce(owner_id, 'o9') AS owner_id, is_public OR owner_id IS NULL AS is_public FROM cards")
def _(c):
    return cards.backfill_owner(c, "o9").select("id", "owner_id", "is_public")


@query("sc9_display_tags", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string([t for t in tags if not starts_with(t, 'snapshot:')][1:1], '|') AS tags FROM cards")
def _(c):
    return c.select("id", joined(F.slice(cards.plain_tags(F.col("tags")), 1, 1)).alias("tags"))


@query("fl8_search_cards", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE (contains(lower(title), 'the') OR len([t for t in tags if contains(lower(t), 'the')]) > 0) AND list_contains(tags, 'en') AND (list_contains(collections, 'c1') OR list_contains(collections, 'c2'))")
def _(c):
    return cards.search_cards(c, " The ", "EN", ["c1", "c2"]).select("id")


@query("fl9_visible", A.cards, f"WITH {A.CARDS} SELECT id, coalesce(owner_id = 'o2', false) AS mutable FROM cards WHERE is_public OR owner_id = 'o2'")
def _(c):
    return cards.visible_to(c, "o2").join(cards.mutable_by(c, "o2").select("id", F.lit(True).alias("m")), "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("mutable"))


@query("snk5_public_part", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE owner_id IS NULL OR is_public")
def _(c):
    return cards.public_part(c).select("id")


@query("src4_list_cards", A.cards, f"WITH {A.CARDS} SELECT id, title, likes FROM cards WHERE is_trending ORDER BY created_at DESC, id LIMIT 60 OFFSET 60")
def _(c):
    return cards.list_cards(c, True, 60, 60).select("id", "title", "likes")


@query("src6_card_by_id", A.cards, f"WITH {A.CARDS} SELECT id, title, raw_content FROM cards WHERE id = 'k42'")
def _(c):
    return cards.card_by_id(c, "k42").select("id", "title", "raw_content")


@query("fn28_page", A.cards, f"WITH {A.CARDS} SELECT id FROM cards ORDER BY likes DESC, id LIMIT 20 OFFSET 40")
def _(c):
    return tables.page(c, 3, 20, F.col("likes").desc(), "id").select("id")


@query("dd8_completeness", A.cards, f"WITH {A.CARDS} SELECT id, round({A.SCORE.format(w='15.0')}, 6) AS score, round({A.SCORE.format(w='20.0')} + CASE WHEN is_trending THEN 0 ELSE 200 END, 6) AS cleanup_score FROM cards")
def _(c):
    return c.select("id", F.round(cards.completeness(), 6).alias("score"), F.round(cards.cleanup_score(), 6).alias("cleanup_score"))


@query("dd9_dedup_key", A.cards, f"WITH {A.KEYS} SELECT id, 'owner:' || coalesce(owner_id, 'public') || '|' || key AS library_key, key AS cleanup_key FROM k")
def _(c):
    return c.select("id", cards.dedup_key().alias("library_key"), cards.dedup_key(False).alias("cleanup_key"))


@query("dd2_dedup_cards", A.cards, f"""WITH {A.KEYS}, o AS (SELECT *, 'owner:' || coalesce(owner_id, 'public') || '|' || key AS library_key FROM k)
SELECT arg_min(id, struct_pack(a := created_at, b := id)) AS id, max(likes) AS likes, max(bookmarks) AS bookmarks, max(comments) AS comments, count(*)::INTEGER AS n_merged, bool_or(is_public) AS is_public, max(length(raw_content))::INTEGER AS text_size FROM o GROUP BY library_key""")
def _(c):
    return cards.dedup_cards(c).select("id", "likes", "bookmarks", "comments", "n_merged", "is_public", F.length("raw_content").alias("text_size"))


@query("dd3_cleanup_cards", A.cards, f"""WITH {A.KEYS}, s AS (SELECT *, {A.SCORE.format(w='20.0')} + CASE WHEN is_trending THEN 0.0::DOUBLE ELSE 200.0::DOUBLE END AS score FROM k)
SELECT arg_min(id, struct_pack(a := -score, b := created_at, c := id)) AS id, max(likes) AS likes, max(bookmarks) AS bookmarks, max(comments) AS comments, bool_and(is_trending) AS is_trending, max(length(raw_content))::INTEGER AS text_size, count(*) - 1 AS n_deleted FROM s GROUP BY key HAVING count(*) > 1""")
def _(c):
    return cards.cleanup_cards(c).select("id", "likes", "bookmarks", "comments", "is_trending", F.length("raw_content").alias("text_size"), "n_deleted")


@query("dd3_cleanup_deletes", A.cards, f"""WITH {A.KEYS}, s AS (SELECT *, {A.SCORE.format(w='20.0')} + CASE WHEN is_trending THEN 0.0::DOUBLE ELSE 200.0::DOUBLE END AS score FROM k)
SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY score DESC, created_at, id) AS keeper FROM s QUALIFY id <> first_value(id) OVER (PARTITION BY key ORDER BY score DESC, created_at, id)""")
def _(c):
    return cards.cleanup_deletes(c)


@query("dd6_unique_trending", A.cards, f"""WITH {A.CARDS}, t AS (SELECT *, CASE WHEN source_url IN ('', '#') THEN concat_ws('|', title, author) ELSE split_part(source_url, '?', 1) END AS key FROM cards WHERE is_trending)
SELECT arg_min(id, seq) AS id FROM t GROUP BY key""")
def _(c):
    return cards.unique_trending(c.where("is_trending")).select("id")


@query("dd7_append_page", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE seq % 4 < 2 OR seq % 6 = 2")
def _(c):
    rows = c.select("id", "seq")
    return tables.append_page(rows.where("seq % 4 < 2"), rows.where("seq % 6 = 2")).select("id")


@query("jn6_new_candidates", A.cards, f"""WITH {A.CARDS}, c AS (SELECT id, seq, coalesce(owner_id, 'public') AS o, is_trending, trim(split_part(source_url, '?', 1)) AS key FROM cards),
k AS (SELECT DISTINCT o, key FROM c WHERE is_trending AND seq % 3 <> 1) SELECT c.id FROM c LEFT JOIN k ON c.o = k.o AND c.key = k.key WHERE c.seq % 3 = 1 AND k.o IS NULL""")
def _(c):
    return cards.new_candidates(c.where("seq % 3 = 1"), c.where("seq % 3 <> 1")).select("id")


@query("jn7_refresh_existing", A.cards, f"""WITH {A.CARDS}, f AS (SELECT split_part(source_url, '?', 1) AS key, arg_max(struct_pack(t := title, r := raw_content, p := platform, a := author, n := likes), seq) AS x FROM cards WHERE seq % 3 = 1 GROUP BY 1)
SELECT c.id, c.owner_id, CASE WHEN x.t <> '' THEN x.t WHEN x.r <> '' THEN substring(x.r, 1, 40) ELSE '无标题' END AS title, x.p AS platform, x.a AS author, x.n AS likes, length(x.r)::INTEGER AS text_size, (CASE WHEN x.r <> '' AND length(x.r) > 160 THEN 163 WHEN x.r <> '' THEN length(x.r) WHEN x.t <> '' THEN least(length(x.t), 163) ELSE 4 END)::INTEGER AS summary_size,
0 AS n_collections, true AS in_snapshot FROM cards c JOIN f ON split_part(c.source_url, '?', 1) = f.key WHERE c.is_trending AND c.seq % 3 <> 1 AND f.key <> '' AND c.owner_id = 'o1'""")
def _(c):
    out = cards.refresh_existing(c.where("seq % 3 <> 1"), c.where("seq % 3 = 1").withColumnRenamed("raw_content", "descr"), "snapshot:2024-02-01", "o1")
    return out.select("id", "owner_id", "title", "platform", "author", "likes", F.length("raw_content").alias("text_size"), F.length("summary").alias("summary_size"), F.size("collections").alias("n_collections"), (cards.latest_snapshot(F.col("tags")) == "snapshot:2024-02-01").alias("in_snapshot"))


@query("jn11_promote", A.cards, f"""WITH {A.KEYS}, ch AS (SELECT * FROM k WHERE is_trending AND seq % 6 = 2), ck AS (SELECT coalesce(owner_id, 'public') AS o, url FROM ch WHERE url <> '' GROUP BY 1, 2),
lib AS (SELECT k.* FROM k JOIN ck ON coalesce(k.owner_id, 'public') = ck.o AND k.url = ck.url WHERE NOT is_trending QUALIFY row_number() OVER (PARTITION BY coalesce(k.owner_id, 'public'), k.url ORDER BY created_at DESC, id) = 1),
b AS (SELECT *, false AS late FROM lib UNION ALL SELECT *, true FROM ch) SELECT arg_min(id, struct_pack(a := late, b := created_at, c := id)) AS id, count(*)::INTEGER AS n_merged, max(likes) AS likes FROM b GROUP BY coalesce(owner_id, 'public'), key""")
def _(c):
    return cards.promote(c, c.where("seq % 6 = 2").select("id")).select("id", "n_merged", "likes")


@query("wn4_kept_snapshots", A.cards, f"""WITH {A.CARDS}, s AS (SELECT id, coalesce(owner_id, 'public') AS o, coalesce(list_max([t for t in tags if starts_with(t, 'snapshot:')]), 'snapshot:legacy') AS snapshot FROM cards WHERE is_trending),
t AS (SELECT DISTINCT o, snapshot FROM s), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY o ORDER BY snapshot <> 'snapshot:legacy' DESC, snapshot DESC) <= 5) SELECT s.id, s.snapshot FROM s JOIN k ON s.o = k.o AND s.snapshot = k.snapshot""")
def _(c):
    return cards.kept_snapshots(c).select("id", "snapshot")


@query("wn5_current_trending", A.cards, f"""WITH {A.KEYS}, n AS (SELECT * FROM k WHERE is_trending ORDER BY created_at DESC, id LIMIT 60),
g AS (SELECT max(likes) AS likes, count(*)::INTEGER AS n_merged, coalesce(list_max([t for t in flatten(list(tags)) if starts_with(t, 'snapshot:')]), 'snapshot:legacy') AS snapshot FROM n GROUP BY coalesce(owner_id, 'public'), key)
SELECT likes, n_merged, snapshot FROM g WHERE snapshot = (SELECT max(snapshot) FROM g)""")
def _(c):
    return cards.current_trending(c).select("likes", "n_merged", "snapshot")


@query("stt_restamp", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string(CASE WHEN is_trending THEN list_append([t for t in tags if not starts_with(t, 'snapshot:')], 'snapshot:x') ELSE tags END, '|') AS tags FROM cards")
def _(c):
    return cards.restamp(c, "snapshot:x").select("id", joined(F.col("tags")).alias("tags"))


_PICK = "SELECT '{0}' AS slot, row_number() OVER (ORDER BY lang IS NOT DISTINCT FROM '{0}' DESC, likes DESC, seq)::INTEGER AS rank, id FROM {1} QUALIFY rank <= 3"


@query("wn1_category_rankings", A.cards, f"""WITH {A.CARDS}, c AS (SELECT id, likes, seq, tags[1] AS lang FROM cards), p1 AS ({_PICK.format('en', 'c')}), c2 AS (SELECT c.* FROM c ANTI JOIN p1 USING (id)), p2 AS ({_PICK.format('fr', 'c2')}),
c3 AS (SELECT c2.* FROM c2 ANTI JOIN p2 USING (id)), p3 AS ({_PICK.format('de', 'c3')}) SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def _(c):
    return cards.category_rankings(c.withColumn("category", F.col("tags")[0]), ["en", "fr", "de"])


@query("wn2_hot_picks", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE is_trending ORDER BY created_at DESC, id LIMIT 6")
def _(c):
    return cards.newest(c.where("is_trending"), 6).select("id")


@query("fn22_chat_context", A.cards, f"""WITH {A.CARDS} SELECT author || '/' || (seq // 100) AS scope, md5('cards: ' || count(*) || chr(10) || string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY id)) AS context_md5, count(*)::BIGINT AS n_cards FROM cards GROUP BY 1""")
def _(c):
    # A scope is what a user opens at once, so it is of bounded size however many cards an author has.
    shelf = F.concat("author", F.lit("/"), F.floor(F.col("seq") / 100).cast("string"))
    return cards.chat_context(c.withColumn("scope", shelf), "scope").select("scope", F.md5("context").alias("context_md5"), "n_cards")


@query("ag7_result_summary", A.cards, f"WITH {A.CARDS} SELECT count(*)::BIGINT AS candidates, (count(*) FILTER (WHERE cover_image <> ''))::BIGINT AS fallback_covers FROM cards")
def _(c):
    return audit.result_summary(c)


@query("fn22_chat_parts", A.cards, f"""WITH {A.CARDS}, s AS (SELECT *, unnest(['all', author]) AS scope FROM cards), t AS (SELECT scope, 'cards: ' || count(*) || chr(10) || string_agg('- ' || title || ': ' || summary, chr(10)) AS t FROM s GROUP BY scope)
SELECT scope, length(t)::BIGINT AS chars, (length(t) - length(replace(t, chr(10), '')))::BIGINT AS line_feeds, true AS bounded FROM t""")
def _(c):
    """All cards as one scope, and each author's: what the parts hold together, and that none is over the limit."""
    scoped = c.withColumn("scope", F.explode(F.array(F.lit("all"), "author")))
    parts = cards.chat_parts(scoped, "scope", 20_000)
    feeds = F.length("context") - F.length(F.replace("context", F.lit("\n"), F.lit("")))
    return parts.groupBy("scope").agg(F.sum(F.length("context")).alias("chars"), F.sum(feeds).alias("line_feeds"), (F.max(F.length("context")) <= 20_000).alias("bounded"))


@query("wn9_select_images", A.cards, f"""WITH RECURSIVE {A.CARDS}, i AS (SELECT 'k' || (seq // 12) AS card_id, likes * 1000 AS b, row_number() OVER (PARTITION BY seq // 12 ORDER BY seq) AS n FROM cards),
w AS (SELECT DISTINCT card_id, 0::BIGINT AS n, 0::BIGINT AS sent, 0::BIGINT AS bytes FROM i
  UNION ALL SELECT card_id, n, sent + fits::BIGINT, bytes + CASE WHEN fits THEN b ELSE 0 END FROM (SELECT i.*, w.sent, w.bytes, w.sent < 7 AND i.b > 0 AND i.b <= 5242880 AND w.bytes + i.b <= 18874368 AS fits FROM w JOIN i ON i.card_id = w.card_id AND i.n = w.n + 1) x)
SELECT card_id, arg_max(sent, n) AS sent, arg_max(bytes, n) AS bytes FROM w GROUP BY card_id""")
def _(c):
    return cards.select_images(c.select(F.concat(F.lit("k"), F.floor(F.col("seq") / 12).cast("string")).alias("card_id"), F.col("seq").alias("pos"), (F.col("likes") * 1000).alias("bytes")))


@query("fl13_missing_tokens", A.cards, f"""WITH {A.CARDS} SELECT (seq % 101)::VARCHAR AS note_id, arg_min(id, struct_pack(a := NOT is_trending, b := seq)) AS id FROM cards WHERE owner_id = 'o1' AND seq % 3 <> 0 GROUP BY 1""")
def _(c):
    address = F.concat(F.lit(U.NOTE_BASE), (F.col("seq") % 101).cast("string"), F.when(F.col("seq") % 3 == 0, "?xsec_token=t").otherwise("?a=b"))
    return audit.missing_token_items(c.withColumn("source_url", address), "o1")


@query("jn9_apply_tokens", A.cards, f"WITH {A.CARDS} SELECT id, '{U.NOTE_BASE}' || (seq % 101) || '?xsec_token=' || (seq % 101) || '%20t&xsec_source=pc_feed' AS source_url FROM cards WHERE owner_id = 'o1' AND seq % 101 < 50")
def _(c):
    mine = c.withColumn("source_url", F.concat(F.lit(U.NOTE_BASE), (F.col("seq") % 101).cast("string")))
    known = c.where("seq < 50").select(F.col("seq").cast("string").alias("note_id"), F.concat(F.col("seq").cast("string"), F.lit(" t")).alias("token"), F.lit("").alias("source"), F.lit(0).alias("pos"))
    return audit.apply_tokens(mine, known, "o1")


@query("snk2_upsert", A.cards, f"WITH {A.CARDS} SELECT author AS key, CASE WHEN max(seq) FILTER (WHERE seq % 2 = 1) IS NULL THEN max(seq) FILTER (WHERE seq % 2 = 0) ELSE max(seq) FILTER (WHERE seq % 2 = 1) END AS seq FROM cards GROUP BY author")
def _(c):
    rows = c.select(F.col("author").alias("key"), "seq", "created_at")
    target = tables.latest(rows.where("seq % 2 = 0"), ["key"], "created_at")
    return tables.upsert(target, rows.where("seq % 2 = 1"), ["key"], "created_at").select("key", "seq")


@query("snk3_delete", A.cards, f"WITH {A.CARDS} SELECT id FROM cards WHERE seq % 3 <> 0")
def _(c):
    return tables.delete_by_ids(c.select("id"), c.where("seq % 3 = 0").select("id"))


# Collections.


@query("ag1_collection_counts", A.cards, f"WITH {A.CARDS}, x AS (SELECT id, unnest(list_distinct([trim(c) for c in collections if trim(c) <> ''])) AS collection_id FROM cards WHERE NOT is_trending) SELECT collection_id, count(*)::BIGINT AS n_cards FROM x GROUP BY 1")
def _(c):
    return collections.collection_counts(c)


@query("ag8_scope_totals", A.cards, f"WITH {A.CARDS}, x AS (SELECT unnest(list_append(list_distinct([trim(c) for c in collections if trim(c) <> '']), 'all')) AS scope FROM cards) SELECT scope, count(*)::BIGINT AS n_cards FROM x GROUP BY 1")
def _(c):
    return collections.scope_totals(c)


@query("jn10_with_counts", with_collections, f"""WITH {A.CARDS}, {A.COLLECTIONS}, x AS (SELECT seq, unnest(list_distinct([trim(c) for c in collections if trim(c) <> ''])) AS c FROM cards WHERE NOT is_trending),
l AS (SELECT c, count(*) AS n FROM x WHERE c <> 'c3' AND c <> 'c4' GROUP BY c), p AS (SELECT c, count(*) AS n FROM x WHERE c <> 'c4' GROUP BY c)
SELECT id, coalesce(l.n, p.n, item_count)::BIGINT AS item_count FROM collections LEFT JOIN l ON l.c = id LEFT JOIN p ON p.c = id""")
def _(both):
    counts = collections.collection_counts(both[0])
    return collections.with_counts(both[1], counts.where("collection_id NOT IN ('c3', 'c4')"), counts.where("collection_id <> 'c4'")).select("id", "item_count")


_ALIASES = f"""{A.CARDS}, {A.COLLECTIONS}, refs AS (SELECT c, count(*) AS n FROM (SELECT unnest(collections) AS c FROM cards) x GROUP BY c),
r AS (SELECT id, first_value(id) OVER (PARTITION BY lower(trim(name)) ORDER BY coalesce(refs.n, 0) DESC, created_at, id) AS canonical FROM collections LEFT JOIN refs ON refs.c = id)"""


@query("dd4_cleanup_collections", with_collections, f"WITH {_ALIASES} SELECT id, canonical FROM r WHERE id <> canonical")
def _(both):
    return collections.cleanup_collections(*both)


@query("dd4_relink", with_collections, f"""WITH {_ALIASES}, e AS (SELECT cards.id, pos, coalesce(r.canonical, c) AS c FROM (SELECT id, unnest(collections) AS c, generate_subscripts(collections, 1) AS pos FROM cards) cards LEFT JOIN r ON r.id = cards.c),
o AS (SELECT id, c, min(pos) AS pos FROM e GROUP BY id, c) SELECT id, string_agg(c, '|' ORDER BY pos) AS collections FROM o GROUP BY id""")
def _(both):
    return collections.relink(both[0], collections.cleanup_collections(*both)).select("id", joined(F.col("collections")).alias("collections"))


@query("sc8_remap_collections", with_collections, f"""WITH {_ALIASES}, e AS (SELECT cards.id, pos, r.canonical AS c FROM (SELECT id, unnest(collections) AS c, generate_subscripts(collections, 1) AS pos FROM cards) cards JOIN r ON r.id = cards.c WHERE r.id <> r.canonical),
o AS (SELECT id, c, min(pos) AS pos FROM e GROUP BY id, c) SELECT cards.id, coalesce(string_agg(c, '|' ORDER BY pos), '') AS collections FROM cards LEFT JOIN o ON o.id = cards.id GROUP BY cards.id""")
def _(both):
    return collections.relink(both[0], collections.cleanup_collections(*both), keep_unmapped=False).select("id", joined(F.col("collections")).alias("collections"))


@query("dd5_display_collections", A.collections, f"""WITH {A.COLLECTIONS} SELECT coalesce(owner_id, 'public') AS owner, lower(trim(name)) AS key, arg_min(id, created_at) AS id, sum(item_count)::BIGINT AS item_count, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM collections GROUP BY 1, 2""")
def _(c):
    return collections.display_collections(c).drop("cover")


@query("ste_membership_deltas", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string([c for c in ['c1', 'c2'] if not list_contains(collections, c)], '|') AS added, array_to_string([c for c in list_distinct(['c' || (seq % 7)]) if not list_contains(['c1', 'c2'], c)], '|') AS removed FROM cards")
def _(c):
    target = F.array(F.lit("c1"), F.lit("c2"))
    return c.select("id", joined(collections.membership_deltas(F.col("collections"), target)[0]).alias("added"), joined(collections.membership_deltas(F.slice("collections", 1, 1), target)[1]).alias("removed"))


@query("sta_without_aliases", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string([c for c in collections if c not in ('c1', 'c2')], '|') AS collections FROM cards")
def _(c):
    return c.select("id", joined(collections.without_aliases(F.col("collections"), ["c1", "c2"])).alias("collections"))


@query("stb_bulk_add", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string(CASE WHEN seq % 3 = 0 AND coalesce(owner_id = 'o1', false) AND NOT list_contains(collections, 'c1') THEN list_append(collections, 'c1') ELSE collections END, '|') AS collections FROM cards")
def _(c):
    return collections.bulk_add(c, c.where("seq % 3 = 0"), "c1", "o1").select("id", joined(F.col("collections")).alias("collections"))


@query("stb_bulk_remove", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string(CASE WHEN seq % 3 = 0 AND coalesce(owner_id = 'o1', false) THEN [c for c in collections if c not in ('c1', 'c2')] ELSE collections END, '|') AS collections FROM cards")
def _(c):
    return collections.bulk_remove(c, c.where("seq % 3 = 0"), ["c1", "c2"], "o1").select("id", joined(F.col("collections")).alias("collections"))


@query("std_distinct_union", A.cards, f"WITH {A.CARDS}, e AS (SELECT id, unnest(list_concat(tags, collections)) AS t, generate_subscripts(list_concat(tags, collections), 1) AS pos FROM cards), o AS (SELECT id, trim(t) AS t, min(pos) AS pos FROM e WHERE trim(t) <> '' GROUP BY 1, 2) SELECT id, string_agg(t, '|' ORDER BY pos) AS terms FROM o GROUP BY id")
def _(c):
    return c.select("id", joined(T.distinct_texts(F.concat("tags", "collections"))).alias("terms"))


# Lists of the dashboards, whole, each in its order: the position in it is the rank.


@query("wn7_list_collections", A.collections, f"WITH {A.COLLECTIONS} SELECT id, row_number() OVER (ORDER BY created_at DESC, id)::BIGINT AS rank FROM collections")
def _(c):
    return collections.listed(c, [F.col("created_at").desc(), F.col("id")]).select("id", "rank")


@query("wn7_list_tasks", lambda spark, sf_dir: A.table(spark, sf_dir, "orders"), "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::BIGINT AS rank FROM orders")
def _(o):
    return collections.listed(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), [F.col("created_at").desc(), F.col("id")]).select("id", "rank")


@query("wn7_list_accounts", lambda spark, sf_dir: A.table(spark, sf_dir, "customer"), "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS rank FROM customer")
def _(c):
    return collections.listed(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("created_at")), [F.col("created_at").desc(), F.col("id")]).select("id", "rank")


@query("wn7_list_keywords", lambda spark, sf_dir: A.table(spark, sf_dir, "events"), "SELECT event_id AS id, event_type AS type, row_number() OVER (ORDER BY event_type, ts DESC, event_id)::BIGINT AS rank FROM events")
def _(e):
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"))
    return collections.listed(rows, [F.col("type"), F.col("created_at").desc(), F.col("id")]).select("id", "type", "rank")


# Runs.


@query("ag2_api_calls", A.calls, f"""WITH {A.CALLS} SELECT CASE WHEN grouping(platform) = 0 THEN 'platform' WHEN grouping(provider) = 0 THEN 'provider' ELSE 'total' END AS level, coalesce(platform, provider, 'all') AS name,
  count(*)::BIGINT AS calls, sum(result_count)::BIGINT AS results, (count(*) FILTER (WHERE result_count > 0))::BIGINT AS with_results FROM calls GROUP BY GROUPING SETS ((platform), (provider), ())""")
def _(c):
    return audit.api_call_summary(c)


@query("ag5_run_report", A.logs, f"""WITH {A.LOGS} SELECT id, CASE WHEN guard THEN 'SKIPPED' WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS status, greatest(1, floor(runtime_ms / 1000.0 + 0.5))::BIGINT AS seconds,
  coalesce(error_message, '') || CASE WHEN errors > 2 THEN '; notes: ' || errors ELSE '' END AS failure FROM logs""")
def _(logs):
    return audit.run_report(logs)


@query("wn6_recent_logs", A.logs, f"WITH {A.LOGS} SELECT id, created_at FROM logs ORDER BY created_at DESC LIMIT 30")
def _(logs):
    return audit.recent_logs(logs, None).select("id", "created_at")


@query("fn20_failures", A.logs, f"WITH {A.LOGS} SELECT CASE WHEN error_message IS NULL THEN 'none' WHEN contains(error_message, '401') THEN 'unauthorized' WHEN contains(error_message, '403') THEN 'forbidden' ELSE 'timeout' END AS failure, count(*)::BIGINT AS n FROM logs GROUP BY 1")
def _(logs):
    return audit.failure_counts(logs, F.col("error_message"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as settings: keys by type, the user as owner; some values aren't numbers or are negative."""
    value = F.when(F.col("event_id") % 5 == 0, "x").when(F.col("event_id") % 7 == 0, "-3").otherwise((F.col("event_id") % 1000).cast("string"))
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id"), F.col("event_type").alias("key"), value.alias("value"), F.struct("ts", "event_id").alias("updated_at"))


@query("ag6_settings", settings, """WITH s AS (SELECT 'u' || user_id AS o, event_type AS k, arg_max(CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 7 = 0 THEN '-3' ELSE (event_id % 1000)::VARCHAR END, struct_pack(t := ts, e := event_id)) AS v FROM events GROUP BY 1, 2),
w AS (SELECT o, max(CASE WHEN k = 'click' AND try_cast(v AS DOUBLE) >= 0 THEN floor(try_cast(v AS DOUBLE)) END) AS c, max(CASE WHEN k = 'view' AND try_cast(v AS DOUBLE) >= 0 THEN floor(try_cast(v AS DOUBLE)) END) AS w FROM s GROUP BY o)
SELECT o AS owner_id, coalesce(c, w, 500)::BIGINT AS click, coalesce(w, 1000)::BIGINT AS view FROM w""")
def _(rows):
    return audit.monitor_settings(rows, {"click": 500, "view": 1000}, {"click": "view"})


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id"), F.concat(F.lit(" w"), (F.col("event_id") % 97).cast("string")).alias("keyword"), F.when(F.col("event_type") == "click", "positive").when(F.col("user_id") % 10 == 0, "blacklist").otherwise("other").alias("type"), F.struct("ts", "event_id").alias("created_at"))


@query("ag9_keyword_lists", keyword_rows, """WITH k AS (SELECT 'u' || user_id AS o, 'w' || (event_id % 97) AS w, CASE WHEN event_type = 'click' THEN 'positive' WHEN user_id % 10 = 0 THEN 'blacklist' ELSE 'other' END AS t, ts, event_id FROM events)
SELECT o AS owner_id, coalesce(string_agg(w, '|' ORDER BY ts, event_id) FILTER (WHERE t = 'positive'), 'guide|demo') AS positive, coalesce(string_agg(w, '|' ORDER BY ts, event_id) FILTER (WHERE t = 'blacklist'), 'ad') AS blacklist FROM k GROUP BY o""")
def _(rows):
    return audit.keyword_lists(rows, {"positive": ["guide", "demo"], "blacklist": ["ad"]}).select("owner_id", joined(F.col("positive")).alias("positive"), joined(F.col("blacklist")).alias("blacklist"))


@query("jn12_missing_seeds", keyword_rows, """WITH k AS (SELECT DISTINCT 'w' || (event_id % 97) AS w FROM events WHERE event_type = 'click'),
s AS (SELECT DISTINCT 'w' || (event_id % 131) AS w FROM events) SELECT 'positive' AS type, upper(s.w) AS keyword FROM s LEFT JOIN k ON s.w = k.w WHERE k.w IS NULL""")
def _(rows):
    seeds = rows.select(F.lit("positive").alias("type"), F.concat(F.lit("W"), (F.col("created_at.event_id") % 131).cast("string")).alias("keyword")).distinct()
    return audit.missing_seeds(seeds, rows).select("type", "keyword")


@query("jn13_resolve_owner", A.posts, f"WITH {A.POSTS} SELECT DISTINCT 'p-' || author AS id, ' @' || upper(author) AS username FROM posts WHERE author = 'src3'")
def _(posts):
    profiles = posts.select(F.concat(F.lit("p-"), "author").alias("id"), F.concat(F.lit(" @"), F.upper("author")).alias("username")).distinct()
    return audit.resolve_owner(profiles, "@Src3 ")


# Functions of columns.


@query("fn1_published", A.posts, f"WITH {A.POSTS} SELECT seq, CASE seq % 6 WHEN 0 THEN TIMESTAMP '2024-01-31' WHEN 1 THEN TIMESTAMP '2024-01-31' - to_minutes((seq % 90)::INTEGER) WHEN 2 THEN TIMESTAMP '2024-01-31' - to_days((seq % 40)::INTEGER) WHEN 3 THEN published_at WHEN 4 THEN TIMESTAMP '2023-03-05' END AS at FROM posts")
def _(posts):
    n = lambda m: (F.col("seq") % m).cast("string")
    text = F.element_at(F.array(F.lit("刚刚"), F.concat(n(90), F.lit(" 分钟前")), F.concat(n(40), F.lit("天前")), F.col("published_at").cast("string"), F.lit("03-05"), F.lit("some day")), (F.col("seq") % 6 + 1).cast("int"))
    return posts.select("seq", times.published(text, PARAMS.now_column).alias("at"))


@query("fn2_unit_count", A.posts, f"WITH {A.POSTS} SELECT seq, CASE seq % 4 WHEN 0 THEN round(likes / 10.0 * 10000) WHEN 1 THEN round(likes / 10.0 * 1000) WHEN 2 THEN likes ELSE 0 END::DOUBLE AS n FROM posts")
def _(posts):
    x = F.format_string("%.1f", F.col("likes") / 10)
    text = F.element_at(F.array(F.concat(x, F.lit("w")), F.concat(x, F.lit(" 千")), F.regexp_replace("likes", r"(\d)(\d{3})$", "$1,$2"), F.lit("many")), (F.col("seq") % 4 + 1).cast("int"))
    return posts.select("seq", T.unit_count(text).alias("n"))


@query("fn3_hashtags", A.posts, f"WITH {A.POSTS} SELECT seq, array_to_string([t[2:] for t in regexp_extract_all(descr, '#[^\\s#]+')], '|') AS tags FROM posts")
def _(posts):
    return posts.select("seq", joined(T.hashtags(F.col("descr"))).alias("tags"))


_LISTS = {"Image Gen": ["ther", "eau"], "Video Gen": ["ung", "ther"], "Vibe Coding": ["ción", "on"]}
_HAS = "contains(lower(descr), '{0}')::INTEGER"
_SCORES = f"s AS (SELECT seq, descr, {_HAS.format('ther')} + {_HAS.format('eau')} AS i, {_HAS.format('ung')} + {_HAS.format('ther')} AS v, {_HAS.format('ción')} + {_HAS.format('on')} AS c FROM posts)"


@query("fn4_category_first", A.posts, f"WITH {A.POSTS}, {_SCORES} SELECT seq, CASE WHEN i > 0 THEN 'Image Gen' WHEN v > 0 THEN 'Video Gen' WHEN c > 0 THEN 'Vibe Coding' ELSE '' END AS category, CASE WHEN NOT contains(lower(descr), 'ai') THEN '' WHEN i > 0 THEN 'Image Gen' WHEN v > 0 THEN 'Video Gen' WHEN c > 0 THEN 'Vibe Coding' ELSE '' END AS gated FROM s")
def _(posts):
    return posts.select("seq", T.category_first(F.col("descr"), _LISTS, None).alias("category"), T.category_first(F.col("descr"), _LISTS, ["ai"]).alias("gated"))


@query("fn5_category_scored", A.posts, f"WITH {A.POSTS}, {_SCORES} SELECT seq, CASE WHEN v >= i AND v >= c AND v > 0 THEN 'Video Gen' WHEN i >= v AND i >= c AND i > 0 THEN 'Image Gen' WHEN c > 0 THEN 'Vibe Coding' ELSE '' END AS category FROM s")
def _(posts):
    return posts.select("seq", T.category_scored(F.col("descr"), _LISTS).alias("category"))


@query("fn6_category_untied", A.posts, f"WITH {A.POSTS}, {_SCORES} SELECT seq, CASE WHEN i > v AND i > c THEN 'Image Gen' WHEN v > i AND v > c THEN 'Video Gen' WHEN c > i AND c > v THEN 'Vibe Coding' ELSE '' END AS category FROM s")
def _(posts):
    return posts.select("seq", T.category_untied(F.col("descr"), _LISTS).alias("category"))


@query("fn8_seeded_cover", pages, f"""WITH h AS (SELECT page_id, CASE WHEN url = '' THEN 0 ELSE list_reduce([ord(c)::BIGINT for c in string_split(url, '')], lambda h, u: (h * 31 + u) % {1 << 32}) END AS h FROM pages)
SELECT page_id, '/dashboard-fallbacks/nature-' || lpad((least(h, {1 << 32} - h) % {U.POOL} + 1)::VARCHAR, 2, '0') || '.svg' AS cover FROM h""")
def _(p):
    return p.select("page_id", U.seeded_cover(F.col("url")).alias("cover"))


@query("fn9_covers", A.cards, f"""WITH {A.CARDS} SELECT id, cover_image <> '' AS is_fallback, CASE WHEN cover_image = '' THEN '' ELSE '/dashboard-fallbacks/nature-' || lpad(CASE WHEN seq % 1000 = 0 THEN '1' ELSE ((seq % 1000 - 1) % 10 + 1)::VARCHAR END, 2, '0') || '.svg' END AS cover, cover_image <> '' AS renderable FROM cards""")
def _(c):
    cover = F.col("cover_image")
    return c.select("id", U.is_fallback_cover(cover).alias("is_fallback"), U.normal_cover(cover).alias("cover"), U.is_renderable(cover).alias("renderable"))


@query("fn10_choose_cover", A.cards, f"""WITH {A.CARDS} SELECT id, CASE WHEN cover_image <> '' THEN '/dashboard-fallbacks/nature-' || lpad(CASE WHEN seq % 1000 = 0 THEN '1' ELSE ((seq % 1000 - 1) % 10 + 1)::VARCHAR END, 2, '0') || '.svg' WHEN seq % 4 = 0 THEN source_url ELSE '/dashboard-fallbacks/semantic-vibe-coding.svg' END AS cover FROM cards""")
def _(c):
    images = F.when(F.col("seq") % 4 == 0, F.array(F.lit("https://a.example/placeholder.png"), F.col("source_url"))).otherwise(F.array().cast("array<string>"))
    return c.select("id", U.choose_cover(F.col("cover_image"), images, F.lit("")).alias("cover"))


@query("fn11_url_keys", pages, f"WITH u AS (SELECT page_id, url AS source_url FROM pages) SELECT page_id, trim(split_part(source_url, '?', 1)) AS ingest, {A.STRIPPED.format('source_url')} AS library, {A.STRIPPED.format('source_url')} AS cleanup FROM u")
def _(p):
    return p.select("page_id", U.ingest_key(F.col("url")).alias("ingest"), U.library_url(F.col("url")).alias("library"), U.stripped(F.col("url")).alias("cleanup"))


# What a page's address is turned into is decided by its digest, and the parts are of the address and the digest.
_DIGEST = "SELECT page_id, url, md5(url) AS m, substring(md5(url), 1, 1) AS first, substring(md5(url), 13, 1) AS other, CASE WHEN contains(url, '?') THEN substring(url, instr(url, '?')) ELSE '?none' END AS query FROM pages"


def digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5("url")
    query = F.when(F.contains("url", F.lit("?")), F.substr("url", F.instr("url", "?"))).otherwise("?none")
    return pages(spark, sf_dir).select("page_id", "url", m.alias("m"), F.substring(m, 1, 1).alias("first"), F.substring(m, 13, 1).alias("other"), query.alias("query"))


@query("fn12_note_urls", digested, f"SELECT page_id, '{U.NOTE_BASE}' || substring(m, 1, 12) || CASE WHEN other < '8' THEN '?xsec_token=' || substring(m, 14, 6) || '%20x&xsec_source=pc_feed' ELSE '' END AS url FROM ({_DIGEST}) x")
def _(p):
    path = F.when(F.col("first") < "8", "discovery/item/").otherwise("explore/")
    token = F.when(F.col("other") < "8", F.concat(F.lit("&xsec_token="), F.substring("m", 14, 6), F.lit("%20x"))).otherwise("")
    address = F.concat(F.lit(" https://WWW.xiaohongshu.com/"), path, F.substring("m", 1, 12), F.regexp_replace("query", "#.*", ""), token, F.lit("#f"))
    return p.select("page_id", U.library_url(address).alias("url"))


@query("fn13_shared_links", digested, f"SELECT page_id, CASE WHEN first < '6' THEN 'notes' WHEN first < 'b' THEN 'microblog' END AS platform, CASE WHEN first < '6' THEN substring(m, 1, 12) WHEN first < 'b' THEN regexp_replace(m, '[a-f]', '', 'g') END AS id, CASE WHEN first < '6' AND other < '8' THEN m END AS token FROM ({_DIGEST}) x")
def _(p):
    note = F.concat(F.lit("look: https://www.xiaohongshu.com/explore/"), F.substring("m", 1, 12), F.regexp_replace("query", "#.*", ""), F.when(F.col("other") < "8", F.concat(F.lit("&xsec_token="), "m")).otherwise(""), F.lit(" and "), F.col("url"))
    text = F.when(F.col("first") < "6", note).when(F.col("first") < "b", F.concat(F.lit("x.com/"), "other", F.lit("/status/"), F.regexp_replace("m", "[a-f]", ""), "query")).otherwise(F.col("url"))
    link = U.shared_link(text)
    return p.select("page_id", link["platform"].alias("platform"), link["id"].alias("id"), link["token"].alias("token"))


@query("fl12_openable_urls", digested, f"SELECT page_id, CASE WHEN first < 'b' THEN '' ELSE url END AS openable, CASE WHEN first < '6' THEN 'missing' WHEN first < 'b' THEN 'placeholder' ELSE '' END AS reason FROM ({_DIGEST}) x")
def _(p):
    url = F.when(F.col("first") < "6", F.when(F.col("other") < "8", " # ").otherwise("\n")).when(F.col("first") < "b", F.concat(F.lit("https://X.com/example/status/123456"), "query")).otherwise(F.concat(F.lit(" "), F.col("url"), F.lit("\t")))
    return p.select("page_id", U.openable_url(url).alias("openable"), U.block_reason(url).alias("reason"))


@query("fl14_analyzable_images", pages, "SELECT page_id, url AS images FROM pages")
def _(p):
    images = F.array(F.col("url"), F.lit("/dashboard-fallbacks/nature-01.svg"), F.concat(F.col("url"), F.lit("/dashscope")), F.col("url"), F.lit("ftp://x"))
    return p.select("page_id", joined(U.analyzable_images(images)).alias("images"))


@query("fl15_placeholder_images", A.cards, f"WITH {A.CARDS} SELECT id, cover_image = '' AS is_placeholder FROM cards")
def _(c):
    return c.select("id", U.is_placeholder_image(F.col("cover_image")).alias("is_placeholder"))


@query("fn14_note_images", pages, f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{U.NOTE_IMAGE[0]}f' || page_id || '{U.NOTE_IMAGE[1]}' WHEN page_id % 3 = 1 THEN url || '/format/jpg/a/format/jpg' ELSE url END AS image,
CASE page_id % 5 WHEN 0 THEN url || '/format/jpg' WHEN 1 THEN '{U.NOTE_IMAGE[0]}c' || page_id || '{U.NOTE_IMAGE[1]}' WHEN 2 THEN url || '/large' WHEN 3 THEN url || '/second' ELSE url || '/first' END AS cover FROM pages""")
def _(p):
    i, url, n = F.col("page_id").cast("string"), F.col("url"), F.col("page_id")
    image = U.note_image(F.when(n % 3 == 0, F.concat(F.lit("f"), i)), F.when(n % 3 == 1, F.concat(url, F.lit("/format/heif/a/format/heif"))).otherwise(""), url)
    json = lambda **parts: F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
    cover = F.when(n % 5 == 0, F.concat(url, F.lit("/format/heif"))).when(n % 5 == 1, json(fileid=F.concat(F.lit("c"), i), url=url)).when(n % 5 == 2, json(url_default=F.lit("/no"), url_size_large=F.concat(url, F.lit("/large"))))
    images = F.array(F.concat(url, F.lit("/first")), F.concat(url, F.lit("/second")))
    return p.select("page_id", image.alias("image"), U.note_cover(cover, images, F.when(n % 5 == 3, "1").otherwise("nine")).alias("cover"))


@query("fn18_checked_prompts", turns, "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'p' || conv_id || '|q' ELSE 'You are an editor. Write a summary of the text, then list its claims.' END AS prompts FROM conversations")
def _(t):
    told = F.concat(F.lit('Of these:\n```json\n{"completePrompts": ["p'), F.col("conv_id").cast("string"), F.lit('", " q ", "q"]}\n```'))
    reply = F.when(F.col("turn") % 2 == 0, told).when(F.col("turn") % 3 == 0, "no list").otherwise('{"completePrompts": []}')
    rows = t.select("conv_id", "turn", reply.alias("reply"), F.array(F.lit("tag"), F.lit("#x #y"), F.lit("You are an editor. Write a summary of the text, then list its claims.")).alias("candidates"))
    return P.checked_prompts(rows, ["conv_id", "turn"]).select("conv_id", "turn", joined(F.col("prompts")).alias("prompts"))


@query("fn7_untied_label", A.posts, f"WITH {A.POSTS}, {_SCORES} SELECT seq, CASE WHEN i > v AND i > c THEN 'Image Gen' WHEN v > i AND v > c THEN 'Video Gen' WHEN c > i AND c > v THEN 'Vibe Coding' WHEN seq % 4 = 0 THEN 'Image Gen' WHEN seq % 4 = 1 THEN 'Vibe Coding' ELSE '' END AS label FROM s")
def _(posts):
    """The text's category, and where there is none or a tie what an analysis calls it."""
    told = F.element_at(F.array(*map(F.lit, (" AI Images", "good VIBES", "Other", "coding"))), (F.col("seq") % 4 + 1).cast("int"))
    return posts.select("seq", F.coalesce(F.nullif(T.category_untied(F.col("descr"), _LISTS), F.lit("")), T.library_label(told)).alias("label"))


@query("fn7_category_label", A.posts, f"WITH {A.POSTS} SELECT seq, CASE WHEN seq % 5 = 0 OR contains(lower(descr), 'image') THEN 'Image Gen' WHEN seq % 5 IN (1, 4) OR contains(lower(descr), 'video') THEN 'Video Gen' WHEN seq % 5 = 2 OR contains(lower(descr), 'coding') OR contains(lower(descr), 'code') THEN 'Vibe Coding' ELSE '' END AS label FROM posts")
def _(posts):
    told = F.element_at(F.array(*map(F.lit, (" IMAGE generation", "ai video", "some Code", "", "Coding or videos "))), (F.col("seq") % 5 + 1).cast("int"))
    return posts.select("seq", T.category_label(F.concat(told, F.col("descr"))).alias("label"))


# In SQL the cue's negative looks ahead are a character of another kind or the end.
_CUE_SQL = P.CUE.replace("(?![A-Za-z0-9_])", "(?:[^A-Za-z0-9_]|$)")


@query("fn15_prompts", turns, rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[{_BLANK}\x{{FEFF}}]+|[{_BLANK}\x{{FEFF}}]+$', '', 'g') AS t FROM conversations),
s AS (SELECT *, length(regexp_replace(t, '[{_BLANK}]+', '', 'g')) AS size FROM t),
p AS (SELECT *, size >= 12 AND NOT (NOT regexp_matches(t, '{_CUE_SQL}') AND NOT regexp_matches(t, '[,:;，。；\n]') AND len(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9''_-]*')) < 10 AND (NOT regexp_matches(t, '[一-鿿]') OR size < 20))
  AND NOT regexp_matches(t, '^\[[^\]]+\]$') AND NOT regexp_matches(t, '^(?:#?[^{_BLANK}#]+(?:\[[^\]]+\])?#?[{_BLANK}]*){{1,6}}$') AS is_prompt FROM s)
SELECT conv_id, turn, is_prompt, CASE WHEN is_prompt THEN 'PromptShare' ELSE 'ToolReview' END AS content_type FROM p""")
def _(t):
    return t.select("conv_id", "turn", P.is_prompt(F.col("text")).alias("is_prompt"), P.content_type(P.is_prompt(F.col("text")).cast("int")).alias("content_type"))


@query("fn17_analysis", turns, rf"""WITH t AS (SELECT conv_id, turn, turn % 5 <> 4 AS ok, regexp_replace(regexp_replace(coalesce(text, ''), ', *([}}\]])', '\1', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT ok THEN '{P.NO_FORMAT}' WHEN t = '' THEN '{P.NO_TEXT}' ELSE t END AS summary, CASE WHEN ok THEN 'a|b|c' ELSE '{'|'.join(P.SCENARIOS)}' END AS scenarios, CASE WHEN ok THEN 'x|y' ELSE '' END AS tool_tags, ok FROM t""")
def _(t):
    reply = F.concat(F.lit('Sure:\n```json\n{"summary": '), F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9), F.lit(', "usageScenarios": "a;b，c,d", "toolTags": ["x", "x", " y "],}\n```'))
    a = P.analysis(F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(reply), F.col("text"))
    return t.select("conv_id", "turn", a["summary"].alias("summary"), joined(a["usage_scenarios"]).alias("scenarios"), joined(a["tool_tags"]).alias("tool_tags"), a["ok"].alias("ok"))


@query("fn19_quota_errors", A.logs, f"WITH {A.LOGS} SELECT id, error_message IS NOT NULL AS is_quota, (CASE WHEN errors > 2 THEN errors + 1 WHEN errors > 0 THEN 1 END)::BIGINT AS retry_seconds FROM logs")
def _(logs):
    n = F.coalesce(F.get("platform_errors", F.lit(0))["error"], F.lit(None).cast("string"))
    e = T.quota_error(F.when(F.col("error_message").isNotNull(), F.concat(F.lit('API Error: 429 {"error": {"code": 429, "message": "retry in '), F.coalesce(n, F.lit("0")), F.lit('.5s"}}'))))
    return logs.select("id", e["is_quota"].alias("is_quota"), e["retry_seconds"].alias("retry_seconds"))


_MARKED = "'# ' || regexp_replace(text, '^(\\S+)', '**\\1** `code`') || chr(10) || '> said' || chr(10) || '- one *two* ```x```'"
_PLAIN = _MARKED
for _pattern, _to in ((r"(?s)```(.*?)```", r"\1"), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`(.+?)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s+", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_to}', 'g')"


@query("fn21_markdown", turns, f"SELECT conv_id, turn, regexp_matches(text, '(?i)(markdown|md格式|用md|代码块|```|表格|标题|列表)') AS wanted, {_PLAIN} AS plain FROM conversations")
def _(t):
    marked = F.concat(F.lit("# "), F.regexp_replace("text", r"^(\S+)", "**$1** `code`"), F.lit("\n> said\n- one *two* ```x```"))
    return t.select("conv_id", "turn", T.wants_markdown(F.col("text")).alias("wanted"), T.plain_markdown(marked).alias("plain"))


@query("fn24_handles", A.posts, f"WITH {A.POSTS} SELECT DISTINCT author, author AS handle, author AS username FROM posts")
def _(posts):
    marked = F.concat(F.lit("@@ "), F.upper("author"), F.lit(" "))
    return posts.select("author").distinct().select("author", T.handle(marked).alias("handle"), T.trim(T.username(marked)).alias("username"))


@query("fn25_distinct_lists", A.cards, f"WITH {A.CARDS} SELECT id, array_to_string(CASE WHEN seq % 7 = seq % 11 THEN ['c' || (seq % 7)] ELSE ['c' || (seq % 7), 'c' || (seq % 11)] END, '|') AS collections FROM cards")
def _(c):
    return c.select("id", joined(T.distinct_texts(F.col("collections"))).alias("collections"))


@query("fn26_short_count", A.posts, f"WITH {A.POSTS} SELECT seq, CASE WHEN likes >= 1000 THEN printf('%.1fk', (likes + (likes % 500 = 250)::INTEGER) / 1000.0) ELSE likes::VARCHAR END AS shown FROM posts")
def _(posts):
    return posts.select("seq", T.short_count(F.col("likes")).alias("shown"))


@query("fn27_uuids", A.posts, f"WITH {A.POSTS}, m AS (SELECT seq, md5(descr) AS m FROM posts) SELECT seq, substring(m, 13, 1) BETWEEN '1' AND '5' AND substring(m, 17, 1) IN ('8', '9', 'a', 'b') AS valid FROM m")
def _(posts):
    """Digests of the texts, written as ids: some happen to have a valid version and variant."""
    part = lambda a, n: F.substring(F.md5("descr"), a, n)
    return posts.select("seq", T.is_uuid(F.upper(F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))).alias("valid"))


def token_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    item = lambda i: F.struct((i % 50).cast("string").alias("noteId"), F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("token"), F.lit("s").alias("source"), F.lit("2024").alias("updatedAt"))
    return rows.select("owner_id", F.lit("note_tokens").alias("key"), F.to_json(F.transform("ids", item)).alias("value"))


@query("fn23_tokens", token_settings, "SELECT 'u' || user_id AS owner_id, (event_id % 50)::VARCHAR AS note_id, 't' || event_id AS token FROM events WHERE event_id % 9 <> 0")
def _(s):
    return audit.parse_tokens(s).select("owner_id", "note_id", "token")


@query("fn23_upsert_tokens", token_settings, """WITH e AS (SELECT 'u' || user_id AS o, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
l AS (SELECT o, (event_id % 50)::VARCHAR AS note, arg_max(event_id, struct_pack(late := pos % 2, pos := pos)) AS event_id FROM e WHERE event_id % 9 <> 0 GROUP BY 1, 2)
SELECT o AS owner_id, '[' || string_agg('{"noteId":"' || note || '","token":"t' || event_id || '","source":"s","updatedAt":"2024"}', ',' ORDER BY note DESC) || ']' AS value FROM l GROUP BY o""")
def _(s):
    rows = audit.parse_tokens(s)
    return audit.upsert_tokens(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


from . import landed, owned, stored, streams  # noqa: E402, F401  more queries of the same registry
