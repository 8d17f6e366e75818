"""Cards: building, scoring, merging duplicates, snapshots, rankings, listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.prompts import content_type
from ..sources import store
from . import folds

SNAPSHOT, LEGACY = "snapshot:", "snapshot:legacy"

ANALYSED = ("usage_scenarios", "core_knowledge", "extracted_prompts")
LISTS = ("tags", "collections", "images", *ANALYSED)


def empty() -> Column:
    return F.array().cast("array<string>")


def with_defaults(cards: DataFrame) -> DataFrame:
    """Null lists are empty, null texts '', a blank address '#', null numbers 0, null flags false."""
    out = {}
    for name, kind in cards.dtypes:
        if kind == "array<string>":
            out[name] = F.coalesce(name, empty())
        elif kind == "bigint":
            out[name] = F.coalesce(name, F.lit(0).cast("long"))
        elif kind == "boolean":
            out[name] = F.coalesce(name, F.lit(False))
        elif kind == "string" and name not in ("id", "owner_id"):
            out[name] = F.coalesce(name, F.lit(""))
    out["source_url"] = F.when(F.coalesce("source_url", F.lit("")) == "", "#").otherwise(F.col("source_url"))
    return cards.withColumns(out)


def short(text: Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def trending_rows(posts: DataFrame, snapshot: str, owner: str, no_summary: str = "暂无摘要", no_title: str = "无标题") -> DataFrame:
    """Candidates as trending cards: tags are category, source tags, hashtags, snapshot, each once; nothing is analysed yet.
    The date is the time of publishing as the post gives it, if the posts carry it."""
    descr, title = F.coalesce("descr", F.lit("")), F.coalesce("title", F.lit(""))
    base = F.when(descr != "", descr).otherwise(title)
    posts = posts.withColumn("_low", F.lower(base))
    posts = posts.withColumn("_category", T.category_held(F.col("_low")))  # a column, as the tags name it twice
    category = F.col("_category")
    tags = F.array_distinct(F.concat(F.when(category != "", F.array(category)).otherwise(empty()), F.filter(F.coalesce("tags", empty()), lambda t: t != ""), T.hashtags(descr), F.array(F.lit(snapshot))))
    return posts.select(
        F.lit(owner).alias("owner_id"), F.lit(True).alias("is_public"), F.when(title != "", title).when(descr != "", F.substring(descr, 1, 40)).otherwise(no_title).alias("title"), "source_url", "platform", "author",
        (F.coalesce("publish_time", F.lit("")) if "publish_time" in posts.columns else F.lit("")).alias("date"), content_type(F.lit(0)).alias("content_type"), *[empty().alias(c) for c in ANALYSED],
        F.when(base == "", no_summary).otherwise(short(base, 160)).alias("summary"), "likes", "bookmarks", "comments", descr.alias("raw_content"), tags.alias("tags"),
        U.normal_cover(F.coalesce(F.nullif(F.col("cover_image"), F.lit("")), F.get("images", F.lit(0)))).alias("cover_image"), F.lit(True).alias("is_trending"), empty().alias("collections"), F.lit("").alias("user_notes"), "seq",
    )


def library_rows(posts: DataFrame, analysis: DataFrame | None = None, no_summary: str = "暂无摘要", no_title: str = "无标题") -> DataFrame:
    """Picked posts as library cards; analysis (seq, summary, suggested_title, category, tool_tags and the lists of what was
    analysed) where there is one. The category, by title, text and analysis together and else the analysis' own, is the last tag.
    """
    rows = posts if analysis is None else posts.join(analysis, "seq", "left")
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in rows.columns else F.lit("")
    items = lambda n: F.coalesce(F.col(n), empty()) if n in rows.columns else empty()
    descr, summary = text("descr"), text("summary")
    raw = F.when(descr != "", descr).otherwise(text("title"))
    parts = F.filter(F.array(text("title"), descr, summary, F.array_join(items("core_knowledge"), " ")), lambda t: t != "")
    # A column for each step, as an expression is evaluated once for each place that names it: keywords are counted once.
    rows = rows.withColumns({"_low": F.lower(F.array_join(parts, "\n")), "_hashtags": T.hashtags(descr)})
    rows = rows.withColumns({f"_n_{k}": T.keyword_count(F.col("_low"), words) for k, words in T.SCORED.items()})
    scores = {k: F.col(f"_n_{k}") for k in T.SCORED}
    rows = rows.withColumn("_category", F.when(T.is_blank(F.col("_low")), "").otherwise(F.coalesce(F.nullif(T.best_untied(scores), F.lit("")), T.library_label(text("category")))))
    category = F.col("_category")
    labels = F.array(*map(F.lit, U.SEMANTIC_COVERS))
    other = lambda tags: F.filter(tags, lambda t: (t != "") & ~F.array_contains(labels, t))
    tags = F.array_distinct(F.concat(F.slice(other(items("tags")), 1, 8), other(F.slice(F.col("_hashtags"), 1, 5)), other(F.slice(F.filter(items("tool_tags"), lambda t: t != ""), 1, 5))))
    title = F.coalesce(*[F.nullif(t, F.lit("")) for t in (text("title"), text("suggested_title"), F.substring(descr, 1, 30))], F.lit(no_title))
    cover = F.coalesce(F.nullif(text("cover_image"), F.lit("")), F.get(items("images"), F.lit(0)), F.lit(""))
    semantic = F.when(category != "", category).otherwise(T.best_scored(scores))
    fixed = F.create_map(*[F.lit(x) for kv in U.SEMANTIC_COVERS.items() for x in kv])[F.when(semantic == "", "Vibe Coding").otherwise(semantic)]
    return rows.select(
        "seq", F.coalesce(F.nullif(T.trim(title), F.lit("")), F.lit(no_title)).alias("title"), "source_url", "platform", "author", text("publish_time").alias("date"), F.when((cover == "") | U.is_fallback_cover(cover), fixed).otherwise(cover).alias("cover_image"),
        items("images").alias("images"), "likes", "bookmarks", "comments", content_type(F.size(items("extracted_prompts"))).alias("content_type"), descr.alias("raw_content"),
        F.when(summary != "", summary).when(raw == "", no_summary).otherwise(short(raw, 150)).alias("summary"), *[items(c).alias(c) for c in ANALYSED],
        F.when(category != "", F.array_append(tags, category)).otherwise(tags).alias("tags"), F.lit("").alias("user_notes"), empty().alias("collections"),
    )


def plain_tags(tags: Column) -> Column:
    return F.filter(F.coalesce(tags, empty()), lambda t: ~t.startswith(SNAPSHOT))


def latest_snapshot(tags: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(F.coalesce(tags, empty()), lambda t: t.startswith(SNAPSHOT))), F.lit(LEGACY))


def ensured_tags(tags: Column, text: Column, fallback: str = "Vibe Coding") -> Column:
    """Cards with nothing but snapshot tags get their category's, or a fallback."""
    category = T.category_first(text, gate=None)
    return F.when(F.size(plain_tags(tags)) > 0, F.coalesce(tags, empty())).otherwise(F.concat(F.array(F.when(category == "", fallback).otherwise(category)), F.coalesce(tags, empty())))


def needs_analysis(placeholder: str = "暂无摘要") -> Column:
    none = (F.size(F.coalesce("usage_scenarios", empty())) + F.size(F.coalesce("core_knowledge", empty())) + F.size(F.coalesce("extracted_prompts", empty()))) == 0
    return T.trim(F.col("summary")).isin("", placeholder) | none


def preferred_title(platform: Column, title: Column, suggested: Column) -> Column:
    own, other = F.nullif(T.trim(title), F.lit("")), F.nullif(T.trim(suggested), F.lit(""))
    return F.coalesce(F.when(platform == "microblog", F.coalesce(other, own)).otherwise(F.coalesce(own, other)), F.lit(""))


def backfill_owner(df: DataFrame, owner: str) -> DataFrame:
    """Rows without owner get one, and are public then if the table has the flag."""
    out = df.withColumn("_none", F.col("owner_id").isNull())
    if "is_public" in df.columns:
        out = out.withColumn("is_public", F.when(F.col("_none"), True).otherwise(F.col("is_public")))
    return out.withColumn("owner_id", F.coalesce("owner_id", F.lit(owner))).drop("_none")


def _completeness(size: Callable[[str], Column], count: Callable[[str], Column], metric: Callable[[str], Column], notes_weight: float) -> Column:
    """The weights, once: of texts by length, of lists by entries, of the metrics' total, of a cover."""
    total = metric("likes") + metric("bookmarks") + metric("comments")
    lists = count("usage_scenarios") * notes_weight + count("core_knowledge") * notes_weight + count("extracted_prompts") * 20.0
    return size("user_notes") * 0.2 + size("summary") * 0.2 + lists + size("raw_content") * 0.02 + count("tags") * 8.0 + count("collections") * 20.0 + total * 0.01 + F.when(size("cover_image") > 0, 30.0).otherwise(0.0)


def completeness(notes_weight: float = 15.0) -> Column:
    """How complete a card is: notes, summary, lists, text, tags, collections, metrics, cover."""
    return _completeness(lambda c: F.coalesce(F.length(c), F.lit(0)), lambda c: F.size(F.coalesce(c, empty())), lambda c: F.coalesce(c, F.lit(0)), notes_weight)


def cleanup_score() -> Column:
    """As completeness, with all lists alike, and a bonus for library cards."""
    return completeness(20.0) + F.when(F.coalesce("is_trending", F.lit(False)), 0.0).otherwise(200.0)


def dedup_key(with_owner: bool = True) -> Column:
    """By address, else by platform, title, author and the beginning of the text. The library's key names the owner."""
    url = U.library_url(F.col("source_url")) if with_owner else U.stripped(F.col("source_url"))
    meta = F.concat_ws("|", T.norm(F.col("platform")), T.norm(F.col("title")), T.norm(F.col("author")), F.substring(T.norm(F.col("raw_content")), 1, 120))
    key = F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("meta:"), meta))
    owner = F.when(F.coalesce("owner_id", F.lit("")) == "", "public").otherwise(F.col("owner_id"))
    return F.concat(F.lit("owner:"), T.norm(owner), F.lit("|"), key) if with_owner else key


_MERGED = ["id", "owner_id", "is_public", "title", "source_url", "platform", "author", "cover_image", "likes", "bookmarks", "comments", "raw_content", "user_notes", "summary", *LISTS, "is_trending"]


def _longer(a: Column, b: Column) -> Column:
    """b if strictly longer."""
    return F.when(F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)


def _score(c: Column) -> Column:
    """completeness() of a struct."""
    return _completeness(lambda f: F.coalesce(F.length(c[f]), F.lit(0)), lambda f: F.size(F.coalesce(c[f], empty())), lambda f: c[f], 15.0)


def _merged(a: Column, b: Column, columns: Sequence[str]) -> Column:
    """Two cards as one: the id of the first, plain fields of the more complete, the larger metrics, the longer texts, all list entries."""
    first = _score(a) >= _score(b)
    main, other = (lambda f: F.when(first, a[f]).otherwise(b[f])), (lambda f: F.when(first, b[f]).otherwise(a[f]))
    some = lambda f: F.when(F.coalesce(main(f), F.lit("")) != "", main(f)).otherwise(other(f))
    made = {
        "id": a["id"], "owner_id": some("owner_id"), "is_public": F.coalesce(a["is_public"], F.lit(False)) | F.coalesce(b["is_public"], F.lit(False)), "cover_image": some("cover_image"),
        "source_url": F.when(~main("source_url").isin("", "#"), main("source_url")).otherwise(other("source_url")), "raw_content": _longer(main("raw_content"), other("raw_content")),
        "user_notes": _longer(main("user_notes"), other("user_notes")), "summary": _longer(a["summary"], b["summary"]), **{m: F.greatest(a[m], b[m]) for m in ("likes", "bookmarks", "comments")},
        **{l: T.distinct_texts(F.concat(a[l], b[l])) for l in ("tags", "collections", "usage_scenarios", "core_knowledge", "extracted_prompts")},
    }
    return F.struct(*[made.get(c, main(c)).alias(c) for c in columns])


_UNITED = ("tags", "collections", *ANALYSED)
#: Cards of a key up to which the fold gathers them.
GATHERED = 1000


def _merge_large(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """What the pairwise fold makes of each key's cards, of any number, without gathering them.

    A step of the fold needs no more of the cards so far than their completeness, and that is made of running maxima (the
    longest texts, the largest metrics, any cover) and of how many list entries are new: so which cards are more complete than
    all before them, those that take over, is known from running values. The merged card's fields are those of the last one
    that took over, or of the first that isn't blank, and so on: aggregates that combine before the shuffle. Cards of the same
    time and id are ordered by a hash.
    """
    at = rows.select("*", F.col(order).alias("_at"), F.xxhash64(*columns).alias("_tie"))
    cards = store.saved(folds.running(at, "_key", ["_at", "id", "_tie"], {"pos": (F.lit(1), "sum")}).drop("_at", "_tie"), "large-groups")
    entries = lambda c: F.transform(T.texts(F.col(c)), lambda t, i: F.struct(F.lit(c).alias("list"), t.alias("t"), i.alias("i")))
    entry = F.array(*map(entries, _UNITED))
    seen = cards.select("_key", "pos", F.explode(F.flatten(entry)).alias("e")).groupBy("_key", "e.list", "e.t").agg(F.min(F.struct("pos", "e.i")).alias("first"))
    seen = store.saved(seen, "list-entries")
    new = seen.groupBy("_key", F.col("first.pos").alias("pos")).agg(*[F.count_if(F.col("list") == c).alias(f"new_{c}") for c in _UNITED])
    sizes = {c: F.length(c) for c in ("user_notes", "summary", "raw_content", "cover_image")}
    so_far = {f"so_{c}": (v, "max") for c, v in {**sizes, **{m: F.col(m) for m in ("likes", "bookmarks", "comments")}}.items()}
    so_far |= {f"so_{c}": (F.col(f"new_{c}"), "sum") for c in _UNITED} | {f"first_{c}": (F.when(F.col("pos") == 1, F.size(c)), "max") for c in _UNITED}
    told = folds.running(cards.join(new, ["_key", "pos"], "left"), "_key", ["pos"], so_far, inclusive=False)
    # The first card's lists count as they are, those of merged cards once each.
    held = _completeness(lambda c: F.coalesce(f"so_{c}", F.lit(0)), lambda c: F.when(F.col("pos") == 2, F.col(f"first_{c}")).otherwise(F.col(f"so_{c}")), lambda c: F.col(f"so_{c}"), 15.0)
    over = (F.col("pos") == 1) | (completeness() > held)
    taker, other = F.when(over, F.col("pos")), F.when(~over, F.col("pos"))

    def some(c: str, blank: Sequence[str] = ("",)) -> Column:
        filled = ~F.coalesce(F.col(c), F.lit("")).isin(*blank)
        of = F.struct(F.col(c).alias("v"))
        return F.coalesce(F.max_by(of, F.when(filled, taker)), F.min_by(of, F.when(filled, F.col("pos"))), F.max_by(of, other), F.min_by(of, "pos"))["v"]

    longest = lambda c: F.max_by(c, F.struct(F.length(c).alias("n"), F.coalesce(taker, F.lit(0)).alias("t"), (-F.col("pos")).alias("p")))
    made = {
        "id": F.min_by("id", "pos"), "owner_id": some("owner_id"), "is_public": F.bool_or("is_public"), "cover_image": some("cover_image"), "source_url": some("source_url", ("", "#")),
        "raw_content": longest("raw_content"), "user_notes": longest("user_notes"), "summary": F.max_by("summary", F.struct(F.length("summary").alias("n"), (-F.col("pos")).alias("p"))), **{m: F.max(m) for m in ("likes", "bookmarks", "comments")},
    }
    plain = [c for c in columns if c not in _UNITED]
    out = told.groupBy("_key").agg(*[made.get(c, F.max_by(F.struct(F.col(c).alias("v")), taker)["v"]).alias(c) for c in plain], F.count("*").cast("int").alias("n_merged"))
    lists = seen.groupBy("_key").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == c, F.struct("first", "t")))), lambda x: x["t"]).alias(c) for c in _UNITED])
    joined = out.join(lists, "_key", "left")
    return joined.select(*[F.coalesce(c, empty()).alias(c) if c in _UNITED else F.col(c) for c in columns], "n_merged")


def dedup_cards(cards: DataFrame, order: str = "created_at", gathered: int = GATHERED) -> DataFrame:
    """Cards merged by owner and address, pairwise in order: each step keeps the fields of what is more complete so far.

    Keys of one card leave before anything is gathered; keys of more cards than `gathered`, such as the metadata key of blank
    cards may have, are merged by running values instead of the fold.
    """
    columns = [c for c in _MERGED if c in cards.columns]
    rows = with_defaults(cards).withColumns({"_key": dedup_key(), "source_url": U.library_url(F.col("source_url")), "tags": T.distinct_texts(F.col("tags")), "collections": T.distinct_texts(F.col("collections"))})
    rows = store.saved(rows.select("_key", *dict.fromkeys([order, *columns])), "keyed-cards")  # keys take long patterns: made once, for three readings
    many = store.saved(rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"), "card-groups")
    single = rows.join(many, "_key", "left_anti").select(*columns, F.lit(1).alias("n_merged"))
    some = rows.join(many.where(F.col("_n") <= gathered).select("_key"), "_key")
    grouped = some.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.col("id").alias("_id"), F.struct(*columns).alias("c")))).alias("all"))
    rest = F.transform(F.slice("all", 2, gathered), lambda x: x["c"])
    folded = F.aggregate(rest, F.col("all")[0]["c"], lambda a, b: _merged(a, b, columns))
    out = single.unionByName(grouped.select(folded.alias("c"), F.size("all").alias("n_merged")).select("c.*", "n_merged"))
    large = many.where(F.col("_n") > gathered).select("_key")
    if not large.isEmpty():
        out = out.unionByName(_merge_large(rows.join(large, "_key"), order, columns))
    return out.withColumn("source_url", F.when(F.col("source_url") == "", "#").otherwise(F.col("source_url")))


def cleanup_cards(cards: DataFrame, by_owner: bool = False) -> DataFrame:
    """Duplicate groups of the whole library: the best card's id, what it becomes, and how many others go.

    The best is first by score, then age; lists join in that order, metrics are the largest, texts the longest, and a group is
    trending only if all of it is. Groups of one leave before anything is gathered.
    """
    rows = with_defaults(cards).withColumn("_key", F.concat_ws("|", F.when(F.lit(by_owner), F.col("owner_id")), dedup_key(False))).withColumn("_score", cleanup_score())
    many = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    rows = rows.join(many, "_key")
    rank = F.struct((-F.col("_score")).alias("s"), F.col("created_at").alias("at"), F.col("id").alias("id"))
    lists = {c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.filter(F.col(c), lambda x: x != "").alias("v")))), lambda x: x["v"]))).alias(c) for c in ("tags", "collections")}
    longest = lambda c: F.max_by(F.col(c), F.struct(F.length(c).alias("n"), F.col("_score"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("at")))
    out = rows.groupBy("_key").agg(F.min_by("id", rank).alias("id"), F.count("*").alias("n"), *[F.max(m).alias(m) for m in ("likes", "bookmarks", "comments")], *lists.values(), longest("raw_content").alias("raw_content"), longest("user_notes").alias("user_notes"), F.bool_and("is_trending").alias("is_trending"))
    return out.withColumn("n_deleted", F.col("n") - 1).drop("_key", "n")


def cleanup_deletes(cards: DataFrame, by_owner: bool = False) -> DataFrame:
    """The ids that cleanup_cards() merges into another."""
    key = F.concat_ws("|", F.when(F.lit(by_owner), F.col("owner_id")), dedup_key(False))
    rows = with_defaults(cards).withColumns({"_key": key, "_score": cleanup_score()})
    best = rows.groupBy("_key").agg(F.min_by("id", F.struct((-F.col("_score")).alias("s"), F.col("created_at").alias("at"), F.col("id").alias("id"))).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return rows.join(best, "_key").where("id <> keeper").select("id", "keeper")


def unique_trending(cards: DataFrame, order: str = "seq") -> DataFrame:
    """For display: the first card of each address before '?', else of each title and author."""
    url = F.substring_index(F.coalesce("source_url", F.lit("")), "?", 1)
    key = F.when(url.isin("", "#"), F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))).otherwise(url)
    return cards.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*cards.columns), order).alias("c")).select("c.*")


def owner() -> Column:
    return F.coalesce("owner_id", F.lit("public"))


def new_candidates(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose address no trending card of their owner has; two that differ in the query alone both stay."""
    keyed = lambda d: d.withColumns({"_owner": owner(), "_key": U.ingest_key(F.col("source_url"))})
    keys = keyed(existing.where("is_trending")).select("_owner", "_key").distinct()
    return keyed(found).join(keys, ["_owner", "_key"], "left_anti").drop("_owner", "_key")


def _trending_of(existing: DataFrame, owner_id: str) -> DataFrame:
    """(id, old_tags, _key) of the owner's trending cards with an address."""
    rows = existing.where("is_trending").where(F.col("owner_id") == owner_id)
    return rows.select("id", F.col("tags").alias("old_tags"), U.ingest_key(F.col("source_url")).alias("_key")).where("_key <> ''")


def refreshed(existing: DataFrame, rows: DataFrame, snapshot: str, owner_id: str) -> DataFrame:
    """The owner's trending cards that new trending rows (of trending_rows()) were made for again, as whole rows of the last one:
    everything but the id is new. Tags are the new card's, then the old ones, then the snapshot."""
    names = [c for c in rows.columns if c != "seq"]
    last = rows.groupBy(U.ingest_key(F.col("source_url")).alias("_key")).agg(F.max_by(F.struct(*names), "seq").alias("n"))
    tags = F.array_distinct(F.concat(plain_tags(F.col("n.tags")), plain_tags(F.col("old_tags")), F.array(F.lit(snapshot))))
    return _trending_of(existing, owner_id).join(last, "_key").select("id", *[(tags if c == "tags" else F.col(f"n.{c}")).alias(c) for c in names])


def refresh_existing(existing: DataFrame, found: DataFrame, snapshot: str, owner_id: str) -> DataFrame:
    """refreshed() by the last post found of each address. Making a card reads its whole text, so that is done for those alone."""
    key = U.ingest_key(F.col("source_url"))
    known = _trending_of(existing, owner_id).select("_key").distinct()
    last = found.withColumn("_key", key).join(known, "_key", "left_semi").groupBy("_key").agg(F.max_by(F.struct(*found.columns), "seq").alias("p"))
    return refreshed(existing, trending_rows(last.select("p.*"), snapshot, owner_id), snapshot, owner_id)


def kept_snapshots(cards: DataFrame, keep: int = 5) -> DataFrame:
    """Trending cards of the newest snapshots of each owner; cards without one belong to the legacy snapshot, the oldest."""
    rows = cards.where("is_trending").withColumns({"snapshot": latest_snapshot(F.col("tags")), "_owner": owner()})
    order = F.struct((F.col("snapshot") != LEGACY).alias("dated"), F.col("snapshot"))
    each = rows.select("_owner", "snapshot").distinct().withColumn("_n", F.row_number().over(W.partitionBy("_owner").orderBy(order.desc())))
    return rows.join(each.where(F.col("_n") <= keep).drop("_n"), ["_owner", "snapshot"], "left_semi").drop("_owner")


def current_trending(cards: DataFrame, newest: int = 60) -> DataFrame:
    """Of the newest trending cards, merged by owner and address, those of the greatest snapshot as texts compare (a legacy
    one beats dated ones)."""
    rows = cards.where("is_trending").orderBy(F.col("created_at").desc(), "id").limit(newest)
    rows = dedup_cards(rows).withColumn("snapshot", latest_snapshot(F.col("tags")))
    return rows.withColumn("_top", F.max("snapshot").over(W.partitionBy())).where("snapshot = _top").drop("_top")


def restamp(cards: DataFrame, snapshot: str) -> DataFrame:
    return cards.withColumn("tags", F.when(F.col("is_trending"), F.array_append(plain_tags(F.col("tags")), F.lit(snapshot))).otherwise(F.col("tags")))


def category_rankings(cards: DataFrame, categories: Sequence[str], k: int = 3) -> DataFrame:
    """The k best cards by likes of each category in turn, no card twice; short categories are filled from the rest.

    Only the best k * categories of each category and of all can matter, so those alone are ranked together.
    """
    order = [F.col("likes").desc(), F.col("seq")]
    most = k * len(categories)
    best = [cards.where(F.col("category") == c).orderBy(*order).limit(most) for c in categories]
    pool = cards.orderBy(*order).limit(most)
    for b in best:
        pool = pool.unionByName(b)
    rows = pool.select("id", "category", "likes", "seq").dropDuplicates(["id"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        """The picks from the pool, which has at most k * n * (n + 1) rows for n categories."""
        pdf, out = pdf.sort_values(["likes", "seq"], ascending=[False, True]), []
        for c in categories:
            own = pdf[pdf["category"] == c].head(k)
            chosen = pd.concat([own, pdf.drop(own.index)]).head(k)
            out += [(c, n, i) for n, i in enumerate(chosen["id"], 1)]
            pdf = pdf.drop(chosen.index)
        return pd.DataFrame(out, columns=["slot", "rank", "id"])

    return rows.withColumn("_all", F.lit("")).groupBy("_all").applyInPandas(pick, "slot string, rank int, id string")


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), "id").limit(n)


def list_cards(cards: DataFrame, trending: bool, offset: int, limit: int) -> DataFrame:
    """A page of the list view: heavy columns are never read."""
    return cards.where(F.col("is_trending") == trending).select("id", "title", "source_url", "platform", "author", "cover_image", "likes", "bookmarks", "comments", "tags", "collections", "created_at").orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def card_by_id(cards: DataFrame, card_id: str) -> DataFrame:
    return with_defaults(cards.where(F.col("id") == card_id))


def search_cards(cards: DataFrame, query: str = "", topic: str = "All", aliases: Sequence[str] = ()) -> DataFrame:
    """Title or tag holds the query, a tag is the topic, a collection is among the aliases: all that is asked."""
    q, out = query.strip().lower(), F.lit(True)
    if q:
        out = out & (F.contains(F.lower("title"), F.lit(q)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))))
    if topic != "All":
        out = out & F.exists("tags", lambda t: F.lower(t) == topic.lower())
    if aliases:
        out = out & F.arrays_overlap("collections", F.array(*map(F.lit, aliases)))
    return cards.where(out)


def visible_to(df: DataFrame, user: str | None) -> DataFrame:
    own = F.lit(False) if user is None else F.col("owner_id").eqNullSafe(F.lit(user))
    return df.where(F.coalesce("is_public", F.lit(False)) | own)


def mutable_by(df: DataFrame, user: str | None) -> DataFrame:
    return df.where(F.lit(False) if user is None else F.col("owner_id").eqNullSafe(F.lit(user)))


def public_part(df: DataFrame) -> DataFrame:
    """What a guest's export may hold: no owned row that isn't surely public."""
    return df.where(~(F.col("owner_id").isNotNull() & ~F.col("is_public").eqNullSafe(F.lit(True))))


def promote(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """Trending cards of `ids` moved to the library, each merged into the owner's newest library card of its address if any."""
    chosen = cards.where("is_trending").join(ids, "id", "left_semi")
    rows = cards.withColumn("_key", F.struct(F.coalesce("owner_id", F.lit("public")).alias("o"), U.library_url(F.col("source_url")).alias("u")))
    mine = rows.where(~F.col("is_trending") & (F.col("_key.u") != "")).join(chosen.select(F.struct(F.coalesce("owner_id", F.lit("public")).alias("o"), U.library_url(F.col("source_url")).alias("u")).alias("_key")).distinct(), "_key", "left_semi")
    mine = mine.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(F.col("created_at").desc(), "id"))).where("_n = 1").drop("_n", "_key")
    both = mine.unionByName(chosen).withColumns({"_first": F.col("is_trending"), "is_trending": F.lit(False)})
    return dedup_cards(both.withColumn("_order", F.struct("_first", "created_at")), order="_order")


def chat_context(cards: DataFrame, scope: str, limit: int | None = None) -> DataFrame:
    """One text for each value of `scope`: a heading with the number of cards, then a line for each, in order of id.

    With a limit no more than that many lines of a scope are gathered, whatever its size.
    """
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit(""))).alias("t")
    total = cards.groupBy(scope).agg(F.count("*").alias("n_cards"))
    some = cards if limit is None else cards.withColumn("_n", F.row_number().over(W.partitionBy(scope).orderBy("id"))).where(F.col("_n") <= limit)
    lines = some.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("id", line))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["t"]), "\n")
    joined = total.join(lines.withColumnRenamed(scope, "_scope"), F.col(scope).eqNullSafe(F.col("_scope")))
    return joined.select(scope, F.concat_ws("\n", F.concat(F.lit("cards: "), F.col("n_cards").cast("string")), text).alias("context"), "n_cards")


def chat_parts(cards: DataFrame, scope: str, limit: int = 100_000) -> DataFrame:
    """(scope, part, context): chat_context() of scopes of any size, in numbered parts of at most `limit` characters.

    A null scope is one of its own; the parts of a scope in order, joined by nothing, are its whole text.
    """
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit("")))
    key = F.struct(F.col(scope).isNull().alias("none"), F.coalesce(F.col(scope), F.lit("")).alias("scope"))
    rows = cards.select(key.alias("_scope"), F.lit(1).alias("_at"), F.col("id").cast("string").alias("_id"), line.alias("_line_text"))
    heads = rows.groupBy("_scope").agg(F.count("*").alias("_n")).select("_scope", F.lit(0).alias("_at"), F.lit("").alias("_id"), F.concat(F.lit("cards: "), F.col("_n").cast("string")).alias("_line_text"))
    parts = folds.parts(heads.unionByName(rows), "_scope", ["_at", "_id", "_line_text"], "_line_text", limit)
    return parts.select(F.when(~F.col("_scope.none"), F.col("_scope.scope")).alias(scope), "part", F.col("text").alias("context"))


def select_images(images: DataFrame, max_n: int = 7, max_one: int = 5 << 20, max_total: int = 18 << 20, gathered: int = GATHERED) -> DataFrame:
    """(card_id, sent, bytes) of each card's images, in order: one over a bound is left out and smaller ones after it may fit.

    Cards of more images than `gathered` aren't gathered: each of at most max_n rounds finds the first image after the last
    one taken that still fits, a minimum that combines before the shuffle.
    """
    large = store.saved(images.groupBy("card_id").agg(F.count("*").alias("_n")).where(F.col("_n") > gathered).select("card_id"), "image-groups")
    few = images.join(large, "card_id", "left_anti")
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "bytes"))), lambda x: x["bytes"])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("total"))
    fits = lambda s, b: (s["n"] < max_n) & (b > 0) & (b <= max_one) & (s["total"] + b <= max_total)
    fold = F.aggregate(items, start, lambda s, b: F.when(fits(s, b), F.struct((s["n"] + 1).alias("n"), (s["total"] + b).alias("total"))).otherwise(s))
    out = few.groupBy("card_id").agg(fold.alias("s")).select("card_id", F.col("s.n").cast("long").alias("sent"), F.col("s.total").alias("bytes"))
    if large.isEmpty():
        return out
    state = store.saved(large.select("card_id", F.lit(None).cast("struct<pos:bigint,bytes:bigint,k:bigint>").alias("last"), F.lit(0).cast("long").alias("sent"), F.lit(0).cast("long").alias("total")), "image-state")
    # Images of one position and size are told apart by a number of their own.
    usable = images.where((F.col("bytes") > 0) & (F.col("bytes") <= max_one)).join(state.select("card_id"), "card_id").groupBy("card_id", "pos", "bytes").agg(F.count("*").alias("_copies"))
    usable = store.saved(usable, "large-cards").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least("_copies", F.lit(max_n).cast("long")))))
    usable = usable.select("card_id", F.struct(F.col("pos").cast("long").alias("pos"), F.col("bytes").cast("long").alias("bytes"), "k").alias("at"))
    for _ in range(max_n):
        later = F.col("last").isNull() | (F.col("at") > F.col("last"))
        found = usable.join(state, "card_id").where(later & (F.col("total") + F.col("at.bytes") <= max_total)).groupBy("card_id").agg(F.min("at").alias("at"))
        taken = F.col("at").isNotNull()
        state = store.saved(state.join(found, "card_id", "left").select("card_id", F.coalesce("at", "last").alias("last"), (F.col("sent") + taken.cast("int")).alias("sent"), (F.col("total") + F.coalesce("at.bytes", F.lit(0))).alias("total")), "image-state")
    return out.unionByName(state.select("card_id", "sent", F.col("total").alias("bytes")))
