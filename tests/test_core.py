"""Operators of the library against SQL on the given tables, and against small cases."""

import glob
import math
import os
import random
import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curatrix.functions import prompts as P
from curatrix.functions import text as T
from curatrix.functions import times
from curatrix.functions import urls as U
from curatrix.operators import audit, cards, collections, funnel, owners
from curatrix.plans import adapters as A
from curatrix.plans import queries
from curatrix.sources import payloads, tables
from curatrix.sources.buckets import BucketTable
from curatrix.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or type(x).__name__ in ("NAType", "NaTType"):
        return "null"
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_in_sql(spark, sql, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), sql.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda df: sorted([plain(x) for x in r] for r in df[order].astype(object).values.tolist())
    assert rows(got) == rows(want)


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_urls(spark):
    urls = [" https://www.xiaohongshu.com/discovery/item/abc123?xsec_token=a%2Fb#x", "https://xiaohongshu.com/explore/abc", "HTTP://A.Example?x=1#y", "https://a.example/p?q#f", "#", None, "not a url?x", "https://a.example/p#only"]
    assert column(spark, urls, U.library_url) == ["https://www.xiaohongshu.com/explore/abc123?xsec_token=a%2Fb&xsec_source=pc_feed", "https://www.xiaohongshu.com/explore/abc", "http://a.example/", "https://a.example/p", "", "", "not a url", "https://a.example/p"]
    assert column(spark, urls, U.ingest_key)[3:] == ["https://a.example/p", "#", "", "not a url", "https://a.example/p#only"]
    assert column(spark, ["https://x.com/example/status/123456?s=1", "https://www.twitter.com/i/web/status/123456", "https://x.com/other/status/123456", "#", " "], U.is_placeholder_url) == [True, True, False, False, False]
    assert column(spark, ["#", "https://x.com/a/status/1"], U.openable_url) == ["", "https://x.com/a/status/1"]


def test_covers(spark):
    assert column(spark, ["/fallback-covers/cover-007.svg", "/fallback-covers/cover-000.svg", "/dashboard-fallbacks/nature-12.svg?x", "/dashboard-fallbacks/semantic-image-gen.svg", "other"], U.normal_cover) == ["/dashboard-fallbacks/nature-07.svg", "/dashboard-fallbacks/nature-01.svg", "/dashboard-fallbacks/nature-02.svg", "/dashboard-fallbacks/semantic-image-gen.svg", "other"]
    assert column(spark, ["https://a", "/x", "data:image/png", "word", None], U.is_renderable) == [True, True, True, False, False]

    def model(s):
        h, units = 0, s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + (units[i] << 8 | units[i + 1]) + 2**31) % 2**32 - 2**31
        return abs(h)

    seeds = ["", "a", "https://a.example/1?x=2", "封面", "😀 astral", "x" * 300]
    assert column(spark, seeds, U.seed_hash) == [model(s) for s in seeds]


def test_numbers_and_names(spark):
    assert column(spark, ["1.2w", "3k", "1,234", "2 万", "", None, "many", "1.5", "."], T.unit_count) == [12000, 3000, 1234, 20000, 0, 0, 0, 1.5, 0]
    assert column(spark, ["  @Name ", "@@x", " "], T.username) == ["name", "x", ""]
    assert column(spark, [999, 1000, 1234], T.short_count, "long") == ["999", "1.0k", "1.2k"]
    assert column(spark, ["see #a #b,c #a"], T.hashtags) == [["a", "b,c", "a"]]
    assert column(spark, ["　 x \n"], T.trim) == ["x"]
    assert column(spark, ["# A\n- b **c** `d`\n> e ```f```"], T.plain_markdown) == ["A\nb c d\ne f"]


def test_times(spark):
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    texts = ["刚刚", "5 分钟前", "3小时前", "2天前", "01-15", "03-05", "2月3日", "2024-01-02T03:04:05", "2023-12-30 x", "soon", ""]
    want = [datetime(2024, 1, 31, 12), datetime(2024, 1, 31, 11, 55), datetime(2024, 1, 31, 9), datetime(2024, 1, 29, 12), datetime(2024, 1, 15), datetime(2023, 3, 5), datetime(2023, 2, 3), datetime(2024, 1, 2, 3, 4, 5), datetime(2023, 12, 30), None, None]
    assert column(spark, texts, lambda c: times.published(c, now)) == want


def test_prompts(spark):
    texts = ["#topic[tag]#", "skills", "two words", "You are a pirate. Answer all questions as one, please", "/imagine a red fox in the snow --ar 3:2", "short, one", "", "[bracketed only, but long enough]", "x" * 5000]
    assert column(spark, texts, P.is_prompt) == [False, False, False, True, True, False, False, False, False]
    raw = re.compile(r"^(?:#?[^\s#]+(?:\[[^\]]+\])?#?\s*){1,6}$")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab#[] ]") for _ in range(rng.randint(0, 14))).strip()
        assert P._tags_only(t) == bool(raw.match(t)), t


def test_analysis(spark):
    replies = ['```json\n{"summary": " s ", "usageScenarios": ["a", "", "b", "c", "d"], "toolTags": "x;x,y", "suggestedTitle": "t",}\n```', "no json", '{"coreKnowledge": "a\\nb"}']
    out = column(spark, replies, lambda c: P.analysis(c, F.lit("source text")))
    assert out[0]["summary"] == "s" and out[0]["usage_scenarios"] == ["a", "b", "c"] and out[0]["tool_tags"] == ["x", "y"] and out[0]["ok"]
    assert not out[1]["ok"] and out[1]["summary"] == P.NO_FORMAT and out[2]["core_knowledge"] == ["a", "b"] and out[2]["summary"] == "about: source text"


def test_funnel_bounds(spark):
    now = datetime(2024, 1, 31)
    p = funnel.Params(now=now, handles=["@T"], topic=["ai"], positive=["good"], blacklist=["bad"])
    rows = [(1, "notes", "a", 250, 250, datetime(2024, 1, 28), "ai good", "u1"), (2, "notes", "a", 250, 249, now, "ai good", "u2"), (3, "microblog", "t", 999, 0, now, "ai", "u3"), (4, "microblog", "T", 1000, 0, None, "ai", "u4"),
            (5, "microblog", "b", 5000, 0, datetime(2025, 1, 1), "ai bad", "u1"), (6, "microblog", "b", 4999, 0, now, "ai good bad", "u6"), (7, "notes", "t", 1000, 0, datetime(2024, 1, 27), "ai good", "u7"), (8, "microblog", "b", 600, 0, now, "good", "")]
    posts = spark.createDataFrame([(*r[:6], "", *r[6:]) for r in rows], "seq long, platform string, author string, likes long, comments long, published_at timestamp_ntz, title string, descr string, source_url string")
    assert {r["seq"] for r in funnel.flags(posts, p).where("s4").collect()} == {1, 4, 5}
    assert {(r["source_url"], r["seq"]) for r in funnel.candidates(posts, p).collect()} == {("u1", 5), ("u4", 4)}
    total = {r["platform"]: r for r in funnel.funnel(posts, p).collect()}["all"]
    assert [total[c] for c in ("fetched", "s1", "s2", "s3", "s4", "candidates")] == [8, 6, 5, 4, 3, 2]
    assert total["fetched"] >= total["s1"] >= total["s2"] >= total["s3"] >= total["s4"]
    open_bar = funnel.Params(now=now, min_interaction=0, topic=["ai"])
    assert funnel.flags(posts, open_bar).where("s1").count() == 8


CARD = "id string, owner_id string, is_public boolean, title string, source_url string, platform string, author string, cover_image string, likes long, bookmarks long, comments long, raw_content string, user_notes string, summary string, tags array<string>, collections array<string>, usage_scenarios array<string>, core_knowledge array<string>, extracted_prompts array<string>, images array<string>, is_trending boolean, created_at timestamp_ntz, seq long"


def card(n, **kw):
    row = {"id": f"k{n}", "owner_id": "o", "is_public": False, "title": "t", "source_url": "https://a.example/p", "platform": "notes", "author": "a", "cover_image": "", "likes": 0, "bookmarks": 0, "comments": 0, "raw_content": "", "user_notes": "", "summary": "",
           "tags": [], "collections": [], "usage_scenarios": [], "core_knowledge": [], "extracted_prompts": [], "images": [], "is_trending": False, "created_at": datetime(2024, 1, 1, 0, n), "seq": n} | kw
    return tuple(row[c.split()[0]] for c in CARD.split(", "))


def test_dedup_folds_in_order(spark):
    """The middle card is the most complete: its fields stay, the first one's id, all list entries in order, the largest metrics."""
    rows = [card(1, likes=5, tags=["a", " b "], title="first"), card(2, source_url="https://a.example/p?x=1", likes=1, comments=9, tags=["c", "a"], title="second", user_notes="n" * 50, summary="longer", is_public=True), card(3, title="third", tags=["d"], raw_content="text"), card(9, source_url="#", title="alone"), card(10, owner_id=None, tags=None)]
    out = {r["id"]: r for r in cards.dedup_cards(spark.createDataFrame(rows, CARD)).collect()}
    assert set(out) == {"k1", "k9", "k10"}
    r = out["k1"]
    assert (r["title"], r["likes"], r["comments"], r["tags"], r["is_public"], r["n_merged"], r["raw_content"], r["user_notes"], r["source_url"]) == ("second", 5, 9, ["a", "b", "c", "d"], True, 3, "text", "n" * 50, "https://a.example/p")
    again = cards.dedup_cards(cards.dedup_cards(spark.createDataFrame(rows, CARD)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    assert {r["id"] for r in again.collect()} == set(out)


def test_large_groups_merge_as_the_fold(spark):
    """Merged by running values, groups are what the pairwise fold makes of them: random cards, ties, blanks, one large key."""
    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for n in range(260):
        rows.append(card(n % 60, id=f"k{n:03d}", source_url="https://a.example/p" if n < 130 else f"https://b.example/{n % 30}", owner_id=pick("o", "o", "O ", None) if n % 5 == 0 else "o", is_public=pick(True, False, False), title=f"t{n}", author=f"a{n}",
                         cover_image=pick("", "", f"c{n}"), likes=rng.randrange(2000), bookmarks=rng.randrange(300), comments=rng.randrange(50), raw_content=pick("", "x" * rng.randrange(300), f"{n:05d}"), user_notes=pick("", "y" * rng.randrange(40), f"n{n:04d}"),
                         summary=pick("", f"s{n:04d}", "z" * rng.randrange(30)), tags=[pick("a", " b ", "c", f"t{n % 9}") for _ in range(rng.randrange(4))], collections=[f"c{n % 7}"], usage_scenarios=[pick("u", "u", f"u{n % 5}") for _ in range(rng.randrange(3))],
                         extracted_prompts=[f"p{n % 11}"] * rng.randrange(2), images=[f"i{n}"], is_trending=pick(True, False), created_at=datetime(2024, 1, 1, 0, rng.randrange(50))))
    df = spark.createDataFrame(rows, CARD)
    known = lambda out: {r["id"]: r.asDict() for r in out.collect()}
    fold, large = known(cards.dedup_cards(df)), known(cards.dedup_cards(df, gathered=1))
    assert fold == large and max(r["n_merged"] for r in fold.values()) > 90 and known(cards.dedup_cards(df, gathered=10)) == fold


def test_groups_of_one_are_not_gathered(spark):
    """Their heavy columns meet no collect_list: what is gathered was joined with the keys of several cards."""
    plan = cards.dedup_cards(spark.createDataFrame([card(1), card(2), card(3, source_url="#")], CARD))._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list") :]
    assert "LeftAnti" in plan[: plan.index("collect_list")] and re.search("Join Inner", gathered)


def test_image_rounds(spark):
    rng = random.Random(9)
    rows = [(f"c{n % 3}", rng.randrange(40), rng.choice([0, 3, 5, 8, 9, 20, -1])) for n in range(150)] + [("one", 1, 3)]
    df = spark.createDataFrame(rows, "card_id string, pos int, bytes long")
    sent = lambda out: {(r["card_id"], r["sent"], r["bytes"]) for r in out.collect()}
    args = {"max_n": 4, "max_one": 9, "max_total": 21}
    assert sent(cards.select_images(df, **args)) == sent(cards.select_images(df, **args, gathered=2))


def test_chat_parts(spark):
    """Parts of a large scope are under the limit, and joined they are the whole text; long lines are cut, null is a scope."""
    rows = [(f"k{n:06d}", "big" if n % 3 else None, f"t{n}", "s" * (n % 50)) for n in range(150_000)] + [("x", "long", "t", "w" * 5000), ("y", "", None, None)]
    df = spark.createDataFrame(rows, "id string, scope string, title string, summary string")
    whole = {r["scope"]: r["context"] for r in cards.chat_context(df, "scope").collect()}
    parts = {}
    for r in sorted(cards.chat_parts(df, "scope", 4000).collect(), key=lambda r: r["part"]):
        assert 0 < len(r["context"]) <= 4000
        parts[r["scope"]] = parts.get(r["scope"], "") + r["context"]
    assert parts == whole and whole["big"].startswith("cards: 100000\n")


def test_library_rows_count_keywords_once(spark):
    """No step of the plan searches a text for a keyword that another step has counted."""
    plan = queries.QUERIES["sc3_library_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") <= sum(map(len, T.SCORED.values())) + 30
    assert column(spark, [None, "", " \u00a0\ufeff\n", " x "], T.is_blank) == [True, True, True, False]


def test_lists_of_any_length(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "id int, k int")
    got = [(r["k"], r["id"], r["rank"]) for r in collections.listed(df, [F.col("k").desc(), F.col("id")]).orderBy("rank").collect()]
    assert got == [(k, i, n) for n, (k, i) in enumerate(sorted(((i % 5, i) for i in range(500)), key=lambda x: (-x[0], x[1])), 1)]


def test_terms_of_many_owners(spark):
    """Terms in several automata find what one finds, and what `in` finds; blank terms and null texts are passed over."""
    rng = random.Random(3)
    posts = [(i, "".join(rng.choice("abc ") for _ in range(12)) if i % 9 else None) for i in range(60)]
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(15)} | {""}
    df, t = spark.createDataFrame(posts, "seq long, descr string"), spark.createDataFrame([(x,) for x in terms] + [(None,)], "term string")
    want = {(i, x) for i, text in posts for x in terms if x and text and x in text}
    for chars in (1000, 6):
        got = [(r["seq"], r["term"]) for r in owners.hits(df, F.col("descr"), t, chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert owners.hits(df, F.col("descr"), t.limit(0)).count() == 0


def test_owners_totals_are_those_of_the_pairs(spark, monkeypatch):
    """Whether posts that are alike are summed up, in one block of groups or in many, or the pairs are listed; owners' pairs aren't made."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abc" for b in "abc"]
    posts = [(i, rng.choice(["microblog", "notes", None]), rng.choice([None, "", "Ab cc"]), rng.choice([None, " ".join(rng.choice(words + ["zz"]).upper() for _ in range(3))]), rng.choice([None, "@A1", "a2 ", "a3"]), rng.choice([None, 100, 600, 1200, 6000]), rng.choice([None, 5]), rng.choice([None, datetime(2024, 1, 30), datetime(2024, 1, 2)])) for i in range(300)]
    lists = [(rng.choice([None, *[f"u{i}" for i in range(20)]]), rng.choice(["topic", "topic", "positive", "blacklist", "other"]), rng.choice([*words, " AA", "", None, "c\nb"])) for _ in range(120)]
    handles = [(f"u{i}", rng.choice(["@a1", "A2", "", None, "a9"])) for i in range(0, 24, 2)]
    p = replace(A.PARAMS, now=datetime(2024, 1, 31))
    tables = [spark.createDataFrame(rows, kind) for rows, kind in ((posts, "seq long, platform string, title string, descr string, author string, likes long, comments long, published_at timestamp_ntz"), (lists, "owner_id string, type string, keyword string"), (handles, "owner_id string, handle string"))]
    sums = lambda q: {r["owner_id"]: tuple(r)[1:] for r in owners.totals(*tables, q).collect()}
    for q in (p, replace(p, min_interaction=0), replace(p, min_interaction=2000, trusted_min=500)):
        want = {}
        for r in owners.candidates(*tables, q).collect():
            n, seqs, scores, trusted = want.get(r["owner_id"], (0, 0, 0, 0))
            want[r["owner_id"]] = (n + 1, seqs + r["seq"], scores + r["score"], trusted + r["trusted"])
        assert want and sums(q) == want
    with monkeypatch.context() as m:
        m.setattr(owners, "GROUPS", 7)
        assert sums(q) == want
    with monkeypatch.context() as m:
        m.setattr(owners, "BITS", 5)
        assert sums(q) == want
    monkeypatch.setattr(owners, "candidates", None)
    assert sums(q) == want and queries.QUERIES["fl5_candidates_by_owner"](spark, SF).count() > 0


def test_cleanup_ties_and_owner(spark):
    rows = [card(1, is_trending=True, tags=["x"]), card(2, tags=["y"]), card(3, tags=["y"], owner_id="p"), card(4, source_url="https://b.example/")]
    df = spark.createDataFrame(rows, CARD)
    r = cards.cleanup_cards(df).collect()
    assert [(x["id"], x["tags"], x["is_trending"], x["n_deleted"]) for x in r] == [("k2", ["y", "x"], False, 2)]
    assert {x["id"] for x in cards.cleanup_deletes(df).collect()} == {"k1", "k3"}
    assert [x["n_deleted"] for x in cards.cleanup_cards(df, by_owner=True).collect()] == [1]


def test_snapshots(spark):
    rows = [card(n, is_trending=True, tags=[f"snapshot:2024-01-0{n}"] if n < 7 else ["plain"], source_url=f"https://a.example/{n}") for n in range(1, 9)]
    df = spark.createDataFrame(rows, CARD)
    assert {r["id"] for r in cards.kept_snapshots(df).collect()} == {f"k{n}" for n in range(2, 7)}
    assert {r["id"] for r in cards.kept_snapshots(df, 7).collect()} == {f"k{n}" for n in range(1, 9)}
    assert {r["id"] for r in cards.current_trending(df).collect()} == {"k7", "k8"}


def test_images_are_greedy(spark):
    rows = [("a", 1, 6), ("a", 2, 9), ("a", 3, 5), ("a", 4, 4), ("a", 5, 1), ("b", 1, 0)]
    out = cards.select_images(spark.createDataFrame(rows, "card_id string, pos int, bytes long"), max_n=3, max_one=8, max_total=11)
    assert {(r["card_id"], r["sent"], r["bytes"]) for r in out.collect()} == {("a", 2, 11), ("b", 0, 0)}


def test_rankings_fill(spark):
    rows = [card(n, likes=n) for n in range(1, 8)]
    df = spark.createDataFrame(rows, CARD).withColumn("category", F.when(F.col("seq") % 3 == 0, "x").otherwise("y"))
    out = sorted((r["slot"], r["rank"], r["id"]) for r in cards.category_rankings(df, ["x", "y"]).collect())
    assert out == [("x", 1, "k6"), ("x", 2, "k3"), ("x", 3, "k7"), ("y", 1, "k5"), ("y", 2, "k4"), ("y", 3, "k2")]


def test_rank_posts_drops_zeros(spark):
    posts = lambda n: spark.createDataFrame([(i, max(0, n - i), 0, 0, 0) for i in range(10)], "seq long, likes long, comments long, bookmarks long, shares long")
    assert funnel.rank_posts(posts(6), "popular", 8).count() == 6 and funnel.rank_posts(posts(3), "popular", 8).count() == 8 and funnel.rank_posts(posts(3), "?", 4).count() == 4


def test_collections(spark):
    rows = [card(1, collections=["a", "b", "a", ""]), card(2, collections=["b"]), card(3, collections=None), card(4, collections=["a"], is_trending=True)]
    assert {(r["collection_id"], r["n_cards"]) for r in collections.collection_counts(spark.createDataFrame(rows, CARD)).collect()} == {("a", 1), ("b", 2)}
    own = spark.createDataFrame([("a", 9), ("b", 3), ("c", -2)], "id string, item_count long")
    counts = lambda rows: spark.createDataFrame(rows, "collection_id string, n_cards long")
    got = {r["id"]: r["item_count"] for r in collections.with_counts(own, counts([("a", 2), ("b", 0)]), counts([("a", 5)])).collect()}
    assert got == {"a": 2, "b": 0, "c": 0}
    assert column(spark, [["x", "al", "y", "y"]], lambda c: collections.without_aliases(c, ["al"]), "array<string>") == [["x", "y", "y"]]


def test_guests_and_users(spark):
    df = spark.createDataFrame([("a", "o", False), ("b", "o", None), ("c", None, None), ("d", "p", True)], "id string, owner_id string, is_public boolean")
    assert {r["id"] for r in cards.public_part(df).collect()} == {"c", "d"}
    assert {r["id"] for r in cards.visible_to(df, None).collect()} == {"d"} and {r["id"] for r in cards.mutable_by(df, "o").collect()} == {"a", "b"} and cards.mutable_by(df, None).count() == 0


def test_list_reads_no_heavy_columns(spark, tmp_path):
    spark.createDataFrame([card(1)], CARD).write.parquet(f"{tmp_path}/cards")
    plan = lambda df: re.findall(r"ReadSchema: \S+", df._jdf.queryExecution().toString())[-1]
    read = plan(cards.list_cards(spark.read.parquet(f"{tmp_path}/cards"), False, 0, 10))
    assert "raw_content" not in read and "user_notes" not in read and "images" not in read
    assert "title" not in plan(collections.collection_counts(spark.read.parquet(f"{tmp_path}/cards")))


def test_funnel_has_no_python(spark):
    plan = funnel.funnel(A.posts(spark, SF), A.PARAMS)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, at int")
    rows = lambda df: {(r["k"], r["v"]) for r in df.collect()}
    assert rows(tables.upsert(t, new, ["k"], "at")) == {("a", 1), ("b", 3), ("c", 4)} and rows(tables.upsert(t, new, ["k"], "at", update=False)) == {("a", 1), ("b", 1), ("c", 4)}
    tables.append(t, f"{tmp_path}/t", ids="id")
    tables.append(t, f"{tmp_path}/t", ids="id")
    assert tables.read_table(spark, f"{tmp_path}/t", ["id"]).distinct().count() == 4
    uid = "123e4567-e89b-42d3-a456-426614174000"
    stored = spark.createDataFrame([(uid, "old", "old")], "id string, raw_content string, user_notes string")
    now = spark.createDataFrame([(uid, "", "", False), ("x", "new", "n", True)], "id string, raw_content string, user_notes string, detail_loaded boolean")
    assert {(r["id"], r["raw_content"]) for r in tables.to_storage(now, stored).collect()} == {(uid, "old"), (None, "new")}


MICRO = """{"data":[{"id":"1","text":"ai good news","author_id":"u","created_at":"2024-01-30T00:00:00Z","attachments":{"media_keys":["m2","m1","m9"]},"public_metrics":{"like_count":600,"reply_count":1}},{"id":"2","text":"ai good","author_id":"z","public_metrics":{"like_count":700}}],"includes":{"users":[{"id":"u","username":"ann","name":"Ann"}],"media":[{"media_key":"m1","type":"photo","url":"p1"},{"media_key":"m2","type":"video","preview_image_url":"v2"},{"media_key":"m9","type":"poll","url":"no"}]}}"""


def test_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(MICRO)
    posts = {r["note_id"]: r for r in payloads.flatten_microblog(payloads.read_microblog(spark, str(tmp_path))).collect()}
    assert posts["1"]["images"] == ["v2", "p1"] and posts["1"]["source_url"] == "https://x.com/ann/status/1" and posts["1"]["title"] == "" and posts["1"]["likes"] == 600
    assert posts["2"]["source_url"] == "https://x.com/i/web/status/2" and posts["2"]["images"] == [] and posts["2"]["author"] is None
    a = spark.createDataFrame([('{"code":0,"data":{"items":[{"model_type":"note","note":{"id":"n1","title":"t","liked_count":"1.2w","images_list":[{"url":"http://i"}],"xsec_token":"k"}},{"model_type":"ad","note":{"id":"n2"}},{"model_type":"note"}]}}',)], "j string").select(F.from_json("j", payloads.NOTES_A_SCHEMA).alias("x")).select("x.*")
    assert [(r["note_id"], r["likes"], r["images"]) for r in payloads.flatten_notes(a, "a").collect()] == [("n1", 12000, ["http://i"])]
    b = spark.createDataFrame([('{"data":{"notes":[{"note":{"id":"n3","desc":"d"}},{"id":"n4"},{"title":"no id"}]}}',), ('{"data":"{\\"items\\":[{\\"note\\":{\\"id\\":\\"n5\\"}}]}"}',)], "value string")
    assert {r["note_id"] for r in payloads.flatten_notes(b, "b").collect()} == {"n3", "n4", "n5"} and payloads.flatten_notes(b, "b", 1).count() == 2
    d = spark.createDataFrame([('{"note_id":"n6","liked_count":0,"likes":5,"collect_count":"3k","url":"https://a","share_url":"https://b?xsec_token=1","images":["x","x",""]}',)], "value string")
    r = payloads.flatten_note_detail(d).first()
    assert (r["likes"], r["bookmarks"], r["images"], r["source_url"]) == (0, 3000, ["x"], "https://b?xsec_token=1")


ASKED = funnel.Params(now=datetime(2024, 1, 31), topic=["ai"], positive=["good"])
NOTES_A = '''{"code":0,"data":{"items":[{"model_type":"note","note":{"id":"n1","title":"ai","desc":"good","liked_count":"1.2w","corner_tag_info":[{"type":"publish_time","text":"01-30"}]}},{"model_type":"ad","note":{"id":"n2"}},{"model_type":"note","note":{"id":"n8","title":"ai good","liked_count":900}}]}}'''
NOTES_B = '''{"data":{"notes":[{"note":{"id":"n3","title":"ai","desc":"good","liked_count":700}},{"title":"no id"}]}}'''


def land(landing, kind, name, text):
    (landing / kind).mkdir(parents=True, exist_ok=True)
    (landing / kind / name).write_text(text)


def stored(spark, out):
    return {r["source_url"].split("/")[-1].split("?")[0]: (r["likes"], r["date"]) for r in ingest.current(spark, out).collect()}


def logged(spark, out):
    """What was counted for each batch, in order."""
    rows = spark.read.parquet(f"{out}-log").where("platform = 'all'").orderBy("batch").collect()
    return [(r["inserted"], r["refreshed"], r["rejected"]) for r in rows]


def test_stream_equals_batch(spark, tmp_path):
    """Mixed folders with a broken file: what one batch makes of all of them, and the broken lines beside it."""
    landing, out = tmp_path / "in", f"file://{tmp_path}/cards"
    land(landing, "microblog", "1.json", MICRO)
    land(landing, "notes-a", "1.json", NOTES_A)
    land(landing, "microblog", "bad.json", '{"data": [{"id": "9", \n{"data": 5}\n\n')
    ingest.run(spark, str(landing), out, f"{tmp_path}/cp", ASKED, "o")
    land(landing, "microblog", "2.json", MICRO.replace('"id":"2"', '"id":"3"'))
    land(landing, "notes-b", "1.json", NOTES_B + "\nnot json")
    land(landing, "other", "1.json", "{}")
    ingest.run(spark, str(landing), out, f"{tmp_path}/cp", ASKED, "o")
    posts, rejects = ingest.parsed(ingest.landed_lines(spark, str(landing), False))
    want = funnel.dedup_last(ingest.passed(posts, ASKED)).select("source_url", "likes", F.col("publish_time").alias("date")).collect()
    assert stored(spark, out) == {r["source_url"].split("/")[-1].split("?")[0]: (r["likes"], r["date"] or "") for r in want} and len(want) == 6
    assert sorted(r["value"] for r in spark.read.parquet(f"{out}-rejects").collect()) == sorted(r["value"] for r in rejects.collect()) == ["not json", '{"data": 5}', '{"data": [{"id": "9", ', "{}"]
    assert logged(spark, out) == [(4, 0, 2), (2, 0, 2)]


def test_state_takes_packed_posts():
    """An address's last post by place, not by text, of one row or several; what was seen last isn't passed on."""
    import pandas as pd

    class State:
        hasTimedOut, kept = False, None
        exists = property(lambda s: s.kept is not None)
        get = property(lambda s: s.kept)

        def update(self, kept):
            self.kept = kept

        def setTimeoutTimestamp(self, at):
            self.at = at

    post = lambda landed, pos, file, body: "\u0001".join([str(landed), str(pos), file, body])
    rows = [("a", post(5, 9, "f", "x"), 1), ("a", post(5, 10, "f", "y\u0001z"), 2), ("a", post(5, 99, "e", "w"), 3)]
    frames = [pd.DataFrame(rows[:2], columns=["source_url", "post", "signature"]), pd.DataFrame(rows[2:], columns=["source_url", "post", "signature"])]
    state, pass_on = State(), ingest.newer(0, 1, 2)
    assert [f.values.tolist() for f in pass_on(("a", True), iter(frames), state)] == [[["a", rows[1][1]]]]
    assert list(pass_on(("a", True), iter([frames[0].iloc[1:]]), state)) == [] and state.kept == (2,) and state.at == 86_400_000
    assert [f["post"].tolist() for f in pass_on(("a", True), iter([frames[1]]), state)] == [[rows[2][1]]]


def test_cards_search_a_text_once(spark):
    posts = A.posts(spark, SF)
    rows = cards.trending_rows(posts, "snapshot:x", "o1")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("aiartcommunity") <= 2
    want = {r["seq"]: r["c"] for r in posts.select("seq", T.category_first(F.when(F.col("descr") != "", F.col("descr")).otherwise(F.col("title"))).alias("c")).collect()}
    got = {r["seq"]: next((t for t in r["tags"] if t in T.FIRST_MATCH), "") for r in rows.collect()}
    assert got == want


def test_stream_refreshes_and_retains(spark, tmp_path):
    """Posts that land again with other likes are refreshed and logged, a replay changes nothing, old snapshots go."""
    landing, out = tmp_path / "in", f"file://{tmp_path}/cards"
    run = lambda day=31: ingest.run(spark, str(landing), out, f"{tmp_path}/cp", replace(ASKED, now=datetime(2024, 1, day)), "o", keep=2)
    land(landing, "microblog", "1.json", MICRO)
    run()
    assert stored(spark, out) == {"1": (600, "2024-01-30T00:00:00Z"), "2": (700, "")}
    land(landing, "microblog", "2.json", MICRO.replace("600", "650"))  # the other post as it was
    run()
    assert {k: v[0] for k, v in stored(spark, out).items()} == {"1": 650, "2": 700} and logged(spark, out) == [(2, 0, 0), (0, 1, 0)]
    before = ingest.current(spark, out).collect()
    land(landing, "microblog", "3.json", MICRO.replace("600", "650"))  # a replay
    run()
    assert sorted(map(str, ingest.current(spark, out).collect())) == sorted(map(str, before)) and logged(spark, out)[2:] == [(0, 0, 0)]
    land(landing, "notes-b", "4.json", NOTES_B)
    run()  # of batches 0, 1 and 3 the last two stay
    assert set(stored(spark, out)) == {"1", "n3"} and logged(spark, out)[3:] == [(1, 0, 0)]
    snapshots = {r["s"] for r in ingest.current(spark, out).select(cards.latest_snapshot(F.col("tags")).alias("s")).collect()}
    assert snapshots == {"snapshot:2024-01-31:000001", "snapshot:2024-01-31:000003"}


def test_a_batch_runs_again(spark, tmp_path):
    """A batch that broke off after its write is written once more, from the version before it."""
    landing, out = tmp_path / "in", f"file://{tmp_path}/cards"
    land(landing, "microblog", "1.json", MICRO)
    posts, rejects = ingest.parsed(ingest.landed_lines(spark, str(landing), False))
    for number in (0, 1, 1):
        ingest.write_batch(spark, out, ingest.passed(posts, ASKED), rejects, number, f"snapshot:{number}", "o", 5)
    assert len(stored(spark, out)) == 2 and logged(spark, out) == [(2, 0, 0), (0, 2, 0)]


def test_posts_without_time(spark, tmp_path):
    """They are neither lost nor doubled over three runs, and neither they nor a post of the future move the watermark."""
    landing, out = tmp_path / "in", f"file://{tmp_path}/cards"
    for n, likes in enumerate((700, 700, 800)):
        text = MICRO.replace("700", str(likes))
        land(landing, "microblog", f"{n}.json", text.replace("2024-01-30", "2034-01-30") if n == 0 else text)
        q = ingest.run(spark, str(landing), out, f"{tmp_path}/cp", ASKED, "o")
        assert {k: v[0] for k, v in stored(spark, out).items()} == {"1": 600, "2": likes}
        assert all(x["eventTime"].get("watermark", "1970") <= "2024-01-24T00:00:00.000Z" for x in q.recentProgress)
    assert logged(spark, out) == [(2, 0, 0), (0, 1, 0), (0, 1, 0)]


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_bucket_table(spark, tmp_path):
    """An upsert writes the buckets it touches; a version without commit is never read; old versions expire."""
    table = BucketTable(f"file://{tmp_path}/t", "k string, v int, at int, heavy string", ("k",), buckets=8)
    rows = lambda n, v, at=1: spark.createDataFrame([(f"k{i}", v, at, "x" * 50) for i in n], "k string, v int, at int, heavy string")
    have = lambda: {r["k"]: r["v"] for r in table.read(spark, ["k", "v"]).collect()}
    assert have() == {} and table.lookup(spark, ["k1"]).count() == 0
    table.upsert(spark, rows(range(40), 0), "at")
    first = files(f"{tmp_path}/t/data")
    table.upsert(spark, rows([3], 1).union(rows([3], 2, 2)), "at")
    assert have() == {f"k{i}": 2 if i == 3 else 0 for i in range(40)}
    second = files(f"{tmp_path}/t/data") - first
    assert first <= files(f"{tmp_path}/t/data") and len({f.split("/")[1] for f in second}) == 1
    table.upsert(spark, rows([3, 99], 7), "at", update=False)
    assert have()["k3"] == 2 and have()["k99"] == 7
    # A write that breaks off before its commit, then one whose commit has no file yet.
    rows([3], 5).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/batch=4-broken")
    os.makedirs(f"{tmp_path}/t/commits/version=4/_temporary")
    assert have()["k3"] == 2 and table.versions(spark) == [1, 2, 3]
    table.delete(spark, spark.createDataFrame([("k3",), ("k4",)], "k string"))
    assert table.versions(spark) == [1, 2, 3, 4] and len(have()) == 39
    table.expire(spark, keep=1)
    assert table.versions(spark) == [4] and len(have()) == 39 and not glob.glob(f"{tmp_path}/t/data/batch=4-broken") and second.isdisjoint(files(f"{tmp_path}/t/data"))
    one = table.lookup(spark, ["k5"], ["v"])
    plan = one._jdf.queryExecution().toString()
    assert one.collect()[0]["v"] == 0 and re.findall(r"ReadSchema: \S+", plan)[-1] == "ReadSchema: struct<k:string,v:int>"
    assert len({f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1 and "heavy" not in re.findall(r"ReadSchema: \S+", plan)[-1]
    with pytest.raises(ValueError, match="other buckets"):
        table.rewrite(spark, 5, [0], lambda old: table.read(spark))
    assert table.versions(spark) == [4]


def test_short_counts_and_owner(spark):
    assert [x for x in column(spark, ["1250", "1150", "1350", "1450", "999", "9950", "2750"], lambda c: T.short_count(c.cast("long")))] == ["1.3k", "1.1k", "1.4k", "1.4k", "999", "9.9k", "2.8k"]
    profiles = spark.createDataFrame([("1", "@Ann"), ("2", "bob")], "id string, username string")
    assert audit.resolve_owner(profiles, "ann").first()["id"] == "1"
    for read in (lambda d: d.collect(), lambda d: d.select("username").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="profiles are named eve"):
            read(audit.resolve_owner(profiles, "eve"))


def test_tokens_and_reports(spark):
    s = spark.createDataFrame([("o", "note_tokens", '[{"noteId":"1","token":"a","updatedAt":"1"},{"noteId":"2","token":" "},{"noteId":"1","token":"b","updatedAt":"2"}]')], "owner_id string, key string, value string")
    tokens = audit.parse_tokens(s)
    assert [(r["note_id"], r["token"]) for r in tokens.orderBy("pos").collect()] == [("1", "a"), ("1", "b")]
    assert '"token":"b"' in audit.upsert_tokens(tokens, tokens.limit(0)).first()["value"]
    assert audit.recent_logs(spark.createDataFrame([(str(i), datetime(2024, 1, 1)) for i in range(50)], "id string, created_at timestamp_ntz"), float("nan")).count() == 30
    e = column(spark, ['API Error: 429 {"error":{"code":429,"message":"retry in 2.1s"}}', "status: 500", None], T.quota_error)
    assert [(x["is_quota"], x["retry_seconds"]) for x in e] == [(True, 3), (False, None), (False, None)]
