"""Text columns: trimming, lists, keywords, hashtags, categories, counts, replies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import CODING, FIRST_MATCH, IMAGE, RELEVANT, SCORED, VIDEO

_EDGE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def trim(c: Column) -> Column:
    """Without white space of any script at both ends; null: empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGE, "")


def is_blank(c: Column) -> Column:
    """Whether trim() leaves nothing; looks no further than the first other character."""
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x{FEFF}]")


def norm(c: Column) -> Column:
    return F.lower(trim(c))


def texts(values: Column) -> Column:
    """A list without nulls, empties and outer white space."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), trim), lambda x: x != "")


def distinct_texts(values: Column) -> Column:
    """texts(), each once, in the order first seen."""
    return F.array_distinct(texts(values))


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is a substring (not a word): one alternation over the text, whatever the list's length."""
    words = [k for k in keywords if k]
    return F.coalesce(text, F.lit("")).rlike("|".join(re.escape(k) for k in words)) if words else F.lit(False)


def relevant(text: Column, keywords: Sequence[str] = RELEVANT) -> Column:
    return any_keyword(F.lower(text), [k.lower() for k in keywords])


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)#[^\s#]+"), F.lit(0)), lambda t: F.substring(t, 2, 1_000_000))


def category_first(text: Column, lists: Mapping[str, Sequence[str]] = FIRST_MATCH, gate: Sequence[str] | None = RELEVANT) -> Column:
    """The first category with a keyword in the text; none ('') if a gate is given that doesn't hold."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("")
    for name in reversed(list(lists)):
        out = F.when(any_keyword(t, lists[name]), name).otherwise(out)
    return out if gate is None else F.when(relevant(text, gate), out).otherwise("")


def category_held(t: Column, lists: Mapping[str, Sequence[str]] = FIRST_MATCH, gate: Sequence[str] = RELEVANT) -> Column:
    """category_first() of a column that is in lower case already: plain searches, of which the first hit ends a list's."""
    held = lambda words: reduce(Column.__or__, [F.contains(t, F.lit(k)) for k in words if k], F.lit(False))
    out = F.lit("")
    for name in reversed(list(lists)):
        out = F.when(held(lists[name]), name).otherwise(out)
    return F.when(held([k.lower() for k in gate]), out).otherwise("")


def keyword_count(t: Column, keywords: Sequence[str]) -> Column:
    """How many keywords a text in lower case holds."""
    return sum((F.contains(t, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    return keyword_count(F.lower(F.coalesce(text, F.lit(""))), keywords)


#: Of categories with as many keywords, the first.
TIED = (VIDEO, IMAGE, CODING)


def best_scored(scores: Mapping[str, Column]) -> Column:
    """The category with the highest score; ties by TIED; '' if all are 0."""
    best = F.greatest(*[F.struct(scores[k].alias("score"), F.lit(-place).alias("place"), F.lit(k).alias("name")) for place, k in enumerate(TIED)])
    return F.when(best["score"] > 0, best["name"]).otherwise("")


def best_untied(scores: Mapping[str, Column]) -> Column:
    """The category with the highest score; '' if the best two tie."""
    top = F.sort_array(F.array(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in scores.items()]), asc=False)
    return F.when((top[0]["s"] == 0) | (top[0]["s"] == top[1]["s"]), "").otherwise(top[0]["k"])


def category_scored(text: Column, lists: Mapping[str, Sequence[str]] = SCORED) -> Column:
    """The category with most keywords; ties by TIED; '' without any keyword."""
    return best_scored({k: keyword_score(text, words) for k, words in lists.items()})


def category_untied(text: Column, lists: Mapping[str, Sequence[str]] = SCORED) -> Column:
    """The category with most keywords; '' if the best two tie."""
    return best_untied({k: keyword_score(text, words) for k, words in lists.items()})


def category_label(c: Column) -> Column:
    """A free category label as one of the three, else ''."""
    t = norm(c)
    return F.when(t.contains("image"), IMAGE).when(t.contains("video"), VIDEO).when(t.contains("coding") | t.contains("code"), CODING).otherwise("")


def library_label(c: Column) -> Column:
    """A free category label as the library reads it: by 'image', 'video' or 'vibe', else ''."""
    t = norm(c)
    return F.when(t.contains("image"), IMAGE).when(t.contains("video"), VIDEO).when(t.contains("vibe"), CODING).otherwise("")


def unit_count(c: Column) -> Column:
    """'1,234', '1.2w', '3k' as numbers; what isn't one counts 0."""
    t = F.regexp_replace(norm(c.cast("string")), ",", "")
    number = F.regexp_extract(t, r"^([\d.]+)\s*(w|万|k|千)$", 1)
    unit = F.regexp_extract(t, r"^([\d.]+)\s*(w|万|k|千)$", 2)
    base = number.try_cast("double")
    scaled = F.floor(base * F.when(unit.isin("w", "万"), 10000).otherwise(1000) + 0.5)
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), t.try_cast("double"))
    return F.coalesce(F.when(unit != "", scaled.cast("double")).when(t == "", F.lit(0.0)).otherwise(plain), F.lit(0.0))


def short_count(n: Column) -> Column:
    """1234 as '1.2k'; below a thousand as it is. Rounds the binary quotient to the nearest tenth, exact ties up."""
    x = n / F.lit(1000.0)
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)  # the upper half of x's bits, so products with it are exact
    above = (high * 1000 - n) + (x - high) * 1000 >= 0  # whether the quotient lies above the tie or on it
    tenths = F.floor(n / 100) + F.when((n % 100 > 50) | ((n % 100 == 50) & above), 1).otherwise(0)
    return F.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def handle(c: Column) -> Column:
    """An account's handle: leading @ go first, then white space."""
    return F.lower(trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^@+", "")))


def username(c: Column) -> Column:
    """A login name: white space goes first, then leading @."""
    return F.lower(F.regexp_replace(trim(c), "^@+", ""))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


# What asks for markdown, and the marks that are taken out, in this order.
MARKDOWN = "(?i)(markdown|md格式|用md|代码块|```|表格|标题|列表)"
MARKS = ((r"(?s)```(.*?)```", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s+", ""))


def wants_markdown(c: Column) -> Column:
    return F.coalesce(c.rlike(MARKDOWN), F.lit(False))


def plain_markdown(c: Column) -> Column:
    """Without markdown marks."""
    out = F.coalesce(c, F.lit(""))
    for pattern, to in MARKS:
        out = F.regexp_replace(out, pattern, to)
    return out


# What a run's failure is called, by the first match.
FAILURES = [
    (("failed to fetch",), "network"), (("unauthorized", "401"), "unauthorized"), (("forbidden", "403"), "forbidden"),
    (("token invalid", "unactivate"), "token"), (("timeout",), "timeout"),
]


def failure_class(message: Column) -> Column:
    """The class of a failure by its message; 'none' without one, 'other' if nothing fits."""
    t = norm(message)
    out = F.when(t == "", "none")
    for words, name in FAILURES:
        out = out.when(any_keyword(t, words), name)
    return out.otherwise("other")


def quota_error(message: Column) -> Column:
    """(is_quota, retry_seconds) of a service's error text."""
    m = F.coalesce(message, F.lit(""))
    json = F.regexp_extract(m, r"(?s)(\{.*)", 1)
    inner = F.coalesce(F.get_json_object(json, "$.error.code"), F.get_json_object(json, "$.code"))
    text = F.concat_ws("\n", m, F.coalesce(F.get_json_object(json, "$.error.message"), F.get_json_object(json, "$.message")))
    code = F.coalesce(inner.try_cast("int"), F.regexp_extract(m, r"(?i)\b(?:API Error|status)\s*[:=]?\s*(\d{3})\b", 1).try_cast("int"))
    wait = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)retry in\s+([\d.]+)s", 1), F.lit("")), F.nullif(F.regexp_extract(text, r'(?i)"retryDelay":"(\d+)s"', 1), F.lit("")))
    quota = (F.coalesce(code, F.lit(0)) == 429) | text.rlike(r"(?i)RESOURCE_EXHAUSTED|quota|rate[\s-]?limit|too many requests")
    return F.struct(quota.alias("is_quota"), F.ceil(wait.try_cast("double")).alias("retry_seconds"))
