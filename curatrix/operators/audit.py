"""Run logs, call traces, settings, keyword lists, tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions import urls as U

TOKENS = T_.ArrayType(T_.StructType([T_.StructField(n, T_.StringType()) for n in ("noteId", "token", "source", "updatedAt")]))


def api_call_summary(calls: DataFrame) -> DataFrame:
    """Calls, results and calls with results: in total, by platform and by provider. Blank names are 'unknown'."""
    name = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.col(c))
    rows = calls.select(name("platform").alias("platform"), name("provider").alias("provider"), "result_count")
    out = rows.groupingSets([["platform"], ["provider"], []], "platform", "provider").agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum("result_count").alias("results"), F.count_if(F.col("result_count") > 0).alias("with_results"))
    return out.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "platform").otherwise("provider").alias("level"), F.coalesce("platform", "provider", F.lit("all")).alias("name"), "calls", "results", "with_results")


def run_report(logs: DataFrame) -> DataFrame:
    """(id, status, seconds, failure) of runs: skipped beats success beats failure."""
    errors = F.transform(F.coalesce("platform_errors", F.array().cast("array<struct<platform:string,error:string>>")), lambda e: F.concat(e["platform"], F.lit(": "), e["error"]))
    failure = F.array_join(F.concat(F.when(F.coalesce("error_message", F.lit("")) != "", F.array("error_message")).otherwise(F.array().cast("array<string>")), errors), "; ")
    status = F.when(F.coalesce("runtime_guard_triggered", F.lit(False)), "SKIPPED").when(F.coalesce("success", F.lit(False)), "SUCCESS").otherwise("FAILED")
    return logs.select("id", status.alias("status"), F.greatest(F.lit(1), F.floor(F.coalesce("runtime_ms", F.lit(0)) / 1000 + 0.5)).cast("long").alias("seconds"), failure.alias("failure"))


def recent_logs(logs: DataFrame, n: float | None) -> DataFrame:
    """The newest n, floored and kept in 1..200; 30 if n is no number."""
    count = 30 if n is None or n != n else max(1, min(200, int(n // 1)))
    return logs.orderBy(F.col("created_at").desc(), "id").limit(count)


def monitor_settings(rows: DataFrame, defaults: Mapping[str, int], fallbacks: Mapping[str, str] | None = None) -> DataFrame:
    """Key and value rows as a typed row for each owner; bad or negative values take the default, a legacy key stands in first."""
    keys = [*defaults, *(fallbacks or {}).values()]
    wide = rows.groupBy("owner_id").agg(*[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("updated_at"))).alias(f"_{k}") for k in dict.fromkeys(keys)])
    sound = lambda k: F.when(F.col(f"_{k}").try_cast("double") >= 0, F.floor(F.col(f"_{k}").try_cast("double")))
    value = lambda k, d: F.coalesce(sound(k), *([sound(fallbacks[k])] if fallbacks and k in fallbacks else []), F.lit(d)).cast("long").alias(k)
    return wide.select("owner_id", *[value(k, d) for k, d in defaults.items()])


def keyword_lists(rows: DataFrame, fallback: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each owner's keywords by type, in order of creation; an empty list takes the fallback."""
    order = lambda kind: F.transform(F.sort_array(F.collect_list(F.when((F.col("type") == kind) & (T.trim(F.col("keyword")) != ""), F.struct("created_at", T.trim(F.col("keyword")).alias("k"))))), lambda x: x["k"])
    wide = rows.groupBy("owner_id").agg(*[order(k).alias(k) for k in fallback])
    return wide.select("owner_id", *[F.when(F.size(k) > 0, F.col(k)).otherwise(F.array(*map(F.lit, d)).cast("array<string>")).alias(k) for k, d in fallback.items()])


def missing_seeds(seeds: DataFrame, keywords: DataFrame) -> DataFrame:
    """Seeds (type, keyword) that no keyword equals but for case and outer space."""
    key = lambda d: d.withColumn("_k", T.norm(F.col("keyword")))
    return key(seeds).join(key(keywords).select("type", "_k").distinct(), ["type", "_k"], "left_anti").drop("_k")


def resolve_owner(profiles: DataFrame, name: str) -> DataFrame:
    """(id, username) of the profile with that name; an error where there is none, or more than one."""
    wanted = name.strip().lstrip("@").lower()
    one = profiles.where(T.username(F.col("username")) == wanted).agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("username").alias("username"))
    # The check is a filter, so it holds whichever columns are read.
    checked = F.when((F.col("n") == 1) & F.col("id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(f" profiles are named {wanted}"))).cast("boolean"))
    return one.where(checked).select("id", "username")


def task_stats(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks with the number of results found for them, before duplicates go."""
    found = results.groupBy("task_id").agg(F.count("*").alias("_n"))
    return tasks.join(found.withColumnRenamed("task_id", "id"), "id", "left").withColumn("items_found", F.coalesce("_n", F.lit(0))).drop("_n")


def missing_token_items(cards: DataFrame, user: str) -> DataFrame:
    """The user's note cards without token, one for each note; trending cards come first, then the order of input."""
    rows = cards.where(F.col("owner_id") == user).withColumn("_n", U.note(F.col("source_url"))).where("_n.id IS NOT NULL AND _n.token = ''")
    return rows.groupBy(F.col("_n.id").alias("note_id")).agg(F.min_by("id", F.struct((~F.col("is_trending")).alias("t"), "seq")).alias("id"))


def parse_tokens(settings: DataFrame) -> DataFrame:
    """Rows of the token setting, a JSON list in one value; those without id or token go."""
    rows = settings.where("key = 'note_tokens'").select("owner_id", F.posexplode(F.from_json("value", TOKENS)).alias("pos", "t"))
    out = rows.select("owner_id", "pos", *[T.trim(F.col(f"t.{c}")).alias(n) for c, n in (("noteId", "note_id"), ("token", "token"), ("source", "source"), ("updatedAt", "updated_at"))])
    return out.where("note_id <> '' AND token <> ''")


def upsert_tokens(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for each note, the last written, newest first within the JSON that is stored: (owner_id, value)."""
    both = tokens.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = both.groupBy("owner_id", "note_id").agg(F.max_by(F.struct("token", "source", "updated_at"), F.struct("_new", "pos")).alias("t"))
    items = F.sort_array(F.collect_list(F.struct(F.col("t.updated_at").alias("u"), F.col("note_id"), F.struct(F.col("note_id").alias("noteId"), F.col("t.token").alias("token"), F.col("t.source").alias("source"), F.col("t.updated_at").alias("updatedAt")).alias("v"))), asc=False)
    return last.groupBy("owner_id").agg(F.to_json(F.transform(items, lambda x: x["v"])).alias("value"))


def apply_tokens(cards: DataFrame, tokens: DataFrame, user: str) -> DataFrame:
    """(id, source_url) of the user's note cards whose address changes with the tokens known for their notes."""
    known = tokens.groupBy("note_id").agg(F.max_by(F.struct("token", "source"), "pos").alias("k"))
    rows = cards.where(F.col("owner_id") == user).withColumn("note_id", U.note(F.col("source_url"))["id"]).where("note_id IS NOT NULL").join(known, "note_id")
    return rows.withColumn("_new", U.with_token(F.col("source_url"), F.col("k.token"), F.col("k.source"))).where("_new <> source_url").select("id", F.col("_new").alias("source_url"))


def result_summary(cards: DataFrame) -> DataFrame:
    """Candidates and how many have a fallback cover."""
    return cards.agg(F.count("*").alias("candidates"), F.count_if(U.is_fallback_cover(F.col("cover_image"))).alias("fallback_covers"))


def failure_counts(logs: DataFrame, message: Column) -> DataFrame:
    return logs.groupBy(T.failure_class(message).alias("failure")).agg(F.count("*").alias("n"))
