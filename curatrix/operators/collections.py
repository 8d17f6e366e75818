"""Collections: counts, display, clean-up and membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store
from .cards import empty


def collection_counts(cards: DataFrame) -> DataFrame:
    """Library cards in each collection; a card counts once in one. Distinct within the row, then combined before the shuffle."""
    return cards.where(~F.col("is_trending")).select(F.explode(T.distinct_texts(F.col("collections"))).alias("collection_id")).groupBy("collection_id").agg(F.count("*").alias("n_cards"))


def with_counts(collections: DataFrame, live: DataFrame, previous: DataFrame) -> DataFrame:
    """item_count from the live counts, else the previous, else its own; negative ones count 0."""
    sound = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    l, p = (x.select(F.col("collection_id").alias("id"), F.col("n_cards").alias(n)) for x, n in ((live, "_live"), (previous, "_previous")))
    return collections.join(l, "id", "left").join(p, "id", "left").withColumn("item_count", sound(F.coalesce("_live", "_previous", "item_count")).cast("long")).drop("_live", "_previous")


def cleanup_collections(cards: DataFrame, collections: DataFrame) -> DataFrame:
    """(id, canonical) of collections that share a name: the one with most references, then the oldest, stays."""
    used = cards.select(F.explode("collections").alias("id")).groupBy("id").agg(F.count("*").alias("refs"))
    rows = collections.withColumn("_name", T.norm(F.col("name"))).join(used, "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    best = rows.groupBy("_name").agg(F.min_by("id", F.struct((-F.col("refs")).alias("r"), "created_at", "id")).alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return rows.join(best, "_name").where("id <> canonical").select("id", "canonical")


def relink(cards: DataFrame, aliases: DataFrame, keep_unmapped: bool = True) -> DataFrame:
    """Cards with collection ids replaced by (id -> canonical); each id once, in order; unmapped ids stay or go."""
    rows = cards.select("id", F.posexplode("collections").alias("pos", "c")).join(aliases.select(F.col("id").alias("c"), "canonical"), "c", "left")
    to = F.coalesce("canonical", "c") if keep_unmapped else F.col("canonical")
    new = rows.withColumn("to", to).where("to IS NOT NULL").groupBy("id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"])).alias("_new"))
    return cards.join(new, "id", "left").withColumn("_was", F.col("collections")).withColumn("collections", F.coalesce("_new", empty())).withColumn("changed", ~F.col("_was").eqNullSafe(F.col("collections"))).drop("_new", "_was")


def display_collections(collections: DataFrame) -> DataFrame:
    """One row for each owner, name and cover: counts add up, all ids are listed, the oldest is shown."""
    owner = F.coalesce("owner_id", F.lit("public")).alias("owner")
    order = F.struct("created_at", "id")
    return collections.groupBy(owner, T.norm(F.col("name")).alias("key"), F.coalesce("cover_image", F.lit("")).alias("cover")).agg(
        F.min_by("id", order).alias("id"), F.sum("item_count").alias("item_count"), F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["id"]), ",").alias("ids"))


def membership_deltas(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed) ids of a card's membership."""
    return F.array_except(after, before), F.array_except(before, after)


def without_aliases(collections: Column, aliases: Sequence[str]) -> Column:
    gone = F.array(*map(F.lit, aliases)).cast("array<string>")
    return F.filter(collections, lambda c: ~F.array_contains(gone, c))


def bulk_add(cards: DataFrame, ids: DataFrame, collection: str, owner: str) -> DataFrame:
    """Adds the chosen cards of the owner to a collection, where they aren't in it yet."""
    rows = cards.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    add = F.coalesce("_chosen", F.lit(False)) & (F.col("owner_id") == owner) & ~F.array_contains("collections", collection)
    return rows.withColumn("collections", F.when(F.coalesce(add, F.lit(False)), F.array_append("collections", F.lit(collection))).otherwise(F.col("collections"))).drop("_chosen")


def bulk_remove(cards: DataFrame, ids: DataFrame, aliases: Sequence[str], owner: str) -> DataFrame:
    rows = cards.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    drop = F.coalesce("_chosen", F.lit(False)) & (F.col("owner_id") == owner)
    return rows.withColumn("collections", F.when(F.coalesce(drop, F.lit(False)), without_aliases(F.col("collections"), aliases)).otherwise(F.col("collections"))).drop("_chosen")


def scope_totals(cards: DataFrame) -> DataFrame:
    """Cards in each collection, and in all ('all')."""
    each = cards.select(F.explode(F.concat(F.array(F.lit("all")), T.distinct_texts(F.col("collections")))).alias("scope"))
    return each.groupBy("scope").agg(F.count("*").alias("n_cards"))


def ranked_within(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def listed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df with `rank`, each row's place in the whole list, from 1. order must tell all rows apart.

    Sorted by range; a place is the place in its partition and how many rows the partitions before have, so no task holds more
    than a partition of the list.
    """
    laid = store.saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "listed")
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return laid.join(F.broadcast(before), "_part").withColumn("rank", own + F.col("_before")).drop("_part", "_before")
