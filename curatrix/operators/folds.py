"""Folds over groups of any size: running values that are handed from partition to partition, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store

_KINDS: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}


def running(rows: DataFrame, key: str, order: Sequence[str], values: dict[str, tuple[Column, str]], inclusive: bool = True) -> DataFrame:
    """rows with running sums or maxima by key (not null) in order: name -> (value, 'sum' or 'max'), of the rows up to each row,
    or before it. A value that is null adds nothing; without any there is 0 for sums and null for maxima.

    Rows lie in range partitions, which cut a key of any size into segments; what a key's earlier segments hold comes from a
    table of a row for each segment. Of keys that run over a border, a border has one at most, so they are broadcast.
    """
    named = rows.withColumns({f"_v_{n}": c for n, (c, _) in values.items()})
    laid = store.saved(named.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "segments")
    segments = laid.groupBy("_part", key).agg(*[_KINDS[k][0](f"_v_{n}").alias(f"_s_{n}") for n, (_, k) in values.items()])
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    held = segments.select("_part", key, F.count("*").over(before).alias("_n"), *[_KINDS[k][0](f"_s_{n}").over(before).alias(f"_h_{n}") for n, (_, k) in values.items()]).where("_n > 0").drop("_n")
    own = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    made = {}
    for n, (_, k) in values.items():
        mine, earlier = _KINDS[k][0](f"_v_{n}").over(own), F.col(f"_h_{n}")
        made[n] = F.greatest(mine, earlier) if k == "max" else F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
    return laid.join(F.broadcast(held), ["_part", key], "left").withColumns(made).drop("_part", *[f"_{p}_{n}" for n in values for p in "vh"])


def parts(lines: DataFrame, key: str, order: Sequence[str], text: str, limit: int) -> DataFrame:
    """(key, part, text): the lines of each key, joined by line feeds, in parts of at most `limit` characters, numbered from 1.

    The parts of a key in order, joined by nothing, are the whole. A line longer than half the limit is cut; no task holds more
    than a part of a key, whatever its size.
    """
    half = max(1, limit // 2)
    numbered = running(lines, key, order, {"_line": (F.lit(1), "sum")})
    whole = F.when(F.col("_line") > 1, F.concat(F.lit("\n"), F.col(text))).otherwise(F.col(text))
    cut = numbered.withColumn("_whole", whole).select(key, "_line", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("_whole") / half) - 1, F.lit(0)).cast("int")), lambda i: F.substr("_whole", i * half + 1, F.lit(half)))).alias("_piece", "_text"))
    placed = running(cut.where("_text <> ''"), key, ["_line", "_piece"], {"_before": (F.length("_text"), "sum")}, inclusive=False)
    # A piece belongs where it begins: those that begin within half the limit end within the limit.
    some = placed.groupBy(key, (F.floor(F.col("_before") / half) + 1).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("_line", "_piece", "_text"))).alias("_all"))
    return some.select(key, "part", F.array_join(F.transform("_all", lambda x: x["_text"]), "").alias("text"))
