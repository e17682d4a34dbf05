"""Groupings of the analysis; ties always have an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_even, weighted_mean


def collapse_transfers(df: DataFrame, key: list[str], counts: list[str], means: list[str], labels: list[str], club: str = "team") -> DataFrame:
    """One row a player-season: counts add up only if each club's row has them, means are weighted by minutes, labels come from
    the club of most minutes (ties: first by name)."""
    largest = F.struct(-F.col("minutes"), F.col(club))
    return df.groupBy(*key).agg(
        F.min_by(club, largest).alias(club),
        *[F.min_by(c, largest).alias(c) for c in labels],
        F.sum("minutes").alias("minutes"),
        F.countDistinct(club).alias("clubs_in_season"),
        *[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in counts],
        *[weighted_mean(F.col(c), F.col("minutes")).alias(c) for c in means],
    )


def main_value(df: DataFrame, key: list[str], value: str, weight: str, out: str) -> DataFrame:
    """The value with the largest total weight of each key; ties by value."""
    per = df.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    return per.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias(out))


def merged_map(df: DataFrame, key: list[str], column: str, out: str) -> DataFrame:
    """Maps of a key added up entry by entry."""
    each = df.select(*key, F.explode(column).alias("_k", "_v")).groupBy(*key, "_k").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(out))


def packed_counts(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """'value:count|value:count', most frequent first, ties by value."""
    per = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))))
    return per.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda e: F.concat(e["v"], F.lit(":"), (-e["n"]).cast("string"))), "|").alias(out))


def most_frequent(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """value, n and share of the most frequent value of each key; ties by value."""
    per = df.groupBy(*key, value).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))
    first = F.struct(-F.col("n"), F.col(value))
    return per.groupBy(*key).agg(F.min_by(value, first).alias(value), F.max("n").alias("n"), F.max("share").alias("share"))


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, share): how often each value occurs in each group; nulls are a value."""
    per = df.groupBy(group, value).agg(F.count("*").alias("n"))
    whole = per.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("_n"))
    return per.join(whole, F.col(group).eqNullSafe(F.col("_g"))).select(group, value, "n", (F.col("n") / F.col("_n")).alias("share"))


def drop_stale_seasons(block: DataFrame, reference: DataFrame, key: list[str], minutes: str, season: str, least: float = 0.95) -> DataFrame:
    """Without seasons whose minutes, over rows that both tables have, are under 95 % of the reference's."""
    both = block.select(*key, F.col(minutes).alias("_mine")).join(reference.select(*key, F.col(minutes).alias("_all")), key)
    return drop_stale(block, both, "_mine", "_all", season, least)


def drop_stale(block: DataFrame, both: DataFrame, mine: str, whole: str, season: str, least: float = 0.95) -> DataFrame:
    """``drop_stale_seasons`` where rows already have both tables' minutes side by side, so that nothing is joined but a row a season."""
    stale = both.groupBy(season).agg((F.sum(mine) / F.sum(whole)).alias("_r")).where(F.col("_r") < least).select(season)
    return block.join(F.broadcast(stale), season, "left_anti")


#: Rows of a part of ``dealt``.
PART_ROWS = 1 << 18


def dealt(df: DataFrame, key: list[str], rows: int = PART_ROWS) -> DataFrame:
    """``df`` by key in parts of about so many rows, so that a grouping of nearly as many keys as rows takes as much memory a task at any size.

    Counts the rows first. For keys of few rows each.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *key)


def defensive_bar(df: DataFrame, key: list[str], actions: str, bars: dict[str, int], position: str = "position") -> DataFrame:
    """Matches that reach their position's bar of defensive actions, in number and percent; only where any action was recorded."""
    bar = F.create_map(*[F.lit(x) for kv in bars.items() for x in kv])[F.col(position)]
    played = df.where((F.col("minutes") > 0) & bar.isNotNull())
    per = played.groupBy(*key).agg(F.sum(F.when(F.col(actions) >= bar, 1).otherwise(0)).alias("dc_hits"), F.count("*").alias("dc_matches"), F.sum(actions).alias("_any"))
    return per.where("_any > 0").withColumn("dc_bar_pct", round_even(100.0 * F.col("dc_hits") / F.col("dc_matches"), 2)).drop("_any")
