"""Incremental refresh of keepers' seasons: a queue of what is missing, a budget, and commits that can be repeated.

Finished seasons are worked on once; the season being played is worked on at every run. What was done is in the table itself, which seasons are complete in a state
table beside it, so a run that is stopped (or breaks off) is carried on by the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import start_year
from ..operators import assembly, joins
from ..operators.ranking import numbered
from ..scratch import held
from .files import exists

KEEPER_SCHEMA = "player_id string, season string, full_matches long, full_xga double, full_conceded double, full_clean_sheets double"


def keeper_table(spark: SparkSession, path: str) -> DataFrame:
    """(player_id, season, ...) as committed so far."""
    return spark.read.schema(KEEPER_SCHEMA).parquet(f"{path}/keepers") if exists(spark, f"{path}/keepers") else spark.createDataFrame([], KEEPER_SCHEMA)


def complete_seasons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("season string").parquet(f"{path}/complete") if exists(spark, f"{path}/complete") else spark.createDataFrame([], "season string")


def queue(listed: DataFrame, have: DataFrame, complete: DataFrame, current: str) -> DataFrame:
    """(player_id, place): keepers to work on; those of the season being played first, then those of the newest finished seasons that are missing.

    ``listed``: player_id, season. A keeper is due if he is listed in the season being played, or in an incomplete one for which the table has no row of his.
    """
    open_seasons = listed.select("player_id", "season").distinct().join(complete.where(F.col("season") != current), "season", "left_anti")
    marked = open_seasons.join(have.select("player_id", "season").withColumn("_has", F.lit(True)), ["player_id", "season"], "left")
    per = marked.groupBy("player_id").agg(
        F.max(F.col("season") == current).alias("now"), F.count_if(F.col("_has").isNull()).alias("missing"), F.array_sort(F.collect_list(-start_year(F.col("season")))).alias("newest")
    )  # a keeper's seasons
    due = per.where("now OR missing > 0")
    return numbered(due, [], [F.col("now").desc(), F.col("newest").asc(), F.col("player_id").asc()], "place").select("player_id", "place")


def commit(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of those of the same keeper and season; only the seasons concerned are rewritten. Committing the same rows again changes nothing."""
    spark = rows.sparkSession
    old = keeper_table(spark, path).join(rows.select("season").distinct(), "season", "left_semi")
    merged = held(joins.replacing_union(old, rows, ["player_id", "season"]).select(*[f.name for f in keeper_table(spark, path).schema]))
    merged.repartition("season").sortWithinPartitions("season", "player_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(f"{path}/keepers")


def refresh_keepers(
    listed: DataFrame, matches: DataFrame, played: DataFrame, path: str, current: str, *, batch: int = 10_000, budget: float = 900.0, clock: Callable[[], float] = time.monotonic
) -> dict[str, int | bool]:
    """Work through the queue in batches until it is empty or ``budget`` seconds are spent; {queued, done, committed, finished}.

    ``listed``: player_id, season; ``matches`` and ``played`` as in ``assembly.keeper_rows``. Each batch is committed by itself.
    """
    spark, until = listed.sparkSession, clock() + budget
    due = held(queue(listed, keeper_table(spark, path), complete_seasons(spark, path), current))
    queued, done, committed = due.count(), 0, 0
    while done < queued and clock() < until:
        mine = listed.join(due.where(F.col("place").between(done + 1, done + batch)).select("player_id"), "player_id", "left_semi")
        rows = held(assembly.keeper_rows(matches, played.join(mine.select("player_id").distinct(), "player_id", "left_semi"), mine))
        commit(rows, path)
        done = min(queued, done + batch)
        committed += rows.count()
    have = keeper_table(spark, path)
    lacking = listed.select("player_id", "season").distinct().join(have.select("player_id", "season"), ["player_id", "season"], "left_anti").select("season").distinct()
    ready = listed.where(F.col("season") != current).select("season").distinct().join(lacking, "season", "left_anti")
    held(complete_seasons(spark, path).union(ready).distinct()).coalesce(1).write.mode("overwrite").parquet(f"{path}/complete")  # a row a season
    return {"queued": queued, "done": done, "committed": committed, "finished": done == queued}
