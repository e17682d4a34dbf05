"""Writing tables, payloads and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import replacing_union


def seasons(df: DataFrame, path: str, season: str = "season") -> None:
    """One folder a season, files in a stable order inside."""
    df.repartition(season).sortWithinPartitions(*[c for c in ("league", "team", "player", "player_id") if c in df.columns]).write.mode("overwrite").partitionBy(season).parquet(path)


def payloads(df: DataFrame, path: str, season: str = "season") -> None:
    """One JSON document a row, in a folder a season."""
    df.write.mode("overwrite").partitionBy(season).json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return replacing_union(old, new, keys)


def without_empty(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Without metrics that no row has a value of; one pass over the table decides."""
    counts = df.agg(*[F.count(m).alias(m) for m in metrics]).first()
    return df.drop(*[m for m in metrics if not counts[m]])
