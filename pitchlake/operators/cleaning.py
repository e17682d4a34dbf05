"""Cleaning with an audit: rows are dropped or repaired by fixed rules, gaps are filled only where a season is well covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import measured, true
from ..registry import metrics as M
from .ranking import best_of, robust_z


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: measured(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def valid_minutes(minutes: Column) -> Column:
    return true((minutes > 0) & (minutes <= M.BOUNDS.max_minutes))


def no_negatives(stats: list[str]) -> Column:
    return ~F.exists(F.array(*[F.col(s).cast("double") for s in stats]), lambda v: true(v < 0))


def consistent(df: DataFrame, pairs: tuple[tuple[str, str], ...] = M.CONSISTENT) -> DataFrame:
    """No more successes than attempts, pair by pair in their order."""
    for success, attempts in pairs:
        if {success, attempts} <= set(df.columns):
            df = df.withColumn(success, F.when(F.col(success) > F.col(attempts), F.col(attempts)).otherwise(F.col(success)))
    return df


def coverage(df: DataFrame, stats: list[str], by: str = "season") -> DataFrame:
    """Share of rows that measure each stat, by season; one pass for all stats."""
    return df.groupBy(by).agg(*[F.avg(F.col(s).isNotNull().cast("double")).alias(s) for s in stats])


def impute(df: DataFrame, stat: str, group: str = "position_group", season: str = "season") -> DataFrame:
    """Fill gaps of seasons that measure a stat for 90 % of rows: with the group's median per 90 over such seasons, times exposure."""
    exposure = F.col("minutes") / 90.0
    share = coverage(df, [stat], season).select(season, (F.col(stat) >= M.BOUNDS.coverage).alias("_reliable"))
    marked = df.join(F.broadcast(share), season, "left")
    middle = marked.where("_reliable").groupBy(group).agg(F.coalesce(F.median(F.col(stat) / F.nullif(exposure, F.lit(0.0))), F.lit(0.0)).alias("_typical"))
    filled = F.when(F.col(stat).isNull() & F.col("_reliable"), F.coalesce("_typical", F.lit(0.0)) * exposure).otherwise(F.col(stat))
    return marked.join(F.broadcast(middle), group, "left").withColumn(stat, filled).drop("_reliable", "_typical")


def zero_fill(df: DataFrame, stats: list[str], season: str = "season") -> DataFrame:
    """A gap means none happened only in seasons that measure the stat for 90 % of rows."""
    share = coverage(df, stats, season).select(season, *[(F.col(s) >= M.BOUNDS.coverage).alias(f"_{s}") for s in stats])
    marked = df.join(F.broadcast(share), season, "left")
    return marked.withColumns({s: F.when(F.col(f"_{s}"), F.coalesce(F.col(s), F.lit(0.0))).otherwise(F.col(s)) for s in stats}).drop(*[f"_{s}" for s in stats])


def clean_players(df: DataFrame, stats: list[str], tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit). In order: exact copies, copies of a key (most minutes stay), minutes, negatives, implausible bodies,
    inconsistent pairs, gaps, keeper stats of outfield players.

    The audit has a row for each step and how many rows or values it touched.
    """
    distinct = nan_to_null(df).dropDuplicates()
    keyed = best_of(distinct, ["player_id", "season"], [F.desc("minutes"), *tie])
    timed = keyed.where(valid_minutes(F.col("minutes")))
    positive = timed.where(no_negatives(stats))
    bodies = {"height_cm": M.BOUNDS.height, "age": M.BOUNDS.age}
    here = {c: b for c, b in bodies.items() if c in df.columns}
    sane = positive.withColumns({c: F.when(F.col(c).between(*b), F.col(c)) for c, b in here.items()})
    fixed = consistent(sane)
    optional = [s for s in M.OPTIONAL if s in df.columns]
    filled = fixed
    for stat in optional:
        filled = impute(filled, stat)
    filled = zero_fill(filled, [s for s in stats if s not in optional and not s.startswith("gk_")])
    if "position_group" in df.columns:
        filled = filled.withColumns({s: F.when(F.col("position_group") == "GK", F.col(s)) for s in stats if s.startswith("gk_")})
    counts = [("rows in", df), ("distinct rows", distinct), ("one row a key", keyed), ("valid minutes", timed), ("no negatives", positive)]
    audit = None
    for k, (step, frame) in enumerate(counts):
        row = frame.agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), F.lit(step).alias("what"), "n")
        audit = row if audit is None else audit.union(row)
    for k, (c, b) in enumerate(here.items(), len(counts)):
        audit = audit.union(positive.agg(F.count(F.when(~F.col(c).between(*b), 1)).alias("n")).select(F.lit(k).alias("step"), F.lit(f"{c} withdrawn").alias("what"), "n"))
    return filled, audit


def flag_outliers(df: DataFrame, columns: list[str], by: list[str], threshold: float = M.BOUNDS.outlier) -> DataFrame:
    """outlier_metrics (how many robust z-scores are beyond the threshold), largest_z, is_outlier."""
    for c in columns:
        df = robust_z(df, c, by, f"_z_{c}")
    z = F.array(*[F.abs(F.col(f"_z_{c}")) for c in columns])
    return df.withColumns(
        {"outlier_metrics": F.size(F.filter(z, lambda v: v > threshold)), "largest_z": F.array_max(z), "is_outlier": F.exists(z, lambda v: true(v > threshold))}
    ).drop(*[f"_z_{c}" for c in columns])


def flanks(df: DataFrame, position: str = "position", group: str = "position_group", foot: str = "foot") -> DataFrame:
    """flank, and for wide players whether the foot is natural or inverted there."""
    table = F.create_map(*[F.lit(x) for kv in M.FLANKS.items() for x in kv])
    flank = F.when(F.col(position).isin(*M.UNKNOWN_FLANK), F.lit(None)).otherwise(F.coalesce(table[F.col(position)], F.lit("Central")))
    sided = df.withColumn("flank", F.when(F.col(position).isNotNull(), flank))
    wide = F.col(group).isin(*M.WIDE_GROUPS) & F.col("flank").isin("Left", "Right") & F.lower(foot).isin("left", "right")
    return sided.withColumn("footed_side", F.when(wide, F.when(F.lower(foot) == F.lower("flank"), "Natural").otherwise("Inverted")))
