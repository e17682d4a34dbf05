"""Ranks within peer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_even
from ..scratch import held


#: Ranges that a group's distinct values are parted into, of about as many values each.
RANGES = 64


def _in_ranges(counts: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """``counts`` (by, _v, ...) with ``_r``, the range of the group's values that _v is in; ranges hold about as many distinct values each."""
    cuts = F.approx_percentile("_v", [k / ranges for k in range(1, ranges)])
    edges = counts.groupBy(*by).agg(F.array_distinct(cuts).alias("_edges"))
    placed = counts.join(edges, by) if by else counts.crossJoin(F.broadcast(edges))  # one row
    return placed.withColumn("_r", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")


def counted_below(counts: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """(by, _v, _c, _below, _all): how many rows of the group have a lower value, and how many there are, from (by, _v, _c), a row a value.

    Counts are added up within ranges and over ranges, so that no task sees more than a range of a group's values.
    """
    ranged = _in_ranges(counts, by, ranges)
    peers = Window.partitionBy(*(by or [F.lit(0)]))  # a row a range
    totals = ranged.groupBy(*by, "_r").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(peers.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_r", before.alias("_before"), F.sum("_n").over(peers).alias("_all"))
    inside = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return summed.join(totals, [*by, "_r"]).select(*by, "_v", "_c", (F.col("_before") + F.col("_inside")).alias("_below"), "_all")


def rank_share(df: DataFrame, value: str, by: list[str], out: str, ranges: int = RANGES) -> DataFrame:
    """Average rank over the number of measured values, in (0, 1], among the rows of a peer key or (no ``by``) among all; null for null values and null peer keys.

    Ties share the mean of their ranks. The input is run once, into a held table, and its rows are counted by distinct value; values are ranked in ranges, so groups may
    be of any size, and shares go back to the rows by value. Long tables carry the metric in the key.
    """
    known = F.col(value).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    once = held(df)
    counts = held(once.where(known).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    shares = counted_below(counts, by, ranges).select(*by, "_v", ((F.col("_below") + 1 + (F.col("_c") - 1) / 2) / F.col("_all")).alias("_share_of_peers"))
    return once.withColumn("_v", F.col(value).cast("double")).join(shares, [*by, "_v"], "left").withColumn(out, F.col("_share_of_peers")).drop("_v", "_share_of_peers")


def rank_share_of_all(df: DataFrame, value: str, out: str) -> DataFrame:
    """The rank share among all rows."""
    return rank_share(df, value, [], out)


def percentiles(df: DataFrame, value: str, by: list[str], out: str, lower_is_better: bool | Column = False) -> DataFrame:
    """100 * rank share, turned round before rounding where lower is better; one decimal."""
    ranked = rank_share(df, value, by, "_share")
    pct = F.col("_share") * 100
    flip = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    return ranked.withColumn(out, round_even(F.when(flip, 100 - pct).otherwise(pct), 1)).drop("_share")


def place_among(regulars: DataFrame, newcomers: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Where each newcomer would stand if it alone joined the regulars: (below + ties / 2 + 1) / (n + 1) * 100.

    Regulars are counted by value, newcomers' values count nothing, and both are ranked in ranges; so cost doesn't depend on how many
    newcomers meet how many regulars.
    """
    known = F.col("_v").isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    each = lambda rows, n: rows.select(*by, F.col(value).cast("double").alias("_v"), F.lit(n).alias("_c")).where(known)
    counts = held(each(regulars, 1).unionByName(each(newcomers, 0)).groupBy(*by, "_v").agg(F.sum("_c").alias("_c")))
    pct = (F.col("_below") + F.col("_c") / 2 + 1) / (F.col("_all") + 1) * 100
    places = counted_below(counts, by).select(*by, "_v", round_even(pct, 1).alias("_place"))
    return newcomers.withColumn("_v", F.col(value).cast("double")).join(places, [*by, "_v"], "left").withColumn(out, F.col("_place")).drop("_v", "_place")


def numbered(df: DataFrame, by: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``df`` with each row's place in its group (or among all), from 1, in ``order``; nulls go last, rows alike in all of it follow each other in any order.

    Rows are sorted in ranges of group and order, each numbered by itself and shifted by those before; a group may be of any size.
    """
    keys = [F.col(c) for c in by] + [(c if isinstance(c, Column) else F.col(c).asc_nulls_last()) for c in order]
    once = held(df.withColumn("_tie", F.monotonically_increasing_id()))  # so that rows alike in all of the order spread as well
    placed = held(once.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    whole = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    whole = whole.withColumn("_nth", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")
    if not by:
        return whole.withColumn(out, F.col("_nth")).drop("_nth")
    first = whole.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_nth").alias("_first"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return whole.join(first, same).withColumn(out, F.col("_nth") - F.col("_first") + 1).select(*df.columns, out)


def medians(df: DataFrame, by: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """(by, out): exact medians of whole numbers from 0. Rows are counted in cells of values, then by value in the one or two cells that the middle is in. ``df`` is read twice."""
    cell = F.floor(F.col(value) / width).alias("_cell")
    peers = Window.partitionBy(by)  # a row a cell
    before = lambda order: F.sum("_n").over(peers.orderBy(order)) - F.col("_n")
    cells = df.groupBy(by, cell).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(peers)).withColumn("_before", before("_cell"))
    ends = F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))
    holds = F.exists("_ends", lambda e: (e >= F.col("_before")) & (e < F.col("_before") + F.col("_n")))
    middle = cells.withColumn("_ends", ends).where(holds).select(by, "_cell", "_ends", F.min("_before").over(peers).alias("_first"))
    inside = df.withColumn("_cell", cell).join(F.broadcast(middle), [by, "_cell"]).groupBy(by, value, "_ends", "_first").agg(F.count("*").alias("_n"))  # two rows a group
    placed = inside.withColumn("_before", F.col("_first") + before(value))
    hits = F.size(F.filter("_ends", lambda e: (e >= F.col("_before")) & (e < F.col("_before") + F.col("_n"))))
    return placed.groupBy(by).agg((F.sum(F.col(value) * hits) / 2).alias(out))


def deciles(share: Column) -> Column:
    """1 to 10 from a rank share."""
    return (F.floor(F.least(share * 10, F.lit(9.999))) + 1).cast("int")


def quintiles(df: DataFrame, value: str, order: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Five bands of first-come ranks cut at linearly interpolated edges; not ntile, which differs unless 5 divides n. A row alone has none."""
    by = by or []
    placed = numbered(df, by, [value, *order], "_place")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_size"))
    met = placed.join(sizes, by) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    band = F.greatest(F.lit(1), F.ceil(5.0 * (F.col("_place") - 1) / F.nullif(F.col("_size") - 1, F.lit(0)))).cast("int")
    return met.withColumn(out, F.when(F.col("_size") > 1, band)).drop("_place", "_size")


def robust_z(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """(x - median) / (1.4826 * median absolute deviation) within groups; 0 where that deviation is 0."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_median"))
    near = df.join(middle, by)
    spread = near.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_median"))).alias("_mad"))
    scale = F.col("_mad") * 1.4826
    z = F.when(scale == 0, 0.0).otherwise((F.col(value) - F.col("_median")) / F.nullif(scale, F.lit(0.0)))
    return near.join(spread, by).withColumn(out, F.when(F.col(value).isNotNull(), z)).drop("_median", "_mad")


def fold_thin_groups(df: DataFrame, group: str, parents: dict[str, str], least: int = 40) -> DataFrame:
    """Groups of under ``least`` rows join their parent, in the order of ``parents``."""
    # Sizes as they are once earlier groups have been folded, from one count of the groups concerned.
    sizes = df.agg(*[F.count_if(F.col(group) == g).alias(g) for g in dict.fromkeys([*parents, *parents.values()])])
    folded, size = {}, {g: F.col(f"_size.{g}") for g in dict.fromkeys([*parents, *parents.values()])}
    for child, parent in parents.items():
        folded[child] = size[child] < least
        size[parent] = size[parent] + F.when(folded[child], size[child]).otherwise(0)
    to = F.col(group)
    for child, parent in parents.items():
        to = F.when((to == child) & folded[child], F.lit(parent)).otherwise(to)
    marked = df.crossJoin(F.broadcast(sizes.select(F.struct(*sizes.columns).alias("_size"))))  # one row
    return marked.withColumn(group, to).drop("_size")


def best_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in a full order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")


def season_index(df: DataFrame, season: str = "season", out: str = "season_index") -> DataFrame:
    """Place of each season among those present, from 1; seasons are few, so the table of them is broadcast."""
    order = df.select(season).distinct().where(F.col(season).isNotNull())
    order = order.withColumn(out, F.row_number().over(Window.orderBy(season)))
    return df.join(F.broadcast(order), season, "left")


def carried(df: DataFrame, column: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """The last known value, else the next known one."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(back, ahead))
