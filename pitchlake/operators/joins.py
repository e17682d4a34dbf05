"""Joins that SQL text has no word for, and record linkage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import club_tokens, initial_and_surname, normalise_name, words
from ..scratch import held


def as_of(probes: DataFrame, history: DataFrame, key: str, at: str, date: str, value: str, out: str, tolerance_days: int = 548) -> DataFrame:
    """The last value of ``history`` on or before each probe's date, if it is recent enough; else null.

    Probes and history go through one sort per key (no pair of rows is ever formed, so a key with a long history costs its length).
    Of values on one date the largest counts. Null keys and dates give null.
    """
    past = history.where(F.col(date).isNotNull()).select(F.col(key), F.to_date(date).alias("_at"), F.lit(0).alias("_probe"), F.struct(F.to_date(date).alias("d"), F.col(value).alias("v")).alias("_known"))
    asked = probes.withColumn("_at", F.to_date(at)).withColumn("_probe", F.lit(1))
    w = Window.partitionBy(key).orderBy("_at", "_probe", "_known").rowsBetween(Window.unboundedPreceding, 0)
    both = past.unionByName(asked, allowMissingColumns=True).withColumn("_last", F.last("_known", ignorenulls=True).over(w))
    fresh = F.col(key).isNotNull() & F.col("_at").isNotNull() & (F.date_diff("_at", F.col("_last.d")) <= tolerance_days)
    return both.where("_probe = 1").withColumn(out, F.when(fresh, F.col("_last.v"))).select(*probes.columns, out)


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, cell: float, pick: Column | None = None, row: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with the right row whose [start, end) holds ``at``; with ``pick``, only the first such by it, one for each ``row`` (its key).

    Both meet in cells of that width (about an interval's length), so an interval costs the cells it spans and a key's rows are never all in one place.
    """
    right_columns = [c for c in right.columns if c not in keys]
    spread = right.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    met = left.withColumn("_cell", F.floor(F.col(at) / cell)).join(spread, [*keys, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
    if pick is None:
        return met
    rest = [c for c in met.columns if c not in row]
    return met.groupBy(*row).agg(F.min_by(F.struct(*rest), pick).alias("_r")).select(*row, "_r.*").select(*left.columns, *right_columns)


def first_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, order: list[str]) -> DataFrame:
    """Rows of ``left`` with the first right row that starts after ``at``, by start and ``order``, and its ``_start``; null if there is none.

    Both go through one sort by key, so no pair of rows is formed.
    """
    rest = [c for c in right.columns if c not in (*keys, start)]
    known = right.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_asked"), F.struct(F.col(start).alias("_start"), *order, *[c for c in rest if c not in order]).alias("_found"))
    asked = left.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_asked"), F.struct(*left.columns).alias("_row"))
    # Backwards in time; of one moment those asked for come first, as what starts then doesn't start after it.
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_asked", F.desc("_found")).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_next", F.last("_found", ignorenulls=True).over(w)).where("_asked = 0")
    return both.select("_row.*", "_next._start", *[F.col(f"_next.{c}").alias(c) for c in rest])


def pairs_by_set(rows: DataFrame, key: str, of: list[str], linked: Callable[[DataFrame], DataFrame], size: int = 1024) -> DataFrame:
    """(a, b, same): the keys of all rows whose sets are linked, and whether both have the same one. Rows that agree in ``of`` are one set; nulls there are in none.

    ``linked`` makes (x, y) from the different sets (set, of), so rows alike are compared once. Pairs are then written from lists of up to about ``size`` keys.
    """
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in of)).select(key, F.struct(*of).alias("set"))
    counts = known.groupBy("set").agg(F.count("*").alias("_n"))
    lists = known.join(counts, "set").groupBy("set", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / size)).alias("_part")).agg(F.collect_list(key).alias("_keys")).drop("_part")
    links = linked(counts.select("set", "set.*"))
    met = links.join(lists.withColumnsRenamed({"set": "x", "_keys": "_as"}), "x").join(lists.withColumnsRenamed({"set": "y", "_keys": "_bs"}), "y")
    # Lists are small beside the pairs that they make, so tasks are dealt by number, not by bytes.
    each = met.select((F.col("x") == F.col("y")).alias("same"), "_as", "_bs").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return each.select("same", F.explode("_as").alias("a"), "_bs").select("a", F.explode("_bs").alias("b"), "same")


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").select(*keys)
    return df.join(once, keys, "left_semi")


def unique_both_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return unique_on(left, keys).join(unique_on(right, keys), keys)


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "full_outer")


def replacing_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``new``, and of ``old`` what has no key there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_eras(archive: DataFrame, release: DataFrame, renamed: dict[str, str], season: str, cutover: int) -> DataFrame:
    """Seasons before the cutover from the archive, later ones from the release; columns renamed there come under their old name."""
    both = archive.where(F.col(season) < cutover).unionByName(release.where(F.col(season) >= cutover), allowMissingColumns=True)
    for old, new in renamed.items():
        if old in both.columns and new in both.columns:
            both = both.withColumn(old, F.coalesce(old, new)).drop(new)
        elif new in both.columns:
            both = both.withColumnRenamed(new, old)
    return both


def nearest_minutes(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(player_id, season, mins, tm_id, tm_mins, gap): of those who share the keys, the nearest by minutes on either side, of several as near the first id; where minutes are unknown, the first id.

    Both go through two sorts by the keys, so no pair of rows is formed.
    """
    known = theirs.where("tm_mins IS NOT NULL").groupBy(*keys, F.col("tm_mins").alias("_at")).agg(F.min("tm_id").alias("tm_id"))
    known = known.select(*keys, "_at", F.lit(0).alias("_asked"), F.struct(F.col("_at").alias("tm_mins"), "tm_id").alias("_them"))
    asked = ours.where("mins IS NOT NULL").select("player_id", "season", "mins", *[k for k in keys if k != "season"], F.col("mins").alias("_at"), F.lit(1).alias("_asked"))
    both = known.unionByName(asked, allowMissingColumns=True)
    side = lambda at: F.last("_them", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_asked").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_below", side(F.asc("_at"))).withColumn("_above", side(F.desc("_at"))).where("_asked = 1")
    near = near.select("player_id", "season", "mins", F.explode(F.array("_below", "_above")).alias("_t")).where("_t IS NOT NULL").select("player_id", "season", "mins", "_t.tm_id", "_t.tm_mins")
    firsts = theirs.groupBy(*keys).agg(F.min("tm_id").alias("_any"), F.min(F.when(F.col("tm_mins").isNull(), F.col("tm_id"))).alias("_unknown"))
    blank = ours.join(firsts, keys).select("player_id", "season", "mins", F.when(F.col("mins").isNull(), F.col("_any")).otherwise(F.col("_unknown")).alias("tm_id"), F.lit(None).cast(theirs.schema["tm_mins"].dataType).alias("tm_mins"))
    return near.unionByName(blank.where("tm_id IS NOT NULL")).withColumn("gap", F.abs(F.col("mins") - F.col("tm_mins")))


def link_players(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(player_id, tm_id): players of two sources that are the same.

    ours: player_id, player, season, league, team, minutes. theirs: tm_id, name, season, league, club, minutes.
    Candidates are exact names, then initial and surname at the same club, then, for players left over, a shared word of four
    letters at the same club with minutes within 15 % of the larger (at least 600). All are blocked by league and season. A
    player's link is the candidate with most agreeing seasons, then most exact names; ties and ids that two players claim are dropped.
    """
    a = ours.select("player_id", "season", "league", normalise_name(F.col("player")).alias("key"), words(F.col("player")).alias("words"), club_tokens(F.col("team")).alias("clubs"), F.col("minutes").alias("mins"))
    b = theirs.select("tm_id", "season", "league", normalise_name(F.col("name")).alias("tm_key"), words(F.col("name")).alias("tm_words"), club_tokens(F.col("club")).alias("tm_clubs"), F.col("minutes").alias("tm_mins"))
    a, b = held(a.withColumn("short", initial_and_surname(F.col("key")))), held(b.withColumn("tm_short", initial_and_surname(F.col("tm_key"))))
    same_club = F.arrays_overlap("clubs", "tm_clubs")
    gap = F.abs(F.col("mins") - F.col("tm_mins"))
    place = (a["season"] == b["season"]) & (a["league"] == b["league"])
    first = lambda df: df.groupBy("player_id", "season").agg(F.min_by("tm_id", F.struct(F.col("gap").isNull(), "gap", "tm_id")).alias("tm_id"))
    met = a.join(b, place & (a["key"] == b["tm_key"])).select("player_id", a["season"], "tm_id", same_club.alias("same_club"), gap.alias("gap"))
    order = F.struct(F.when(F.col("same_club"), 0).when(~F.col("same_club"), 1).otherwise(2), F.col("gap").isNull(), "gap", "tm_id")
    exact = held(met.groupBy("player_id", "season").agg(F.min_by("tm_id", order).alias("tm_id")))
    # The others share a club's word; of those who share all that is asked, only the nearest by minutes can come first.
    club = lambda df, clubs: df.withColumn("club", F.explode(clubs))
    others = club(b, "tm_clubs")
    unlinked = lambda df, found: df.join(found.select("player_id", "season"), ["player_id", "season"], "left_anti")
    keys = ["season", "league", "short", "club"]
    short = first(nearest_minutes(club(unlinked(a, exact), "clubs"), others.withColumnRenamed("tm_short", "short"), keys))
    best = held(exact.withColumn("exact", F.lit(1)).union(short.withColumn("exact", F.lit(0))))
    long_words = lambda ws: F.explode(F.filter(ws, lambda w: F.length(w) >= 4))
    keys = ["season", "league", "word", "club"]
    loose = nearest_minutes(club(unlinked(a, best), "clubs").withColumn("word", long_words("words")), others.withColumn("word", long_words("tm_words")), keys)
    loose = first(loose.where(F.col("gap") <= 0.15 * F.greatest("mins", "tm_mins", F.lit(600.0))))
    best = best.union(loose.withColumn("exact", F.lit(0)))
    votes = best.groupBy("player_id", "tm_id").agg(F.count("*").alias("votes"), F.sum("exact").alias("exact"))
    ranked = votes.withColumn("_r", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("votes"), F.desc("exact"), "tm_id"))).withColumn(
        "_next", F.lead(F.struct("votes", "exact")).over(Window.partitionBy("player_id").orderBy(F.desc("votes"), F.desc("exact"), "tm_id"))
    )
    clear = ranked.where("_r = 1").where(F.col("_next").isNull() | (F.col("_next") != F.struct("votes", "exact")))
    return unique_on(clear.select("player_id", "tm_id"), ["tm_id"])
