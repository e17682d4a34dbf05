"""Jobs from a feed's raw tables to its season table, and their publication.

Each takes raw tables as they are landed and gives (rows, coverage): rows of one player, season and feed, and one row of what was read and kept.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import round_even, true
from ..operators import aggregates, assembly, events, joins, validate
from ..scratch import held
from . import files
from .readers import numbered

# The month from which a season is the new one; minutes from which a match of two feeds is expected.
ROLLOVER, EXPECTED = 7, 900


def default_seasons(today: date | None = None) -> tuple[int, int]:
    """First years of the season being played and of the one before it."""
    today = today or date.today()
    current = today.year if today.month >= ROLLOVER else today.year - 1
    return current - 1, current


def landed(old: DataFrame, live: DataFrame | None, season: str = "season") -> DataFrame:
    """The archive with the seasons that were fetched since in place of its own."""
    return old if live is None else joins.replacing_union(old, live, [season])


def _coverage(raw: DataFrame, rows: DataFrame, *more: Column) -> DataFrame:
    whole = rows.agg(F.count("*").alias("player_seasons"), F.countDistinct("player_id").alias("players"), F.sort_array(F.collect_set("season")).alias("seasons"), F.sort_array(F.collect_set("league")).alias("leagues"), *more)
    return raw.agg(F.count("*").alias("rows_in")).crossJoin(whole)  # one row each


#: Sums of the aggregate feed by our names.
AGGREGATES = ("goals", "np_goals", "assists", "xg", "npxg", "xa", "shots", "key_passes", "xg_chain", "xg_buildup", "yellow_cards", "red_cards")


def aggregate_feed(
    raw: DataFrame, leagues: dict[str, str], renames: dict[str, str], position: Column, *, live: DataFrame | None = None, keepers: DataFrame | None = None, links: DataFrame | None = None,
    profiles: DataFrame | None = None, history: DataFrame | None = None, first_season: str | None = None, in_progress: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A feed of season aggregates, a row a club: seasons fetched since replace the archive's, finished ones are kept (that in progress if wanted), transfers are added up, keepers attached.

    ``leagues``: {the feed's: ours}; ``renames``: {the feed's column: ours}; ``position``: a struct (group, position, source) from the feed's columns. With ``links`` (player_id, tm_id),
    ``profiles`` and ``history`` come attributes and values.
    """
    both = held(landed(raw, live).withColumnsRenamed(renames))
    rows = both.withColumn("league", X.mapped(F.col("league"), leagues)).where("league IS NOT NULL")
    status = assembly.season_status(rows.withColumn("matches", F.col("matches").try_cast("int")))
    wanted = status.where(F.lit(in_progress) | F.col("complete"))
    wanted = wanted.where(F.col("season") >= first_season) if first_season else wanted
    rows = rows.join(wanted.select("season"), "season", "left_semi")
    counted = {c: F.col(c).try_cast("double") for c in ("minutes", *AGGREGATES) if c in rows.columns}
    rows = rows.withColumns(counted).withColumns({"player": X.unescape(F.col("player")), "team": X.unescape(F.col("team")), "season": X.season_of_start(X.start_year(F.col("season"))), "_p": position})
    rows = rows.withColumns({"position_group": F.col("_p.group"), "position": F.col("_p.position"), "position_source": F.col("_p.source")}).where(true(F.col("minutes") > 0))
    counts = [c for c in AGGREGATES if c in rows.columns]
    rows = rows.withColumn("matches", F.col("matches").try_cast("double"))
    one = aggregates.collapse_transfers(rows, ["player_id", "season"], [*counts, "matches"], [], ["league", "player", "position_group", "position", "position_source"])
    if keepers is not None:
        one = assembly.with_keepers(one, keepers, "fetched_at")
    if links is not None and profiles is not None:
        attributes = [c for c in profiles.columns if c not in ("tm_id", "name")]
        one = assembly.with_profiles(one, links, profiles, ["player_id"], attributes)
        if history is not None:
            one = assembly.with_values(one.withColumn("start", X.start_year(F.col("season"))), history).drop("start")
    return one, _coverage(both, one, *([F.count("tm_id").alias("linked")] if links is not None else []))


def fantasy_feed(
    exports: dict[str, DataFrame], gameweeks: dict[str, DataFrame], teams: DataFrame, direct: dict[str, str], groups: dict[int, str], *, logs: DataFrame | None = None, metrics: dict[str, str] | None = None,
    bars: dict[str, int] | None = None, league: str = "Premier League",
) -> tuple[DataFrame, DataFrame]:
    """A fantasy game's season exports with appearances from its gameweeks and, by name and season, the sums of match logs.

    A season's logs count only if they cover it; where they do, their figures come before the game's own. ``direct`` {its column: ours} holds goals, minutes and ``code`` (the person's number);
    ``metrics`` {the logs' column: ours}.
    """
    rows = None
    for season, raw in exports.items():  # a season at a time
        one = assembly.season_export(raw, season, teams, direct, groups)
        played = assembly.appearances(gameweeks[season], bars) if season in gameweeks else None
        if played is not None:
            one = one.join(played.withColumnRenamed("team", "_club"), "element", "left").withColumn("team", F.coalesce("_club", "team")).drop("_club")
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    raw_rows = rows
    rows = held(rows.withColumns({"key": X.normalise_name(F.col("player")), "season_year": X.start_year(F.col("season"))}))
    matched = F.lit(None).cast("double")
    if logs is not None:
        sums = assembly.season_logs(logs, metrics or {})
        rows = rows.join(sums, ["key", "season_year"], "left")
        matched = round_even(F.avg(F.when(F.col("minutes") >= EXPECTED, F.col("us_minutes").isNotNull().cast("double"))), 4)
        rows = held(rows)
        share = rows.agg(matched.alias("matched"))
        fitting = assembly.without_partial_seasons(rows, season="season_year")
        for ours in dict.fromkeys((metrics or {}).values()):
            own = F.col(ours) if ours in fitting.columns else F.lit(None).cast("double")
            fitting = fitting.withColumn(ours, F.coalesce(f"us_{ours}", own))
        rows = fitting.drop(*[c for c in fitting.columns if c.startswith("us_")])
    else:
        share = rows.agg(matched.alias("matched"))
    by_name = numbered(rows.select("key").distinct(), "key", "_n").select("key", X.padded_id("PL", F.col("_n")).alias("_by_name"))
    rows = rows.join(by_name, "key", "left").withColumn("player_id", F.coalesce(F.concat(F.lit("PLC"), F.col("code").cast("bigint").cast("string")), "_by_name") if "code" in rows.columns else F.col("_by_name")).drop("_by_name")
    for c in ("matches", "clubs_in_season", "np_goals", "penalties_missed", "goals"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.withColumns({"matches": F.coalesce("matches", F.lit(0)), "clubs_in_season": F.coalesce("clubs_in_season", F.lit(1)), "league": F.lit(league)})
    rows = assembly.penalties(rows.withColumn("penalties_missed", F.coalesce("penalties_missed", F.lit(0.0)))).where(true(F.col("minutes") > 0))
    return rows.drop("key", "season_year", "element"), _coverage(raw_rows, rows).crossJoin(share)  # one row each


def block_feed(
    blocks: dict[str, DataFrame], names: dict[str, dict[str, str]], key: list[str], counts: list[str], *, standard: str = "standard", minutes: str = "minutes", season: str = "season_end", eras: dict[str, tuple[DataFrame, dict[str, str], int]] | None = None,
    either: dict[str, tuple[str, str]] | None = None, means: list[str] = (), identity: list[str] = (), seasons: tuple[int, int] | None = None, possession: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A feed of several blocks a player, club and season, of one identity block and others that must cover a season in full to count.

    ``eras``: {block: (later release, {old column: new}, first season of the release)}; ``either``: {ours: (column, the one that stands in for it)}, as feeds rename columns between providers.
    Blocks are joined on ``key`` (with club and season), transfers added up, and a team's possession joined by season.
    """
    read = dict(blocks)
    for name, (release, renamed, cutover) in (eras or {}).items():
        read[name] = joins.merge_eras(read[name], release, renamed, season, cutover)
    first = read.pop(standard)
    whole = held(first)
    rows = assembly.tidy_block(whole, names[standard], key, seasons, season)
    dropped = None
    for name, block in read.items():
        kept = held(aggregates.drop_stale_seasons(block, whole, key, minutes, season)) if minutes in block.columns else block
        lost = block.select(F.lit(name).alias("block"), F.col(season).alias("lost")).distinct().join(kept.select(F.col(season).alias("lost")).distinct(), "lost", "left_anti").select("block", "lost")
        dropped = lost if dropped is None else dropped.union(lost)
        fresh = {theirs: ours for theirs, ours in names[name].items() if ours not in rows.columns}
        rows = rows.join(assembly.tidy_block(kept, fresh, key, seasons, season), key, "left")
    for ours, (a, b) in (either or {}).items():
        rows = rows.withColumn(ours, F.coalesce(a, b)).drop(*[c for c in (a, b) if c != ours])
    player = [k for k in key if k not in ("team", season)]
    one = aggregates.collapse_transfers(rows, [*player, season], [c for c in counts if c in rows.columns], [c for c in means if c in rows.columns], [c for c in identity if c in rows.columns])
    one = one.withColumn("season", X.season_of_end(F.col(season)))
    if possession is not None:
        one = one.join(assembly.own_possession(possession).withColumnRenamed("season", season), ["team", season], "left")
    one = one.where(true(F.col("minutes") > 0)).drop(season)
    coverage = first.agg(F.count("*").alias("rows_in")).crossJoin(one.agg(F.count("*").alias("player_seasons"), F.sort_array(F.collect_set("season")).alias("seasons")))  # one row each
    lost_blocks = dropped.agg(F.sort_array(F.collect_set(F.concat_ws(" ", "block", F.col("lost").cast("string")))).alias("stale")) if dropped is not None else first.sparkSession.range(1).select(F.array().cast("array<string>").alias("stale"))
    return one, coverage.crossJoin(lost_blocks)  # one row


def event_feed(matches: DataFrame, lineups: DataFrame, about: DataFrame, sums: list[str] | None = None) -> DataFrame:
    """Match events and line-ups to player-seasons; ``about``: match_id, player_id, league, season, player, nationality, team, possession of whoever was in a match."""
    per = events.player_matches(matches, lineups)
    sums = sums if sums is not None else [c for c, t in per.dtypes if t == "double" and c != "minutes"]
    return events.player_seasons(per.join(about, ["match_id", "player_id"]), [c for c in sums if c in per.columns])


def squad_feed(squads: DataFrame, performance: DataFrame, season: str, competition: str, columns: tuple[str, ...] = ("goals", "assists", "yellow_cards", "red_cards", "starts", "team_possession")) -> DataFrame:
    """Squads with their stats of one season in the platform's columns; what the feed doesn't record is null, players without a minute go."""
    rows = assembly.squads_with_stats(squads, performance, season, competition)
    return rows.withColumns({c: F.lit(None).cast("double") for c in columns if c not in rows.columns})


def profile_rows(raw: DataFrame) -> DataFrame:
    """Profiles cleaned: ids as numbers, names without their id, first nationality, last part of the position, heights in centimetres, dates."""
    return raw.select(
        F.col("player_id").try_cast("bigint").alias("tm_id"), X.without_number(F.col("player_name")).alias("name"), F.to_date(F.substring("date_of_birth", 1, 10)).alias("date_of_birth"),
        round_even(X.height_cm(F.col("height")), 0).alias("height_cm"), "foot", X.first_of(F.col("citizenship")).alias("nationality"), F.col("main_position").alias("bucket"), X.last_part(F.col("position")).alias("detail"),
    ).where("tm_id IS NOT NULL")


class Refused(Exception):
    """A build that lost whole seasons, or too much of some, isn't published."""


def publish(rows: DataFrame, path: str, order: list[str], season: str = "season", allowed: float = 0.10) -> dict[str, int]:
    """Make ``path`` the season table ``rows`` as compressed CSV, files by season; only those that changed are written, and a rerun writes none.

    Refused, before anything is written, where a season that is there would vanish or lose more than ``allowed`` of its rows.
    """
    spark = rows.sparkSession
    once = held(rows)
    folder = F.concat(F.lit("season="), F.coalesce(F.col(season).cast("string"), F.lit("unknown")))
    known = files.manifest(spark, path).groupBy("folder").agg(F.sum("rows").alias("before"))
    now = once.groupBy(folder.alias("folder")).agg(F.count("*").alias("after"))
    lost = [r["folder"] for r in validate.shrinkage(known, now, "folder", allowed).where("refused").orderBy("folder").collect()]  # a row a season
    if lost:
        raise Refused(f"too many rows lost: {', '.join(lost)}")
    return files.write_csv(once, path, folder, order)


def player_extract(games: DataFrame, appearances: DataFrame, clubs: DataFrame, players: DataFrame, valuations: DataFrame, lineups: DataFrame | None, competitions: list[str], first_season: int) -> dict[str, DataFrame]:
    """The tables that other feeds link to, cut out of a large one: season minutes by club, players, valuations, positions by season, and one row about them.

    Only players with an appearance in the competitions from the first season on are in any of them.
    """
    wanted_games = held(games.where(F.col("competition").isin(competitions) & (F.col("season") >= first_season)).select("game_id", "season", "competition"))
    played = held(appearances.join(wanted_games, "game_id"))
    minutes = played.groupBy("player_id", "season", "competition", "club_id").agg(
        F.count("*").alias("matches"), F.sum("minutes").alias("minutes"), F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), F.max_by("player_name", F.struct("date", "game_id")).alias("player_name")
    )
    minutes = held(minutes.join(clubs.select("club_id", F.col("name").alias("club")), "club_id", "left"))
    wanted = minutes.select("player_id").distinct()
    out = {"minutes": minutes, "players": players.join(wanted, "player_id", "left_semi"), "valuations": held(valuations.join(wanted, "player_id", "left_semi").select("player_id", "date", "value"))}
    if lineups is not None:
        starts = lineups.join(wanted_games, "game_id").join(wanted, "player_id", "left_semi").where(F.contains(F.lower("type"), F.lit("start")))
        out["positions"] = held(assembly.line_up_record(starts.select("player_id", "season", "position", F.coalesce(F.col("captain").try_cast("int"), F.lit(0)).cast("boolean").alias("captain"))))
    else:
        out["positions"] = games.sparkSession.createDataFrame([], "player_id long, season int, position string, position_starts long, position_share double, positions_played string, captain_starts long")
    one = lambda df, *aggregates_: df.agg(*aggregates_)
    out["about"] = (
        one(out["players"], F.count("*").alias("players")).crossJoin(one(out["valuations"], F.count("*").alias("valuations"), F.max("date").alias("latest_valuation")))
        .crossJoin(one(out["positions"], F.count("*").alias("season_positions"))).crossJoin(one(played, F.max("date").alias("latest_appearance"), F.sort_array(F.collect_set("season")).alias("seasons")))
    )  # fmt: skip  (one row each)
    return out


def write_extract(tables: dict[str, DataFrame], path: str, order: dict[str, list[str]]) -> dict[str, dict[str, int]]:
    """Each table as compressed CSV in a folder of its own; the same tables give the same bytes."""
    return {name: files.write_csv(tables[name], f"{path}/{name}", F.lit("all"), order[name]) for name in order}

