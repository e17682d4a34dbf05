"""From raw feeds to one player-season table: appearances, match logs, keepers, squads, links to profiles, floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if, round_even, true
from ..functions.text import mapped, normalise_name
from ..scratch import held
from .aggregates import defensive_bar, main_value
from .joins import as_of, unique_on
from .ranking import best_of

# Other names of countries, after normalising.
COUNTRIES = {
    "korea republic": "korea south", "south korea": "korea south", "turkiye": "turkey", "ivory coast": "cote d ivoire", "usa": "united states", "congo dr": "dr congo",
    "democratic republic of the congo": "dr congo", "cape verde islands": "cape verde", "cabo verde": "cape verde", "ir iran": "iran", "republic of ireland": "ireland",
    "czechia": "czech republic",
}
# Minutes that make a regular, and a squad player, in a finished season and in one being played.
REGULAR, SQUAD, SQUAD_IN_PROGRESS, FLOOR_SHARE, LEAST_FLOOR, FULL_GAMES = 900, 450, 270, 0.5, 180, 30
TOURNAMENT_AGES = (16, 42)


def country(name: Column) -> Column:
    key = normalise_name(F.coalesce(name, F.lit("")))
    return F.coalesce(mapped(key, COUNTRIES), key)


def team_names(master: DataFrame, by_season: DataFrame) -> DataFrame:
    """(season, team, team_name): each season's own list, with the master list where it has none."""
    ranked = master.select("season", "team", "team_name", F.lit(1).alias("_feed")).union(by_season.select("season", "team", "team_name", F.lit(0).alias("_feed")))
    return best_of(ranked, ["season", "team"], ["_feed", F.desc("team_name")]).drop("_feed")


def season_export(raw: DataFrame, season: str, teams: DataFrame, direct: dict[str, str], groups: dict[int, str]) -> DataFrame:
    """A fantasy game's season export in our names: ``direct`` {its column: ours} as numbers, prices in millions, clubs by their season's name."""
    names = teams.where(F.col("season") == season).select(F.col("team").try_cast("int").alias("_team"), "team_name")
    numbers = {ours: (F.col(theirs).try_cast("double") if theirs in raw.columns else F.lit(None).cast("double")) for theirs, ours in direct.items()}
    rows = raw.withColumn("_team", F.col("team").try_cast("int")).join(F.broadcast(names), "_team", "left")  # a season's clubs
    return rows.select(
        F.trim(F.concat_ws(" ", F.trim("first_name"), F.trim("second_name"))).alias("player"),
        F.lit(season).alias("season"),
        mapped(F.col("element_type").try_cast("int").cast("string"), {str(k): v for k, v in groups.items()}).alias("position_group"),
        F.coalesce("team_name", F.concat(F.lit("Team "), F.col("_team").cast("string"))).alias("team"),
        F.col("id").try_cast("bigint").alias("element"),
        (F.col("now_cost").try_cast("double") / 10).alias("price_m"),
        *[e.alias(c) for c, e in numbers.items()],
    )


def appearances(gameweeks: DataFrame, bars: dict[str, int] | None = None) -> DataFrame:
    """(element, matches, team, clubs_in_season, dc_hits, dc_matches, dc_bar_pct): matches played, the club of most minutes, the defensive bar."""
    played = gameweeks.withColumn("minutes", F.coalesce(F.col("minutes").try_cast("double"), F.lit(0.0))).where("minutes > 0")
    out = played.groupBy("element").agg(F.count("*").alias("matches"), F.countDistinct("team").alias("clubs_in_season"))
    out = out.join(main_value(played, ["element"], "team", "minutes", "team"), "element", "left")
    if bars and {"defensive_contribution", "position"} <= set(played.columns):
        counted = played.where("defensive_contribution IS NOT NULL")
        out = out.join(defensive_bar(counted, ["element"], "defensive_contribution", bars), "element", "left")
    return out


def season_logs(logs: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(key, season_year, us_<metric> ..., us_minutes, lineup_code): match logs (key, file, season, time, position, metrics) added up.

    Gaps count as nothing. Of several logs of one key and season the larger figures stand. A season's position is that of most minutes, coming on as a
    substitute aside.
    """
    rows = logs.withColumn("minutes", F.coalesce(F.col("time").try_cast("double"), F.lit(0.0))).withColumn("season_year", F.col("season").try_cast("int"))
    sums = [F.sum(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))).alias(f"us_{ours}") for c, ours in metrics.items()]
    per = rows.groupBy("key", "file", "season_year").agg(*sums, F.sum("minutes").alias("us_minutes"))
    best = per.groupBy("key", "season_year").agg(*[F.max(c).alias(c) for c in per.columns if c.startswith("us_")])
    places = main_value(rows.where("position <> 'Sub'"), ["key", "season_year"], "position", "minutes", "lineup_code")
    return best.join(places, ["key", "season_year"], "left")


def without_partial_seasons(df: DataFrame, minutes: str = "us_minutes", whole: str = "minutes", season: str = "season", least: float = 0.95, prefix: str = "us_") -> DataFrame:
    """A feed's columns go in seasons for which it has under 95 % of the minutes."""
    share = df.groupBy(season).agg((F.sum(minutes) / F.nullif(F.sum(whole), F.lit(0.0))).alias("_share"))
    fine = F.coalesce(F.col("_share") >= least, F.lit(False))
    return df.join(share, season, "left").withColumns({c: F.when(fine, F.col(c)) for c in df.columns if c.startswith(prefix)}).select(*df.columns)


def birth_dates(feeds: DataFrame, key: str = "key", date: str = "birth_date", order: str = "season") -> DataFrame:
    """(key, birth_date): the first known date of each name; earlier seasons win."""
    known = feeds.where(F.to_date(date).isNotNull())
    return known.groupBy(key).agg(F.min_by(F.to_date(date), F.struct(F.col(order), F.to_date(date))).alias(date))


def with_second_chances(ours: DataFrame, first: DataFrame, second: DataFrame, key: str, short: str) -> DataFrame:
    """Links (key, tm_id) of ``first``, and for keys left over those by short name in ``second`` (short, tm_id): ids not used yet, names that one player has."""
    left = ours.join(first.select(key), key, "left_anti").select(key, short)
    free = second.join(first.select("tm_id"), "tm_id", "left_anti")
    more = unique_on(left, [short]).join(unique_on(free, [short]), short).select(key, "tm_id")
    return first.select(key, "tm_id").union(more)


def with_profiles(df: DataFrame, links: DataFrame, profiles: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The link's id, and profile columns where the row has no value of its own; ids are unique in ``profiles``."""
    theirs = profiles.select("tm_id", *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = df.join(links.select(*key, "tm_id"), key, "left").join(theirs, "tm_id", "left")
    return joined.withColumns({c: F.coalesce(c, f"_p_{c}") if c in df.columns else F.col(f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def with_season_positions(df: DataFrame, seasonal: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of (tm_id, start, ...) joined by id and the season's first year."""
    start = F.split(F.col("season").cast("string"), "[-/]")[0].try_cast("int")
    return df.withColumn("start", start).join(seasonal.select("tm_id", "start", *columns), ["tm_id", "start"], "left").drop("start")


def with_values(df: DataFrame, history: DataFrame, start_year: str = "start") -> DataFrame:
    """market_value (as of 1 July after the season, 548 days old at most) and latest_value with its date, by tm_id."""
    probed = df.withColumn("_at", F.make_date(F.col(start_year) + 1, F.lit(7), F.lit(1)))
    valued = as_of(probed, history, "tm_id", "_at", "date", "value", "market_value").drop("_at")
    last = history.where("tm_id IS NOT NULL").groupBy("tm_id").agg(F.max_by("value", F.struct("date", "value")).alias("latest_value"), F.max("date").alias("latest_value_date"))
    return valued.join(last, "tm_id", "left")


def keeper_rows(matches: DataFrame, played: DataFrame, listed: DataFrame) -> DataFrame:
    """(player_id, season, full_matches, full_xga, full_conceded, full_clean_sheets): sums over matches that a keeper played in full.

    matches: match_id, side, season, xg_against, conceded. played: match_id, player_id, side (null where it isn't clear), minutes. listed: player_id, season, each of
    which gets a row, of zeros where there is no such match.
    """
    full = played.where("side IS NOT NULL AND minutes >= 90").join(matches, ["match_id", "side"])
    sums = full.groupBy("player_id", "season").agg(
        F.count("*").alias("full_matches"), F.sum("xg_against").alias("full_xga"), F.sum("conceded").cast("double").alias("full_conceded"), count_if(F.col("conceded") == 0).alias("full_clean_sheets")
    )
    return listed.select("player_id", "season").distinct().join(sums, ["player_id", "season"], "left").fillna(0, ["full_matches"]).fillna(0.0, ["full_xga", "full_conceded", "full_clean_sheets"])


def with_keepers(df: DataFrame, keepers: DataFrame, order: str) -> DataFrame:
    """Keepers' columns by player and season; of several rows of one, the last by ``order``."""
    once = best_of(keepers, ["player_id", "season"], [F.desc(order)]).drop(order)
    return df.join(once, ["player_id", "season"], "left")


def match_sides(dates: DataFrame) -> DataFrame:
    """(match_id, side, team, xg, goals, xg_against, conceded): two rows for each finished match of nested dates."""
    done = dates.where(true(F.col("isResult")))
    number = lambda path: F.col(path).try_cast("double")
    side = lambda me, other: F.struct(
        F.lit(me).alias("side"), F.col(f"{me}.title").alias("team"), number(f"xG.{me}").alias("xg"), number(f"goals.{me}").alias("goals"), number(f"xG.{other}").alias("xg_against"), number(f"goals.{other}").alias("conceded")
    )
    return done.select(F.col("id").alias("match_id"), F.inline(F.array(side("h", "a"), side("a", "h"))))


def squads_with_stats(squads: DataFrame, performance: DataFrame, season: str, competition: str) -> DataFrame:
    """Squad rows with their summed stats of one season and competition; players without a minute go.

    performance: tm_id, stats (array of season, competition, minutes, goals, assists, matches).
    """
    wanted = F.filter("stats", lambda s: true((s["season"] == season) & (s["competition"] == competition)))
    total = lambda field: F.aggregate(wanted, F.lit(0.0), lambda a, s: a + F.coalesce(s[field].cast("double"), F.lit(0.0))).alias(field)
    sums = performance.select("tm_id", *[total(f) for f in ("minutes", "goals", "assists", "matches")])
    return squads.join(sums, "tm_id", "left").where("minutes > 0")


def link_internationals(ours: DataFrame, profiles: DataFrame) -> DataFrame:
    """(player_id, tm_id, how): tournament players and profiles by name, by words of the name, by surname; country and age must allow it.

    ours: player_id, player, full_name, season, nationality. profiles: tm_id, name, nationality, date_of_birth. Only links that leave one profile
    standing count; a player's tournaments vote, and a profile that two players claim is dropped. Words and surnames meet within a country on one word,
    never every name with every other.
    """
    tm = profiles.where("tm_id IS NOT NULL AND name IS NOT NULL").select(
        "tm_id", normalise_name(F.col("name")).alias("tm_key"), country(F.col("nationality")).alias("tm_country"), F.year(F.to_date("date_of_birth")).alias("born")
    )
    me = ours.select("player_id", "season", (F.substring("season", 1, 4).try_cast("int") + 1).alias("year"), country(F.col("nationality")).alias("country"), normalise_name(F.col("player")).alias("name"), normalise_name(F.col("full_name")).alias("full"))
    able = (F.col("year") - F.col("born")).between(*TOURNAMENT_AGES)
    same = (F.col("country") == F.col("tm_country")) | (F.col("country") == "") | (F.col("tm_country") == "")
    # Profiles alike in what is asked are met as one, by the first and the last of them; where these are one, one is left standing.
    alike = lambda df, *by: df.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    one = lambda df, how: alike(df, "player_id", "season").where("lo = hi").select("player_id", "season", F.col("lo").alias("tm_id"), F.lit(how).alias("how"))
    tm, me = held(alike(tm.withColumns({"lo": F.col("tm_id"), "hi": F.col("tm_id")}), "tm_key", "tm_country", "born")), held(me)
    named = me.select("player_id", "season", "year", "country", F.explode(F.array_distinct(F.array_compact(F.array("name", "full")))).alias("tm_key"))
    exact = one(named.join(tm, "tm_key").where(able & same), "name")
    rest = me.join(exact.select("player_id"), "player_id", "left_anti")
    mine = F.array_sort(F.array_union(F.split(F.coalesce("name", F.lit("")), " "), F.split(F.coalesce("full", F.lit("")), " ")))
    # A profile's words are all among mine only if its first and its last one are.
    theirs = tm.where("tm_country <> ''").withColumn("words", F.split("tm_key", " "))
    rest = rest.withColumn("mine", mine)
    spread = rest.select("country", "mine").distinct().withColumn("_a", F.explode("mine")).withColumn("_z", F.explode("mine"))
    long = theirs.where(F.size("words") >= 2).select(F.col("tm_country").alias("country"), F.col("words")[0].alias("_a"), F.element_at("words", -1).alias("_z"), "words", "born", "lo", "hi")
    fit = alike(spread.join(long, ["country", "_a", "_z"]).where(F.size(F.array_except("words", "mine")) == 0), "country", "mine", "born")
    by_words = rest.join(fit, ["country", "mine"]).where(able)
    words = one(by_words, "words")
    left = rest.join(by_words.select("player_id", "season").distinct(), ["player_id", "season"], "left_anti")
    surname = left.withColumn("last", F.element_at(F.split("name", " "), -1)).where(F.length("last") >= 4)
    lasts = alike(theirs.select(F.col("tm_country").alias("country"), F.element_at("words", -1).alias("last"), "born", "lo", "hi"), "country", "last", "born")
    asked = surname.select("country", "last", "year").distinct()
    last = surname.join(alike(asked.join(lasts, ["country", "last"]).where(able), "country", "last", "year"), ["country", "last", "year"])
    found = exact.union(words).union(one(last, "surname"))
    votes = found.groupBy("player_id", "tm_id").agg(F.count("*").alias("n"), F.min_by("how", "season").alias("how"))
    top = best_of(votes, ["player_id"], [F.desc("n"), "tm_id"])
    return unique_on(top, ["tm_id"]).select("player_id", "tm_id", "how")


def link_coverage(df: DataFrame) -> DataFrame:
    """(players, matched, minutes_covered, by_words, by_surname, regulars_matched) of rows with tm_id and how."""
    hit = F.col("tm_id").isNotNull()
    return df.agg(
        F.count("*").alias("players"), round_even(F.avg(hit.cast("double")), 4).alias("matched"), round_even(F.sum(F.when(hit, F.col("minutes"))) / F.sum("minutes"), 4).alias("minutes_covered"),
        F.count_if(F.col("how") == "words").alias("by_words"), F.count_if(F.col("how") == "surname").alias("by_surname"), round_even(F.avg(F.when(F.col("minutes") >= 270, hit.cast("double"))), 4).alias("regulars_matched"),
    )


def season_status(df: DataFrame, season: str = "season", games: str = "matches") -> DataFrame:
    """(season, most_games, complete): complete once somebody has played thirty games."""
    return df.groupBy(season).agg(F.max(games).alias("most_games")).withColumn("complete", F.col("most_games") >= FULL_GAMES)


def progress_floors(df: DataFrame, league: str = "league") -> DataFrame:
    """(league, floor) of a season being played: half the most minutes so far, in whole games, two games at least."""
    half = F.floor(F.max("minutes") * FLOOR_SHARE / 90) * 90
    return df.groupBy(league).agg(F.greatest(F.lit(float(LEAST_FLOOR)), half.cast("double")).alias("floor"), F.max("matches").alias("rounds"))


def squad_players(rows: DataFrame, pool: DataFrame, floors: DataFrame | None = None, folded: dict[str, str] | None = None, regular: float = REGULAR, squad: float | None = None) -> DataFrame:
    """Rows between the squad's floor and the regulars', in the pool's leagues; groups that the pool folded are folded here too."""
    least = squad if squad is not None else SQUAD_IN_PROGRESS if floors is not None else SQUAD
    marked = rows.join(floors.select("league", "floor"), "league", "left") if floors is not None else rows.withColumn("floor", F.lit(None).cast("double"))
    found = marked.where((F.col("minutes") >= least) & (F.col("minutes") < F.coalesce("floor", F.lit(float(regular))))).drop("floor")
    found = found.join(pool.select("league").distinct(), "league", "left_semi")
    return found.withColumn("position_group", F.coalesce(mapped(F.col("position_group"), folded), "position_group")) if folded else found


def with_league_metadata(df: DataFrame, leagues: DataFrame, strength: float = 0.80, tier: int = 1) -> DataFrame:
    """league_strength and league_tier from (league, strength, tier), or defaults, where no row of the table has any."""
    known = df.agg(F.count("league_strength").alias("_s"), F.count("league_tier").alias("_t"))
    joined = df.crossJoin(F.broadcast(known)).join(leagues.select("league", F.col("strength").alias("_strength"), F.col("tier").alias("_tier")), "league", "left")  # one row
    return joined.withColumns(
        {
            "league_strength": F.when(F.col("_s") > 0, F.col("league_strength")).otherwise(F.coalesce("_strength", F.lit(strength))),
            "league_tier": F.when(F.col("_t") > 0, F.col("league_tier")).otherwise(F.coalesce("_tier", F.lit(tier))),
        }
    ).drop("_s", "_t", "_strength", "_tier")


def own_possession(teams: DataFrame, against_prefix: str = "vs ") -> DataFrame:
    """(team, season, team_possession): a team's own rows, not those of its opponents; one a team and season."""
    mine = teams.where(~F.startswith(F.col("team"), F.lit(against_prefix)))
    return mine.groupBy("team", "season").agg(F.max("team_possession").alias("team_possession"))


def tidy_block(block: DataFrame, names: dict[str, str], key: list[str], seasons: tuple[int, int] | None = None, season: str = "season") -> DataFrame:
    """A feed's block in our names: key and renamed columns only, of the seasons asked for, one row a key (that of the larger figures)."""
    kept = block.where(F.col(season).between(*seasons)) if seasons else block
    return kept.groupBy(*key).agg(*[F.max(theirs).alias(ours) for theirs, ours in names.items() if theirs in block.columns])


def capabilities(df: DataFrame) -> list[str]:
    """Columns with any known value: what a feed can answer. One pass for all."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c]]


def scope(df: DataFrame) -> DataFrame:
    """The leagues and seasons (and genders) that a feed covers, with rows and distinct players of each."""
    by = ["league", "season", *(["gender"] if "gender" in df.columns else [])]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct("player_id").alias("players"))


def thin_columns(df: DataFrame, stats: list[str], season: str = "season", least: float = 0.9) -> DataFrame:
    """(metric, thin, seasons): metrics that are well measured in some of the seasons but not in all, and how many of each."""
    share = df.groupBy(season).agg(*[F.avg(F.col(s).isNotNull().cast("double")).alias(s) for s in stats]).unpivot([season], stats, "metric", "share")
    per = share.groupBy("metric").agg(F.count_if(F.col("share") < least).alias("thin"), F.count("*").alias("seasons"))
    return per.where((F.col("thin") > 0) & (F.col("thin") < F.col("seasons")))


def watchlist(entries: DataFrame, pool: DataFrame) -> DataFrame:
    """The pool's rows of entries (player_id, season); entries that it lacks are left out."""
    return pool.join(entries.select("player_id", "season").distinct(), ["player_id", "season"], "left_semi")


def clubs_of_games(appearances: DataFrame, games: DataFrame, clubs: DataFrame) -> DataFrame:
    """(player_id, season, competition, club, matches, minutes): appearances with their game's season and competition and their club's name."""
    met = appearances.join(games.select("game_id", "season", "competition"), "game_id").join(clubs.select("club_id", F.col("name").alias("club")), "club_id", "left")
    return met.groupBy("player_id", "season", "competition", "club").agg(F.count("*").alias("matches"), F.sum("minutes").alias("minutes"))


def line_up_record(starts: DataFrame) -> DataFrame:
    """(player_id, season, position, position_starts, position_share, positions_played, captain_starts) from one row a start; ties by name."""
    per = starts.groupBy("player_id", "season", "position").agg(F.count("*").alias("n"), F.sum(F.col("captain").cast("long")).alias("captain"))
    order = F.struct((-F.col("n")).alias("n"), F.col("position").alias("p"))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda e: F.concat(e["p"], F.lit(":"), (-e["n"]).cast("string"))), "|")
    return per.groupBy("player_id", "season").agg(
        F.min_by("position", order).alias("position"), F.max("n").alias("position_starts"), round_even(F.max("n") / F.sum("n"), 3).alias("position_share"),
        packed.alias("positions_played"), F.sum("captain").alias("captain_starts"),
    )


def filled_positions(df: DataFrame, player: str = "player_id", season: str = "season") -> DataFrame:
    """Positions carried forward from a player's earlier seasons, and position_source 'carried forward' where they are."""
    w = Window.partitionBy(player).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)
    carried = df.withColumn("_last", F.last("position", ignorenulls=True).over(w))
    source = F.when(F.col("position").isNull() & F.col("_last").isNotNull(), F.lit("carried forward")).otherwise(F.col("position_source"))
    return carried.withColumn("position_source", source).withColumn("position", F.col("_last")).drop("_last")


def penalties(df: DataFrame) -> DataFrame:
    """pens_scored (goals that aren't np_goals, never under 0) and pens_taken (those and the missed)."""
    scored = F.when(F.col("goals").isNotNull() & F.col("np_goals").isNotNull(), F.greatest(F.col("goals") - F.col("np_goals"), F.lit(0.0)))
    return df.withColumns({"pens_scored": scored, "pens_taken": scored + F.col("penalties_missed")})
