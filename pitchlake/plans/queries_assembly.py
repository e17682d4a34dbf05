"""Assembling feeds, positions, floors, wide metrics, match events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_even
from ..functions.text import mapped
from ..operators import assembly, events, features, naming, positions, recruit, report, validate
from ..operators.models import long_form
from .adapters import PS, player_seasons, table
from .catalog import query
from .queries_analysis import EMB, NEAREST, _vectors, nearest_ten
from .queries_features import CATS, FIT, METRICS, WEIGHTS, scored

# --- appearances, logs, keepers ----------------------------------------------


@query(
    "appearances",
    """WITH p AS (SELECT user_id, event_type, GREATEST(value, 0) AS m FROM events WHERE value > 0), n AS (SELECT user_id, event_type, SUM(m) AS m FROM p GROUP BY ALL)
    SELECT user_id AS element, (SELECT CAST(COUNT(*) AS BIGINT) FROM p WHERE p.user_id = n.user_id) AS matches, CAST(COUNT(*) AS BIGINT) AS clubs_in_season, arg_min(event_type, ROW(-m, event_type)) AS team FROM n GROUP BY user_id""",
)
def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("element"), F.col("event_type").alias("team"), F.col("value").alias("minutes"))
    return assembly.appearances(ev).select("element", "matches", "clubs_in_season", "team")


@query(
    "season_logs",
    """WITH l AS (SELECT user_id % 50 AS key, user_id AS file, CAST(year(ts) AS INT) AS season_year, event_type AS position, COALESCE(value, 0) AS m, CAST(event_id % 7 AS DOUBLE) AS s FROM events),
    p AS (SELECT key, file, season_year, SUM(s) AS shots, SUM(m) AS minutes FROM l GROUP BY ALL), b AS (SELECT key, season_year, MAX(shots) AS us_shots, MAX(minutes) AS us_minutes FROM p GROUP BY ALL),
    c AS (SELECT key, season_year, position, SUM(m) AS m FROM l WHERE position <> 'view' GROUP BY ALL), d AS (SELECT key, season_year, arg_min(position, ROW(-round(m, 6), position)) AS lineup_code FROM c GROUP BY ALL)
    SELECT key, season_year, us_shots, round_even(us_minutes, 6) AS us_minutes, lineup_code FROM b LEFT JOIN d USING (key, season_year)""",
)
def season_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for coming on as a substitute."""
    kind = F.when(F.col("event_type") == "view", "Sub").otherwise(F.col("event_type"))
    logs = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("key"), F.col("user_id").alias("file"), F.year(F.col("ts").cast("timestamp")).alias("season"), F.col("value").alias("time"), kind.alias("position"), (F.col("event_id") % 7).cast("double").alias("shots")
    )
    return assembly.season_logs(logs, {"shots": "shots"}).withColumn("us_minutes", round_even(F.col("us_minutes"), 6))


KEEP = """m AS (SELECT o_orderkey AS match_id, o_orderkey % 2 AS side, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderkey % 5 AS DOUBLE) / 2 AS xga, o_orderkey % 3 AS conceded FROM orders),
  p AS (SELECT o_orderkey AS match_id, o_custkey AS player_id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 2 END AS side, 60 + o_orderkey % 40 AS minutes FROM orders)"""


def _keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    matches = o.select(k.alias("match_id"), (k % 2).alias("side"), F.year("o_orderdate").alias("season"), ((k % 5).cast("double") / 2).alias("xg_against"), (k % 3).alias("conceded"))
    played = o.select(k.alias("match_id"), F.col("o_custkey").alias("player_id"), F.when(k % 11 > 0, k % 2).alias("side"), (60 + k % 40).alias("minutes"))
    listed = o.select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"))
    return assembly.keeper_rows(matches, played, listed)


@query(
    "keeper_rows",
    f"""WITH {KEEP}, f AS (SELECT player_id, season, CAST(COUNT(*) AS BIGINT) AS n, SUM(xga) AS xga, CAST(SUM(conceded) AS DOUBLE) AS c, CAST(COUNT(*) FILTER (conceded = 0) AS DOUBLE) AS cs FROM p JOIN m USING (match_id, side) WHERE minutes >= 90 GROUP BY ALL)
    SELECT player_id, season, COALESCE(n, 0) AS full_matches, COALESCE(xga, 0) AS full_xga, COALESCE(c, 0) AS full_conceded, COALESCE(cs, 0) AS full_clean_sheets FROM (SELECT DISTINCT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season FROM orders) LEFT JOIN f USING (player_id, season)""",
)
def keeper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keepers(spark, sf_dir)


@query(
    "keeper_full_match_rates",
    f"""WITH {KEEP}, f AS (SELECT player_id, season, COUNT(*) AS n, SUM(xga) AS xga, SUM(conceded) AS c, COUNT(*) FILTER (conceded = 0) AS cs FROM p JOIN m USING (match_id, side) WHERE minutes >= 90 GROUP BY ALL)
    SELECT player_id, season, COALESCE(round_even(xga / n, 3), 1.5::DOUBLE) AS xgc_per90, COALESCE(round_even(c::DOUBLE / n, 3), 2.5::DOUBLE) AS goals_conceded_per90, round_even((xga - c) / n, 3) AS gk_xgc_minus_ga_per90,
    COALESCE(round_even(100.0::DOUBLE * cs / n, 2), 10.0::DOUBLE) AS clean_sheet_rate FROM (SELECT DISTINCT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season FROM orders) LEFT JOIN f USING (player_id, season)""",
)
def keeper_full_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keepers(spark, sf_dir).withColumns({"xgc_per90": F.lit(1.5), "goals_conceded_per90": F.lit(2.5), "gk_xgc_minus_ga_per90": F.lit(None).cast("double"), "clean_sheet_rate": F.lit(10.0)})
    return features.keeper_full_match_rates(rows).select("player_id", "season", "xgc_per90", "goals_conceded_per90", "gk_xgc_minus_ga_per90", "clean_sheet_rate")


@query(
    "keepers_attached",
    """WITH k AS (SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) = 1)
    SELECT c_custkey AS player_id, 1997 AS season, price FROM customer LEFT JOIN k ON c_custkey = player_id AND season = 1997""",
)
def keepers_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.lit(1997).alias("season"))
    keepers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return assembly.with_keepers(rows, keepers, "o_orderkey")


@query(
    "match_sides",
    """WITH d AS (SELECT o_orderkey AS id, o_custkey AS h, o_orderkey % 97 AS a, CAST(o_orderkey % 5 AS DOUBLE) AS hg, CAST(o_orderkey % 4 AS DOUBLE) AS ag FROM orders WHERE o_orderstatus = 'F')
    SELECT id AS match_id, 'h' AS side, CAST(h AS VARCHAR) AS team, hg AS goals, ag AS conceded FROM d UNION ALL SELECT id, 'a', CAST(a AS VARCHAR), ag, hg FROM d""",
)
def match_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pair = lambda h, a: F.struct(h.cast("string").alias("h"), a.cast("string").alias("a"))
    title = lambda x: F.struct(x.cast("string").alias("title"))
    dates = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_orderstatus") == "F").alias("isResult"), title(F.col("o_custkey")).alias("h"), title(k % 97).alias("a"), pair(k % 5, k % 4).alias("goals"), pair(k % 5, k % 4).alias("xG"))
    return assembly.match_sides(dates).select("match_id", "side", "team", "goals", "conceded")


@query(
    "squads_with_stats",
    """WITH s AS (SELECT l_partkey AS tm_id, SUM(l_quantity) AS minutes, CAST(SUM(l_linenumber) AS DOUBLE) AS goals FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_partkey) SELECT p_partkey AS tm_id, p_brand, minutes, goals FROM part JOIN s ON p_partkey = tm_id""",
)
def squads_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stat = F.struct(F.col("l_returnflag").alias("season"), F.col("l_linestatus").alias("competition"), F.col("l_quantity").alias("minutes"), F.col("l_linenumber").alias("goals"), F.lit(0).alias("assists"), F.lit(1).alias("matches"))
    performance = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("tm_id")).agg(F.collect_list(stat).alias("stats"))
    squads = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tm_id"), "p_brand")
    return assembly.squads_with_stats(squads, performance, "R", "F").select("tm_id", "p_brand", "minutes", "goals")


# --- links and what comes with them --------------------------------------------


@query(
    "second_chance_links",
    """WITH f AS (SELECT c_custkey AS k, c_custkey AS tm_id FROM customer WHERE c_custkey % 2 = 0), l AS (SELECT c_custkey AS k, c_custkey // 3 AS s FROM customer WHERE c_custkey % 2 = 1), t AS (SELECT s_suppkey AS tm_id, s_suppkey // 3 AS s FROM supplier WHERE s_suppkey NOT IN (SELECT tm_id FROM f)),
    l1 AS (SELECT s, ANY_VALUE(k) AS k FROM l GROUP BY s HAVING COUNT(*) = 1), t1 AS (SELECT s, ANY_VALUE(tm_id) AS tm_id FROM t GROUP BY s HAVING COUNT(*) = 1) SELECT k, tm_id FROM f UNION ALL SELECT k, tm_id FROM l1 JOIN t1 USING (s)""",
)
def second_chance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 3").alias("s"))
    first = c.where("k % 2 = 0").select("k", F.col("k").alias("tm_id"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tm_id"), F.expr("s_suppkey div 3").alias("s"))
    return assembly.with_second_chances(c, first, second, "k", "s")


@query(
    "profiles_attached",
    """SELECT c_custkey AS k, s_suppkey AS tm_id, COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, s_acctbal) AS height, s_name AS foot FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 500""",
)
def profiles_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("height"))
    profiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tm_id"), F.col("s_acctbal").alias("height"), F.col("s_name").alias("foot"))
    links = c.select("k", (F.col("k") % 500).alias("tm_id")).join(profiles.select("tm_id"), "tm_id", "left_semi")
    return assembly.with_profiles(c, links, profiles, ["k"], ["height", "foot"]).select("k", "tm_id", "height", "foot")


@query(
    "season_positions_attached",
    f"""WITH {PS}, s AS (SELECT DISTINCT player_id AS tm_id, CAST(season AS INT) AS start, league AS detail FROM ps WHERE season % 2 = 0) SELECT player_id, season, detail FROM ps LEFT JOIN s ON tm_id = player_id AND start = season""",
)
def season_positions_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).select("player_id", "season", F.col("player_id").alias("tm_id"), "league")
    seasonal = ps.where("season % 2 = 0").select("tm_id", F.col("season").alias("start"), F.col("league").alias("detail"))
    return assembly.with_season_positions(ps.drop("league"), seasonal, ["detail"]).select("player_id", "season", "detail")


@query(
    "values_attached",
    """WITH h AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, MAX(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT c_custkey AS tm_id, make_date(1997, 7, 1) AS probed FROM customer),
    l AS (SELECT k, arg_max(v, d) AS latest_value, CAST(MAX(d) AS VARCHAR) AS latest_value_date FROM h GROUP BY k)
    SELECT tm_id, CASE WHEN date_diff('day', d, probed) <= 548 THEN v END AS market_value, latest_value, latest_value_date FROM p ASOF LEFT JOIN h ON tm_id = h.k AND probed >= d LEFT JOIN l ON tm_id = l.k""",
)
def values_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tm_id"), F.lit(1996).alias("start"))
    history = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tm_id"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))
    return assembly.with_values(players, history).select("tm_id", "market_value", "latest_value", F.col("latest_value_date").cast("string").alias("latest_value_date"))


@query(
    "partial_seasons",
    f"""WITH {PS}, s AS (SELECT *, CASE WHEN season = 1997 THEN mins * 0.5::DOUBLE ELSE mins END AS um FROM ps), r AS (SELECT season, SUM(um) / SUM(mins) AS r FROM s GROUP BY season) SELECT player_id, season, CASE WHEN r >= 0.95 THEN shots END AS us_shots FROM s JOIN r USING (season)""",
)
def partial_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).withColumns({"us_minutes": F.col("minutes") * F.when(F.col("season") == 1997, 0.5).otherwise(1.0), "us_shots": F.col("shots")})
    return assembly.without_partial_seasons(ps).select("player_id", "season", "us_shots")


@query(
    "birth_dates",
    "SELECT o_custkey AS key, CAST(arg_min(CAST(o_orderdate AS DATE), ROW(year(o_orderdate), CAST(o_orderdate AS DATE))) AS VARCHAR) AS birth_date FROM orders GROUP BY o_custkey",
)
def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("birth_date"), F.year("o_orderdate").alias("season"))
    return assembly.birth_dates(feeds).select("key", F.col("birth_date").cast("string").alias("birth_date"))


# --- positions -------------------------------------------------------------------

DETAILED = {"Left Winger": ("W", "LW"), "Right-Back": ("FB", "RB"), "Centre-Back": ("CB", "CB"), "Goalkeeper": ("GK", "GK")}
LINES = {"Attack": ("FWD", "FWD")}
PLACES, LISTS = ["Left Winger", "Right-Back", "Centre-Back", "Goalkeeper", "Attack", "nowhere"], ["FW,MF", "DF", "MF", "GK", "", "FW", "DF,FW"]


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", pick(PLACES, k % 6).alias("place"), pick(LISTS, k % 7).alias("listed"))


POS = """c AS (SELECT c_custkey, list_extract(['Left Winger', 'Right-Back', 'Centre-Back', 'Goalkeeper', 'Attack', 'nowhere'], CAST(c_custkey % 6 AS INT) + 1) AS place, list_extract(['FW,MF', 'DF', 'MF', 'GK', '', 'FW', 'DF,FW'], CAST(c_custkey % 7 AS INT) + 1) AS listed FROM customer),
  g AS (SELECT *, CASE place WHEN 'Left Winger' THEN 'W' WHEN 'Right-Back' THEN 'FB' WHEN 'Centre-Back' THEN 'CB' WHEN 'Goalkeeper' THEN 'GK' WHEN 'Attack' THEN 'FWD' END AS grp, CASE place WHEN 'Left Winger' THEN 'LW' WHEN 'Right-Back' THEN 'RB' WHEN 'Centre-Back' THEN 'CB' WHEN 'Goalkeeper' THEN 'GK' WHEN 'Attack' THEN 'FWD' END AS pos,
    CASE WHEN listed = '' THEN [] ELSE string_split(listed, ',') END AS rs FROM c),
  r AS (SELECT *, CASE grp WHEN 'W' THEN 'FW' WHEN 'FWD' THEN 'FW' WHEN 'FB' THEN 'DF' WHEN 'CB' THEN 'DF' WHEN 'GK' THEN 'GK' END AS role FROM g),
  f AS (SELECT *, CASE WHEN len(rs) = 0 OR role IS NULL THEN true WHEN (role = 'GK') <> list_contains(rs, 'GK') THEN false WHEN role = 'GK' THEN true WHEN role = 'DF' THEN list_has_any(rs, ['DF', 'MF']) ELSE list_has_any(rs, ['MF', 'FW']) END AS fits, string_split(listed, ',')[1] AS one FROM r)"""


@query("fits_listed_roles", f"WITH {POS} SELECT c_custkey, fits FROM f")
def fits_listed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = mapped(F.col("place"), {k: v[0] for k, v in (DETAILED | LINES).items()})
    return _listed(spark, sf_dir).select("c_custkey", positions.fits(group, F.col("listed")).alias("fits"))


@query(
    "resolved_positions",
    f"""WITH {POS}, s AS (SELECT *, CASE WHEN one = 'GK' THEN '' WHEN pos IN ('LB', 'LW', 'LM') THEN 'L' WHEN pos IN ('RB', 'RW', 'RM') THEN 'R' ELSE '' END AS side, CASE one WHEN 'GK' THEN 'GK' WHEN 'DF' THEN 'DEF' WHEN 'FW' THEN 'FWD' ELSE 'MID' END AS line FROM f),
    m AS (SELECT *, CASE WHEN grp = 'GK' THEN NULL WHEN one = 'DF' THEN CASE side WHEN 'L' THEN 'FB|LB' WHEN 'R' THEN 'FB|RB' ELSE 'CB|CB' END WHEN one = 'FW' THEN CASE side WHEN 'L' THEN 'W|LW' WHEN 'R' THEN 'W|RW' ELSE 'FW|CF' END WHEN one = 'GK' THEN 'GK|GK' END AS moved FROM s)
    SELECT c_custkey, CASE WHEN grp IS NULL THEN line WHEN fits THEN grp WHEN moved IS NOT NULL THEN string_split(moved, '|')[1] ELSE line END AS position_group, CASE WHEN grp IS NULL THEN line WHEN fits THEN pos WHEN moved IS NOT NULL THEN string_split(moved, '|')[2] ELSE line END AS position FROM m""",
)
def resolved_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positions.resolved_position(F.col("place"), F.col("listed"), DETAILED, LINES)
    return _listed(spark, sf_dir).select("c_custkey", found.alias("p")).select("c_custkey", F.col("p.group").alias("position_group"), "p.position")


@query(
    "assigned_positions",
    """WITH c AS (SELECT c_custkey, list_extract(['D M S', 'F', 'GK', 'M F'], CAST(c_custkey % 4 AS INT) + 1) AS roles, CASE c_custkey % 5 WHEN 0 THEN 'Centre-Forward' WHEN 1 THEN 'Left-Back' END AS sd, list_extract(['Midfield', 'Attack', 'Goalkeeper'], CAST(c_custkey % 3 AS INT) + 1) AS pb FROM customer),
    b AS (SELECT *, CASE sd WHEN 'Centre-Forward' THEN 'FWD' WHEN 'Left-Back' THEN 'DEF' END AS g1, CASE sd WHEN 'Centre-Forward' THEN 'F' WHEN 'Left-Back' THEN 'D' END AS l1, CASE pb WHEN 'Midfield' THEN 'MID' WHEN 'Attack' THEN 'FWD' ELSE 'GK' END AS g2, CASE pb WHEN 'Midfield' THEN 'M' WHEN 'Attack' THEN 'F' ELSE 'GK' END AS l2 FROM c),
    d AS (SELECT *, COALESCE(list_contains(string_split(roles, ' '), l1), false) AS s1, list_contains(string_split(roles, ' '), l2) AS s2 FROM b)
    SELECT c_custkey, CASE WHEN s1 THEN g1 WHEN s2 THEN g2 ELSE 'MID' END AS position_group, CASE WHEN s1 THEN sd WHEN s2 THEN g2 ELSE 'M' END AS position, CASE WHEN s1 THEN 'that season: line-ups' WHEN s2 THEN 'profile' ELSE 'listed' END AS position_source FROM d""",
)
def assigned_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", pick(["D M S", "F", "GK", "M F"], k % 4).alias("roles"), F.when(k % 5 == 0, "Centre-Forward").when(k % 5 == 1, "Left-Back").alias("season_detail"), F.lit("line-ups").alias("season_how"),
        pick(["Midfield", "Attack", "Goalkeeper"], k % 3).alias("profile_bucket"), F.lit(None).cast("string").alias("profile_detail"), F.lit("MID").alias("position_group"), F.lit("M").alias("position"), F.lit("listed").alias("position_source"),
    )
    return positions.assigned_positions(c, {"Centre-Forward": "Attack", "Left-Back": "Defender"}).select("c_custkey", "position_group", "position", "position_source")


@query(
    "wrong_links_withdrawn",
    """WITH c AS (SELECT c_custkey, c_custkey % 70 AS age, c_acctbal AS height FROM customer) SELECT c_custkey, CASE WHEN age BETWEEN 15 AND 45 THEN CAST(age AS DOUBLE) END AS age, CASE WHEN age BETWEEN 15 AND 45 THEN height END AS height_cm FROM c""",
)
def wrong_links_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 70).cast("double").alias("age"), F.col("c_acctbal").alias("height_cm"))
    return positions.without_odd_ages(c)


# --- floors, leagues, scope --------------------------------------------------------


@query("season_status", f"WITH {PS} SELECT season, MAX(matches) AS most_games, MAX(matches) >= 30 AS complete FROM ps GROUP BY season")
def season_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.season_status(player_seasons(spark, sf_dir))


FLOORS = "fl AS (SELECT league, GREATEST(180.0::DOUBLE, floor(MAX(mins) * 0.5::DOUBLE / 90) * 90) AS floor, MAX(matches) AS rounds FROM ps WHERE season = 2001 GROUP BY league)"


@query("progress_floors", f"WITH {PS}, {FLOORS} SELECT * FROM fl")
def progress_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.progress_floors(player_seasons(spark, sf_dir).where("season = 2001"))


@query(
    "squad_players",
    f"WITH {PS}, {FLOORS} SELECT player_id, season, CASE position_group WHEN 'BUILDING' THEN 'MACHINERY' ELSE position_group END AS position_group, mins AS minutes FROM ps JOIN fl USING (league) WHERE season = 2001 AND mins >= 60 AND mins < floor AND league IN (SELECT league FROM ps WHERE mins >= 300)",
)
def squad_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir)
    now = ps.where("season = 2001")
    return assembly.squad_players(now, ps.where("minutes >= 300"), assembly.progress_floors(now), {"BUILDING": "MACHINERY"}, squad=60).select("player_id", "season", "position_group", "minutes")


@query("league_metadata", f"WITH {PS} SELECT player_id, season, CASE league WHEN 'EUROPE' THEN 1.0::DOUBLE WHEN 'ASIA' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS league_strength, CASE league WHEN 'ASIA' THEN 2 ELSE 1 END AS league_tier FROM ps")
def league_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    leagues = spark.createDataFrame([("EUROPE", 1.0, 1), ("ASIA", 0.7, 2)], "league string, strength double, tier int")
    ps = player_seasons(spark, sf_dir).withColumns({"league_strength": F.lit(None).cast("double"), "league_tier": F.lit(None).cast("int")})
    return assembly.with_league_metadata(ps, leagues).select("player_id", "season", "league_strength", "league_tier")


@query("source_scope", f"WITH {PS} SELECT league, season, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(DISTINCT player_id) AS BIGINT) AS players FROM ps GROUP BY ALL")
def source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.scope(player_seasons(spark, sf_dir))


@query(
    "thin_columns",
    f"""WITH {PS}, d AS (SELECT season, AVG(CAST(NOT (season = 1996 AND player_id % 2 = 0) AS INT)) AS t, 1.0 AS s FROM ps GROUP BY season) SELECT 'tackles' AS metric, CAST(COUNT(*) FILTER (t < 0.9) AS BIGINT) AS thin, CAST(COUNT(*) AS BIGINT) AS seasons FROM d HAVING COUNT(*) FILTER (t < 0.9) BETWEEN 1 AND COUNT(*) - 1""",
)
def thin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).withColumn("tackles", F.when(~((F.col("season") == 1996) & (F.col("player_id") % 2 == 0)), F.col("tackles")))
    return assembly.thin_columns(ps, ["tackles", "shots"])


@query("watchlist", f"WITH {PS} SELECT player_id, season, shots FROM ps WHERE (player_id, season) IN (SELECT o_custkey, CAST(year(o_orderdate) AS INT) FROM orders WHERE o_orderpriority = '1-URGENT')")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"))
    return assembly.watchlist(entries, player_seasons(spark, sf_dir)).select("player_id", "season", "shots")


@query(
    "clubs_of_games",
    """SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, o_orderstatus AS competition, s_name AS club, CAST(COUNT(*) AS BIGINT) AS matches, SUM(l_quantity) AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def clubs_of_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    appeared = lines.select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("club_id"), F.col("o_custkey").alias("player_id"), F.col("l_quantity").alias("minutes"))
    games = o.select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("competition"))
    return assembly.clubs_of_games(appeared, games, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("name")))


@query(
    "line_up_record",
    """WITH s AS (SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, o_orderpriority AS position, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(o_orderkey % 4 = 0 AS INT)) AS BIGINT) AS c FROM orders GROUP BY ALL)
    SELECT player_id, season, arg_min(position, ROW(-n, position)) AS position, MAX(n) AS position_starts, round_even(MAX(n)::DOUBLE / SUM(n), 3) AS position_share, string_agg(position || ':' || n, '|' ORDER BY n DESC, position) AS positions_played, CAST(SUM(c) AS BIGINT) AS captain_starts FROM s GROUP BY ALL""",
)
def line_up_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("position"), (F.col("o_orderkey") % 4 == 0).alias("captain"))
    return assembly.line_up_record(starts)


@query(
    "filled_positions",
    f"""WITH {PS}, g AS (SELECT player_id, season, CASE WHEN (player_id + season) % 3 = 0 THEN team END AS position FROM ps), f AS (SELECT *, last_value(position IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM g)
    SELECT player_id, season, l AS position, CASE WHEN position IS NULL AND l IS NOT NULL THEN 'carried forward' ELSE 'own' END AS position_source FROM f""",
)
def filled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).select("player_id", "season", F.when((F.col("player_id") + F.col("season")) % 3 == 0, F.col("team")).alias("position"), F.lit("own").alias("position_source"))
    return assembly.filled_positions(ps)


@query("own_possession", "SELECT p_brand AS team, CAST(p_size AS INT) AS season, MAX(p_retailprice) AS team_possession FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL")
def own_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("vs "), "p_brand")).alias("team"), F.col("p_size").cast("int").alias("season"), F.col("p_retailprice").alias("team_possession"))
    return assembly.own_possession(p)


@query("tidy_block", "SELECT l_partkey AS k, CAST(year(l_shipdate) AS INT) AS season, MAX(l_quantity) AS shots FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY ALL")
def tidy_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("season"), F.col("l_quantity").alias("Sh"), "l_tax")
    return assembly.tidy_block(block, {"Sh": "shots", "missing": "never"}, ["k", "season"], (1996, 1998))


@query("penalties", f"WITH {PS} SELECT player_id, season, GREATEST(goals - assists, 0.0::DOUBLE) AS pens_scored, GREATEST(goals - assists, 0.0::DOUBLE) + 1 AS pens_taken FROM ps")
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).select("player_id", "season", "goals", F.col("assists").alias("np_goals"), F.lit(1.0).alias("penalties_missed"))
    return assembly.penalties(ps).select("player_id", "season", "pens_scored", "pens_taken")


# --- every composite and shrunken rate, over a wide table -----------------------------

STATS = (
    "np_goals npxg aerials_won aerials_lost tackles interceptions blocks clearances progressive_passes progressive_carries passes_under_pressure passes_attempted npxg_open_play clean_sheets starts goals assists xg xa "
    "miscontrols dispossessed touches_att_third touches_mid_third touches_def_third touches_att_pen touches tackles_att_third tackles_mid_third tackles_def_third progressive_pass_distance progressive_carry_distance carries "
    "sca_set_piece sca gk_psxg gk_goals_against xgc dribblers_challenged dribblers_tackled shots_blocked short_passes_attempted medium_passes_attempted long_passes_attempted dribbles_attempted xg_buildup xg_chain influence "
    "creativity threat shots key_passes crosses crosses_into_pen_area gk_shots_on_target_against pens_taken matches"
).split()


def _figure(i: int) -> str:
    """A stat as a function of the key: small whole numbers, zeros and gaps among them; the same text in both dialects."""
    return f"CASE WHEN (p_partkey + {i}) % 13 = 0 THEN NULL ELSE CAST((p_partkey * {2 * i + 3}) % {7 + i % 5} AS DOUBLE) END"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {s: F.expr(_figure(i)) for i, s in enumerate(STATS)}
    group = F.when(F.col("p_partkey") % 5 == 0, "GK").when(F.col("p_partkey") % 5 < 3, "CB").otherwise("FW")
    return table(spark, sf_dir, "part").select("p_partkey", group.alias("position_group"), (90.0 * (1 + F.col("p_partkey") % 20)).alias("minutes"), *[e.alias(s) for s, e in made.items()])


WIDE = f"""w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'GK' WHEN p_partkey % 5 < 3 THEN 'CB' ELSE 'FW' END AS position_group, CAST(1 + p_partkey % 20 AS DOUBLE) AS x, {', '.join(f'{_figure(i)} AS {s}' for i, s in enumerate(STATS))} FROM part)"""


def _share(part: str, *whole: str) -> str:
    return f"100.0::DOUBLE * ({part} / NULLIF({' + '.join(whole)}, 0))"


# {metric: (SQL, digits)}
COMPOSITES = {
    "np_goals_minus_npxg_per90": ("(np_goals - npxg) / x", 3), "aerials_contested_per90": ("(aerials_won + aerials_lost) / x", 3), "defensive_actions_per90": ("(tackles + interceptions + blocks + clearances) / x", 3),
    "progressive_actions_per90": ("(progressive_passes + progressive_carries) / x", 3), "pressured_pass_share": (_share("passes_under_pressure", "passes_attempted"), 2), "open_play_npxg_share": (_share("npxg_open_play", "npxg"), 2),
    "clean_sheet_rate": (_share("clean_sheets", "matches"), 2), "goal_involvements_per90": ("(goals + assists) / x", 3), "xgi_per90": ("(xg + xa) / x", 3), "np_goal_contributions_per90": ("(np_goals + assists) / x", 3),
    "contributions_above_expected_per90": ("(np_goals + assists - npxg - xa) / x", 3), "possession_lost_per90": ("(miscontrols + dispossessed) / x", 3), "att_third_touch_share": (_share("touches_att_third", "touches_att_third", "touches_mid_third", "touches_def_third"), 2),
    "mid_third_touch_share": (_share("touches_mid_third", "touches_att_third", "touches_mid_third", "touches_def_third"), 2), "def_third_touch_share": (_share("touches_def_third", "touches_att_third", "touches_mid_third", "touches_def_third"), 2),
    "box_touch_share": (_share("touches_att_pen", "touches"), 2), "att_third_tackle_share": (_share("tackles_att_third", "tackles_att_third", "tackles_mid_third", "tackles_def_third"), 2),
    "pass_progress_per_pass": ("progressive_pass_distance / NULLIF(passes_attempted, 0)", 2), "carry_progress_per_carry": ("progressive_carry_distance / NULLIF(carries, 0)", 2), "set_piece_sca_share": (_share("sca_set_piece", "sca"), 2),
    "gk_psxg_minus_ga_per90": ("CASE WHEN position_group = 'GK' THEN (gk_psxg - gk_goals_against) / x END", 3), "gk_xgc_minus_ga_per90": ("CASE WHEN position_group = 'GK' THEN (xgc - gk_goals_against) / x END", 3),
    "tackles_interceptions_per90": ("(tackles + interceptions) / x", 3), "dribbled_past_per90": ("(dribblers_challenged - dribblers_tackled) / x", 3), "passes_blocked_per90": ("(blocks - shots_blocked) / x", 3), "npxg_xa_per90": ("(npxg + xa) / x", 3),
    "assists_minus_xa_per90": ("(assists - xa) / x", 3), "short_pass_share": (_share("short_passes_attempted", "passes_attempted"), 2), "medium_pass_share": (_share("medium_passes_attempted", "passes_attempted"), 2),
    "long_pass_share": (_share("long_passes_attempted", "passes_attempted"), 2), "progressive_pass_rate": (_share("progressive_passes", "passes_attempted"), 2), "progressive_carry_rate": (_share("progressive_carries", "carries"), 2),
    "turnover_rate": ("100.0::DOUBLE * ((miscontrols + dispossessed) / NULLIF(touches, 0))", 2), "take_on_rate": (_share("dribbles_attempted", "touches"), 2),
}
CLIPPED = {"starts_share": _share("starts", "matches"), "buildup_share": "100.0::DOUBLE * xg_buildup / CASE WHEN xg_chain >= 0.5 THEN xg_chain END"}


@query(
    "composites_all",
    f"WITH {WIDE} SELECT p_partkey, {', '.join(f'round_even({e}, {d}) AS {m}' for m, (e, d) in COMPOSITES.items())}, {', '.join(f'CASE WHEN {e} IS NOT NULL THEN LEAST(round_even({e}, 2), 100.0::DOUBLE) END AS {m}' for m, e in CLIPPED.items())}, COALESCE(influence, 0) + COALESCE(creativity, 0) + COALESCE(threat, 0) AS ict FROM w",
)
def composites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.derived(_wide(spark, sf_dir)).select("p_partkey", *COMPOSITES, *CLIPPED, "ict")


def _eb(s: str, a: str, k: int, scale: int, digits: int) -> str:
    g = "OVER (PARTITION BY position_group)"
    own, every = f"SUM({s}) {g} / CASE WHEN SUM({a}) {g} > 0 THEN SUM({a}) {g} END", f"SUM({s}) OVER () / CASE WHEN SUM({a}) OVER () > 0 THEN SUM({a}) OVER () END"
    return f"round_even(({s} + {k}.0::DOUBLE * COALESCE({own}, {every})) / ({a} + {k}.0::DOUBLE) * {scale}.0::DOUBLE, {digits})"


@query(
    "shrunken_rates",
    f"""WITH {WIDE}, c AS (SELECT *, shots - COALESCE(pens_taken, 0) AS open_shots FROM w) SELECT p_partkey, {_eb('npxg', 'shots', 15, 1, 4)} AS npxg_per_shot, {_eb('xa', 'key_passes', 15, 1, 4)} AS xa_per_key_pass, {_eb('crosses_into_pen_area', 'crosses', 20, 100, 2)} AS cross_box_pct,
    CASE WHEN position_group = 'GK' THEN {_eb('gk_psxg', 'gk_shots_on_target_against', 30, 1, 4)} END AS gk_psxg_per_sot, {_eb('np_goals', 'open_shots', 20, 100, 2)} AS shot_conversion_pct FROM c""",
)
def shrunken_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.shrunken(_wide(spark, sf_dir), ["position_group"], shots_include_penalties=True)
    return out.select("p_partkey", "npxg_per_shot", "xa_per_key_pass", "cross_box_pct", "gk_psxg_per_sot", "shot_conversion_pct")


@query(
    "registered_ratios",
    f"""WITH {WIDE}, c AS (SELECT *, aerials_won + aerials_lost AS contested FROM w) SELECT p_partkey, {_eb('aerials_won', 'contested', 20, 100, 2)} AS aerial_win_pct, {_eb('dribblers_tackled', 'dribblers_challenged', 20, 100, 2)} AS dribbler_stop_pct FROM c""",
)
def registered_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ratios(_wide(spark, sf_dir), ["position_group"]).select("p_partkey", "aerial_win_pct", "dribbler_stop_pct")


# --- sheets, fits, profiles ------------------------------------------------------------

SHEET = report.Sheet({"Attack": ("shots", "goals", "assists"), "Defence": ("tackles", "shots")}, style=frozenset({"assists"}))


@query(
    "stat_sheet_average",
    f"WITH {CATS} SELECT player_id, season, 'Attack' AS category, round_even((round_even(pct_shots, 0) + round_even(pct_goals, 0)) / 2, 1) AS average, CAST(2 AS BIGINT) AS metrics FROM ca UNION ALL SELECT player_id, season, 'Defence', round_even(round_even(pct_tackles, 0) / 1, 1), 1 FROM ca",
)
def stat_sheet_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric counts in the first category that shows it, and matters of style in none."""
    long = long_form(scored(spark, sf_dir), ["player_id", "season"], [f"pct_{m}" for m in METRICS]).select("player_id", "season", F.substring("metric", 5, 99).alias("metric"), F.col("value").alias("pct"))
    return report.category_averages(long, SHEET, "CM", ["player_id", "season"])


@query(
    "price_fit",
    f"""WITH {CATS}, y AS (SELECT position_group, {FIT} AS perf, log10(value) AS y FROM ca WHERE value > 0) SELECT position_group, CAST(COUNT(*) AS BIGINT) AS players, round_even(regr_slope(y, perf), 6) AS slope, round_even(regr_r2(y, perf), 6) AS r2 FROM y WHERE perf IS NOT NULL GROUP BY position_group HAVING COUNT(*) >= 30""",
)
def price_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = recruit.price_fit(scored(spark, sf_dir).withColumn("perf", recruit.fit_score(WEIGHTS)), "perf", "value", "position_group")
    return fit.select("position_group", "players", round_even(F.col("slope"), 6).alias("slope"), round_even(F.col("r2"), 6).alias("r2"))


@query("find_by_profile", f"WITH {CATS} SELECT player_id, season, round_even((pct_shots + pct_tackles) / 2, 6) AS profile_mean FROM ca WHERE pct_shots >= 80 AND pct_tackles > 70")
def find_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recruit.matching_profile(scored(spark, sf_dir), [("shots", ">=", 80), ("tackles", ">", 70)], ["player_id", "season"])
    return found.select("player_id", "season", round_even(F.col("profile_mean"), 6).alias("profile_mean"))


@query(
    "strengths_and_weaknesses",
    f"""WITH {CATS}, l AS (SELECT player_id, season, metric, pct FROM (SELECT player_id, season, pct_shots AS shots, pct_goals AS goals, pct_tackles AS tackles, pct_passes AS passes FROM ca) UNPIVOT (pct FOR metric IN (shots, goals, tackles, passes)))
    SELECT player_id, season, metric, pct, pct >= 70 AS strength FROM l WHERE pct >= 70 OR pct <= 30""",
)
def strengths_and_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_form(scored(spark, sf_dir), ["player_id", "season"], [f"pct_{m}" for m in ("shots", "goals", "tackles", "passes")])
    return long.where("value >= 70 OR value <= 30").select("player_id", "season", F.substring("metric", 5, 99).alias("metric"), F.col("value").alias("pct"), (F.col("value") >= 70).alias("strength"))


# --- checks of the models ----------------------------------------------------------------


@query(
    "role_agreement",
    f"""WITH {NEAREST}, h AS (SELECT t.query, AVG(CAST(t.query % 3 = t.vec_id % 3 AS DOUBLE)) AS hit FROM t GROUP BY t.query), g AS (SELECT label, AVG(hit) AS s FROM h JOIN e ON query = vec_id GROUP BY label),
    n AS (SELECT label, vec_id % 3 AS r, COUNT(*) AS n FROM e GROUP BY ALL), c AS (SELECT label, CAST(COUNT(*) AS BIGINT) AS roles, SUM(n * n)::DOUBLE / pow(SUM(n), 2) AS c FROM n GROUP BY label)
    SELECT label, roles, round_even(s, 3) AS same_role, round_even(c, 3) AS chance, round_even(s / c, 2) AS lift FROM g JOIN c USING (label)""",
)
def role_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the neighbours of all vectors share their role."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("role"))
    return validate.role_agreement(nearest_ten(spark, sf_dir), v, "vec_id", "role", "label")


DEALT = f"""{EMB}, h AS (SELECT vec_id, label, v, ('0x' || md5('1:' || vec_id)[1:2])::INT % 64 AS part, md5('2:' || vec_id) AS h FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY label, part ORDER BY h, vec_id) AS r FROM h),
  p AS (SELECT a.label, a.v AS x, b.v AS y FROM o a JOIN o b ON a.label = b.label AND a.part = b.part AND b.r BETWEEN a.r + 1 AND a.r + 4)"""


@query(
    "feature_dominance",
    f"""WITH {DEALT}, s AS (SELECT label, row_number() OVER () AS id, x, y FROM p), d AS (SELECT label, id, i, pow(x[i + 1] - y[i + 1], 2) * (1 + i % 3) / (SELECT SUM(1.0::DOUBLE + k % 3) FROM range(64) w(k)) AS d FROM s, range(64) r(i)), t AS (SELECT *, SUM(d) OVER (PARTITION BY id) AS t FROM d)
    SELECT label, 'f' || i AS feature, round_even((1.0::DOUBLE + i % 3) / (SELECT SUM(1.0::DOUBLE + k % 3) FROM range(64) w(k)), 4) AS weight_share, round_even(AVG(CASE WHEN t > 0 THEN d / t ELSE 0 END), 4) AS distance_share, round_even(AVG(CASE WHEN t > 0 THEN d / t ELSE 0 END) * 64, 2) AS vs_even FROM t GROUP BY label, i""",
)
def feature_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"f{i}" for i in range(64)]
    return validate.feature_dominance(_vectors(spark, sf_dir), "vec_id", "v", "label", names, [1.0 + i % 3 for i in range(64)])


@query("reference_distance", f"WITH {DEALT} SELECT label, round_even(COALESCE(NULLIF(median(list_distance(x, y)), 0), 1), 6) AS reference FROM p GROUP BY label")
def reference_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.reference_distance(_vectors(spark, sf_dir), "vec_id", "v", "label")
    return found.withColumn("reference", round_even(F.col("reference"), 6))


@query("metric_sensitivity")
def metric_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the neighbours of all vectors change if one of the first features goes, or a group of them weighs thrice."""
    v, names = _vectors(spark, sf_dir), [f"f{i}" for i in range(64)]
    changes = validate.dropped(names[:2]) | validate.reweighted({"first eight": tuple(names[:8])}, names)
    return validate.sensitivity(v, v, "vec_id", "v", "label", names, [1.0] * 64, changes)


@query("separability")
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two labels can be told apart by eight features, cross-validated."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("position"), *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(8)])
    return validate.separability(rows, [("L0", "L1", True), ("L2", "L3", False)], "position", "vec_id", [f"f{i}" for i in range(8)])


# --- what sets clusters and players apart ---------------------------------------------------

CONCEPTS = {f"c{k}": tuple(f"f{4 * k + i}" for i in range(4)) for k in range(6)}
CENTERS = f"""{EMB}, l AS (SELECT label, i, AVG(v[i + 1]) AS m FROM e, range(24) r(i) GROUP BY label, i), s AS (SELECT CAST(label % 2 AS INT) AS grp, CAST(label AS INT) AS cluster, 'c' || i // 4 AS concept, round_even(AVG(m * 20 * CASE WHEN i IN (2, 9) THEN -1 ELSE 1 END), 3) AS z FROM l GROUP BY ALL),
  one AS (SELECT grp, cluster, concept || ':' || CAST(sign(z) AS INT) AS label, concept || ':' || CAST(sign(z) AS INT) AS traits, abs(z) AS score FROM s WHERE abs(z) >= 0.3::DOUBLE),
  two AS (SELECT a.grp, a.cluster, list_aggregate(list_sort([a.concept || ':1', b.concept || ':1']), 'string_agg', ',') AS label, a.concept || ':1,' || b.concept || ':1' AS traits, a.z + b.z AS score FROM s a JOIN s b ON a.grp = b.grp AND a.cluster = b.cluster AND a.z >= 0.3::DOUBLE AND b.z >= 0.25::DOUBLE AND (a.z > b.z OR a.z = b.z AND a.concept < b.concept)),
  w AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY grp, label ORDER BY score DESC, cluster) = 1), best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY grp, cluster ORDER BY score DESC, string_split(label, ',')) = 1),
  every AS (SELECT grp, cluster, MAX(abs(z)) AS m FROM s GROUP BY ALL)"""


@query(
    "cluster_traits",
    f"""WITH {CENTERS} SELECT every.grp, every.cluster, COALESCE(traits, '') AS traits, round_even(score, 4) AS score,
    CASE WHEN traits IS NULL THEN CAST(row_number() OVER (PARTITION BY every.grp, traits IS NULL ORDER BY m DESC, every.cluster) AS INT) END AS place FROM every LEFT JOIN best USING (grp, cluster)""",
)
def cluster_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the labels' mean vectors apart, odd and even labels being two groups of clusters."""
    v = _vectors(spark, sf_dir).select(F.col("label").cast("int").alias("cluster"), F.posexplode(F.slice("v", 1, 24)).alias("i", "x"))
    centers = v.groupBy((F.col("cluster") % 2).alias("grp"), "cluster", F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature")).agg((F.avg("x") * 20).alias("z"))
    scores = naming.concept_scores(centers, naming.concept_table(spark, CONCEPTS, frozenset({"f2", "f9"})), ["grp", "cluster"])
    spelt = F.array_join(F.transform("traits", lambda t: F.concat_ws(":", t["concept"], t["direction"].cast("string"))), ",")
    return naming.distinct_traits(scores, ["grp"], "cluster").select("grp", "cluster", spelt.alias("traits"), round_even(F.col("score"), 4).alias("score"), "place")


PAIRS = f"""{CATS}, l AS (SELECT player_id, season, f, x FROM (SELECT player_id, season, pct_shots AS shots, pct_goals AS goals, pct_passes AS passes, pct_assists AS assists, pct_completed AS completed, pct_tackles AS tackles FROM ca) UNPIVOT (x FOR f IN (shots, goals, passes, assists, completed, tackles))),
  p AS (SELECT a.player_id, a.season, a.f, a.x AS value_a, b.x AS value_b, (a.x - 50) / 30.0::DOUBLE AS za, (b.x - 50) / 30.0::DOUBLE AS zb FROM l a JOIN l b ON a.player_id = b.player_id AND a.f = b.f AND b.season = a.season + 1),
  g AS (SELECT *, abs(za - zb) AS gap, CASE WHEN abs(za - zb) >= 0.6::DOUBLE THEN 'apart' ELSE 'shared' END AS kind FROM p), u AS (SELECT *, kind = 'shared' AND LEAST(abs(za), abs(zb)) >= 0.4::DOUBLE AS unusual FROM g),
  k AS (SELECT * FROM (SELECT *, SUM(CAST(unusual AS INT)) OVER (PARTITION BY player_id, season) >= 3 AS enough FROM u) WHERE kind = 'apart' OR NOT enough OR unusual)"""


@query(
    "season_contrasts",
    f"""WITH {PAIRS} SELECT player_id, season, kind, CAST(row_number() OVER (PARTITION BY player_id, season, kind ORDER BY CASE WHEN kind = 'shared' THEN gap ELSE -gap END, f) AS INT) AS rank, f AS feature, CASE WHEN kind = 'apart' THEN CASE WHEN za > zb THEN 'a' ELSE 'b' END END AS more,
    round_even(gap, 6) AS gap, value_a, value_b FROM k QUALIFY rank <= 3""",
)
def season_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player's season shares with his next one, and where they differ; percentiles stand for z-scores."""
    long = long_form(scored(spark, sf_dir).select("player_id", "season", *[F.col(f"pct_{m}").alias(m) for m in METRICS]), ["player_id", "season"], METRICS).withColumnRenamed("metric", "feature")
    z = lambda x: (F.col(x) - 50) / 30.0
    one, two = long.withColumnRenamed("value", "value_a"), long.withColumnRenamed("value", "value_b").withColumn("season", F.col("season") - 1)
    pairs = one.join(two, ["player_id", "season", "feature"]).withColumns({"z_a": z("value_a"), "z_b": z("value_b")})
    return naming.contrasts(pairs, ["player_id", "season"], 3)


@query(
    "player_findings",
    f"""WITH {CATS}, k AS (SELECT *, CAST(2 + player_id % 2 * -1 AS INT) AS tier, (goals - 2) / 10.0::DOUBLE AS luck, list_sort(list_filter([{{'p': -cat_attack, 'c': 'Attack'}}, {{'p': -cat_build_up, 'c': 'Build Up'}}, {{'p': -cat_defence, 'c': 'Defence'}}], lambda x: x.p IS NOT NULL)) AS known FROM ca),
    t AS (SELECT *, list_filter(known, lambda x: -x.p >= 75) AS top FROM k),
    f AS (SELECT player_id, season, 'profile' AS finding, [known[1].c, known[-1].c] AS about, ['best', 'worst'] AS n, [-known[1].p, -known[-1].p] AS v FROM t WHERE len(known) > 0
      UNION ALL SELECT player_id, season, 'ready_young', list_transform(top, lambda x: x.c), ['age', 'categories'], [age, len(top)::DOUBLE] FROM t WHERE age <= 21 AND len(top) > 0
      UNION ALL SELECT player_id, season, 'raw_young', [], ['age'], [age] FROM t WHERE age <= 21 AND len(top) = 0
      UNION ALL SELECT player_id, season, 'veteran', [], ['age'], [age] FROM t WHERE age >= 30
      UNION ALL SELECT player_id, season, 'small_sample', [], ['minutes'], [mins] FROM t WHERE mins < 1350
      UNION ALL SELECT player_id, season, 'weaker_league', [], ['tier', 'strength'], [tier, 0.8::DOUBLE] FROM t WHERE tier > 1
      UNION ALL SELECT player_id, season, 'finishing', [], ['over_expected'], [luck] FROM t WHERE position_group <> 'GK' AND abs(luck) >= 0.1::DOUBLE)
    SELECT player_id, season, finding, array_to_string(about, ',') AS concerning, unnest(n) AS figure, round_even(unnest(v), 6) AS value FROM f""",
)
def player_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the figures of every player-season say of him, a row a figure."""
    rows = scored(spark, sf_dir).withColumns({"league_tier": (2 - F.col("player_id") % 2).cast("int"), "np_goals_minus_npxg_per90": (F.col("goals") - 2) / 10.0})
    found = report.findings(rows, {"Attack": "cat_attack", "Build Up": "cat_build_up", "Defence": "cat_defence"}, ["player_id", "season"])
    return found.select("player_id", "season", "finding", F.array_join("concerning", ",").alias("concerning"), F.explode("figures").alias("figure", "value")).withColumn("value", round_even(F.col("value"), 6))


# --- match events, through the event operators --------------------------------------------


def _named(x: Column) -> Column:
    return F.struct(x.alias("name"))


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as match events: a day is a match, a user a player, odd and even users the teams."""
    ev = table(spark, sf_dir, "events")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    team = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    place = F.array((F.col("event_id") % 121).cast("double"), (F.col("event_id") % 81).cast("double"))
    ahead = F.array(((F.col("event_id") * 7) % 121).cast("double"), ((F.col("event_id") * 5) % 81).cast("double"))
    outcome = F.when(F.col("event_id") % 3 == 0, "Incomplete")
    return ev.select(
        F.unix_date(F.to_date(ts)).cast("long").alias("match_id"), F.col("event_id").cast("string").alias("id"), F.unix_micros(ts).alias("index"), F.lit(1).alias("period"),
        (F.hour(ts) * 60 + F.minute(ts)).alias("minute"), F.second(ts).alias("second"), _named(mapped(kind, {"view": "Pass", "click": "Carry", "purchase": "Shot", "error": "Miscontrol", "signup": "Pressure"})).alias("type"),
        _named(team).alias("team"), _named(team).alias("possession_team"), F.struct(F.col("user_id").alias("id")).alias("player"), place.alias("location"),
        F.struct(ahead.alias("end_location"), (F.col("event_id") % 60).cast("double").alias("length"), _named(outcome).alias("outcome"), (F.col("event_id") % 4 == 0).alias("cross"), F.struct((F.col("user_id") + 1).alias("id")).alias("recipient")).alias("pass"),
        F.struct(F.col("value").alias("statsbomb_xg"), _named(F.when(F.col("event_id") % 5 == 0, "Goal").when(F.col("event_id") % 5 == 1, "Saved").otherwise("Off T")).alias("outcome")).alias("shot"),
    )


ME = """me AS (SELECT CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS match_id, event_id, epoch_us(ts) AS i, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS mi, CAST(floor(second(ts)) AS BIGINT) AS se, event_type AS k, user_id, user_id % 2 AS team, event_id % 121 AS x, event_id % 81 AS y,
  (event_id * 7) % 121 AS x2, (event_id * 5) % 81 AS y2, event_id % 3 = 0 AS failed FROM events)"""


@query("match_ends", f"WITH {ME} SELECT match_id, CAST(MAX(mi) AS DOUBLE) AS match_end FROM me GROUP BY match_id")
def match_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_ends(match_events(spark, sf_dir))


@query(
    "event_errors",
    f"""WITH {ME}, l AS (SELECT * FROM me WHERE k = 'error' OR k = 'view' AND failed), s AS (SELECT match_id, i, mi * 60 + se AS t, team FROM me WHERE k = 'purchase')
    SELECT l.match_id, l.user_id AS player_id, CAST(COUNT(DISTINCT (l.i, l.user_id)) AS DOUBLE) AS errors FROM l JOIN s ON l.match_id = s.match_id AND s.i > l.i AND s.t <= l.mi * 60 + l.se + 5 AND s.team <> l.team GROUP BY ALL""",
)
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.errors(match_events(spark, sf_dir))


@query(
    "keeper_context",
    f"""WITH {ME}, sp AS (SELECT DISTINCT match_id, user_id, team, 60.0 * (user_id % 24) AS s, 60.0 * (user_id % 24) + 90 AS e FROM me WHERE user_id % 50 = 0 OR user_id % 50 = 1), a AS (SELECT match_id, event_id, team, mi + se / 60.0::DOUBLE AS m, k, k = 'view' AS crossed FROM me
    WHERE k = 'purchase' OR k = 'view' AND event_id % 4 = 0 AND x2 >= 102 AND y2 BETWEEN 18 AND 62), j AS (SELECT a.match_id, a.event_id, a.k, arg_min(user_id, ROW(s, user_id)) AS player_id FROM a JOIN sp ON a.match_id = sp.match_id AND a.team <> sp.team AND s <= m AND m < e GROUP BY ALL)
    SELECT match_id, player_id, CAST(COUNT(*) FILTER (k = 'purchase' AND event_id % 5 <= 1) AS DOUBLE) AS gk_shots_on_target_against, CAST(COUNT(*) FILTER (k = 'purchase' AND event_id % 5 = 0) AS DOUBLE) AS gk_goals_against, CAST(COUNT(*) FILTER (k = 'view') AS DOUBLE) AS gk_crosses_faced FROM j GROUP BY ALL""",
)
def keeper_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = match_events(spark, sf_dir)
    start = 60.0 * (F.col("player_id") % 24)
    keepers = ev.select("match_id", F.col("team.name").alias("team"), F.col("player.id").alias("player_id")).where("player_id % 50 IN (0, 1)").distinct()
    return events.keeper_context(ev, keepers.select("match_id", "team", "player_id", start.alias("start"), (start + 90).alias("end")))


@query(
    "keeper_distribution",
    f"""WITH {ME} SELECT match_id, user_id AS player_id, CAST(COUNT(*) AS DOUBLE) AS gk_launches_attempted, CAST(COUNT(*) FILTER (NOT failed) AS DOUBLE) AS gk_launches_completed FROM me WHERE k = 'view' AND event_id % 60 >= 40 AND user_id % 50 = 0 GROUP BY ALL""",
)
def keeper_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = match_events(spark, sf_dir)
    return events.keeper_distribution(ev, ev.select("match_id", F.col("player.id").alias("player_id")).where("player_id % 50 = 0"))


GAIN = "(sqrt(pow(120 - x, 2) + pow(40 - y, 2)) - sqrt(pow(120 - x2, 2) + pow(40 - y2, 2))) * 0.9144::DOUBLE"
PROGRESSIVE = f"CASE WHEN x < 60 AND x2 < 60 THEN {GAIN} >= 30 WHEN (x < 60) <> (x2 < 60) THEN {GAIN} >= 15 ELSE {GAIN} >= 10 END"


@query("progressive_receptions", f"WITH {ME} SELECT match_id, user_id + 1 AS player_id, CAST(COUNT(*) AS DOUBLE) AS progressive_receptions FROM me WHERE k = 'view' AND NOT failed AND {PROGRESSIVE} GROUP BY ALL")
def progressive_receptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.receptions(match_events(spark, sf_dir))


@query(
    "successful_pressures",
    f"""WITH {ME}, p AS (SELECT * FROM me WHERE k = 'signup'), o AS (SELECT match_id, i, mi * 60 + se AS t, team FROM me WHERE k IN ('view', 'click', 'purchase'))
    SELECT p.match_id, p.user_id AS player_id, CAST(COUNT(DISTINCT (p.i, p.user_id)) AS DOUBLE) AS pressures_successful FROM p JOIN o ON p.match_id = o.match_id AND p.team = o.team AND o.i > p.i AND o.t <= p.mi * 60 + p.se + 5 GROUP BY ALL""",
)
def successful_pressures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.successful_pressures(match_events(spark, sf_dir))


@query(
    "possession_shares",
    f"""WITH {ME}, g AS (SELECT match_id, team, lead(mi * 60 + se) OVER (PARTITION BY match_id ORDER BY i) - (mi * 60 + se) AS gap FROM me), h AS (SELECT match_id, team, CAST(SUM(gap) AS DOUBLE) AS s FROM g WHERE gap > 0 AND gap <= 60 GROUP BY ALL)
    SELECT match_id, CASE team WHEN 0 THEN 'even' ELSE 'odd' END AS team, round_even(100.0::DOUBLE * s / SUM(s) OVER (PARTITION BY match_id), 6) AS possession FROM h""",
)
def possession_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.possession_shares(match_events(spark, sf_dir)).withColumn("possession", round_even(F.col("possession"), 6))
