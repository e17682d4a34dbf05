"""A platform over the player-seasons, its questions, links between sources, and readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import cosine, round_even
from ..operators import aggregates, assembly, joins, models, naming, positions, ranking, recruit
from ..platform import Platform
from ..scratch import held
from ..sources import feeds, readers
from .adapters import PS, player_seasons, table
from .catalog import query
from .queries_features import CATS, FIT, WEIGHTS, pct, scored

METRICS = ("shots", "goals", "passes", "tackles")
BASKETS = {"Attack": ("shots", "goals"), "Build Up": ("passes",), "Defence": ("tackles",)}
G = "position_group"
_Z = ", ".join(f"({m} - AVG({m}) OVER (PARTITION BY {G})) / COALESCE(NULLIF(stddev_pop({m}) OVER (PARTITION BY {G}), 0), 1) AS z_{m}" for m in METRICS)
POOL = f"""{PS}, pool AS (SELECT *, player_id || '|' || season AS row_key FROM ps WHERE mins >= 100), pz AS (SELECT *, {_Z}, {', '.join(f'{pct(m)} AS pct_{m}' for m in METRICS)} FROM pool),
  pv AS (SELECT *, [{', '.join(f'z_{m} * 0.5::DOUBLE' for m in METRICS)}] AS v, round_even((pct_shots + pct_goals) / 2, 1) AS cat_attack, round_even(pct_passes, 1) AS cat_build_up, round_even(pct_tackles, 1) AS cat_defence FROM pz),
  me AS (SELECT * FROM pv ORDER BY mins DESC, player_id, season LIMIT 1)"""
_D = "round_even(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
_SIM = "round_even(GREATEST(LEAST((1 - distance) * 100, 100), 0), 1)"


def platform(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, ranked: bool = True) -> Platform:
    """Player-seasons of 100 minutes and more, as the tables' quantities are smaller; from ``rows``, where the caller holds them already."""
    return Platform.build(held(player_seasons(spark, sf_dir)) if rows is None else rows, list(METRICS), BASKETS, min_minutes=100, ranked=ranked)


def _somebody(p: Platform) -> tuple:
    """The row of most minutes."""
    r = p.pool.orderBy(F.desc("minutes"), "player_id", "season").select("player_id", "season").first()
    return r["player_id"], r["season"]


NEAR = f"{POOL}, n AS (SELECT a.*, {_D} AS distance FROM pv a, me b WHERE a.{G} = b.{G} AND a.player_id <> b.player_id), s AS (SELECT *, row_number() OVER (ORDER BY distance, row_key) AS rank, {_SIM} AS similarity FROM n)"


@query("platform_similar", f"WITH {NEAR} SELECT CAST(rank AS INT) AS rank, row_key, similarity FROM s WHERE rank <= 10")
def platform_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform(spark, sf_dir)
    return p.similar(*_somebody(p), 10).select("rank", "row_key", "similarity")


@query(
    "platform_replacements",
    f"""WITH {NEAR}, f AS (SELECT player_id, row_key, {FIT} AS fit, (SELECT {FIT} FROM me) AS mine, similarity FROM s WHERE rank <= 60), c AS (SELECT *, round_even(0.6::DOUBLE * similarity + (1 - 0.6::DOUBLE) * fit, 1) AS score FROM f),
    o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY score DESC, row_key) = 1) SELECT row_key, score, round_even(fit - mine, 1) AS fit_delta FROM o ORDER BY score DESC, row_key LIMIT 10""",
)
def platform_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty nearest, ranked again by similarity and fit, each player once."""
    p = platform(spark, sf_dir)
    return p.replacements(*_somebody(p), WEIGHTS, 10).select("row_key", "score", "fit_delta")


@query("platform_pair", f"WITH {POOL} SELECT a.row_key, {_SIM.replace('distance', _D)} AS similarity FROM pv a, me b WHERE a.{G} = b.{G} AND a.season = b.season AND a.row_key <> b.row_key AND a.team = b.team")
def platform_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like his mates of the group somebody is: pairs asked for one by one are few, so all of a team are compared at once."""
    p = platform(spark, sf_dir)
    me = p.row(*_somebody(p)).select(F.col("row_key").alias("_me"), F.col("vector").alias("_v"), G, "season", "team")
    mates = p.pool.join(me, [G, "season", "team"]).where("row_key <> _me")
    return mates.select("row_key", models.similarity_percent(round_even(1.0 - cosine(F.col("vector"), F.col("_v")), 6)).alias("similarity"))


@query(
    "platform_project",
    f"""WITH {POOL}, new AS (SELECT * FROM ps WHERE mins >= 50 AND mins < 100), sc AS (SELECT {G}, {', '.join(f'AVG({m}) AS a_{m}, COALESCE(NULLIF(stddev_pop({m}), 0), 1) AS s_{m}' for m in METRICS)} FROM pool GROUP BY {G}),
    q AS (SELECT new.*, {', '.join(f"round_even((SELECT 100.0::DOUBLE * (COUNT(*) FILTER (r.{m} < new.{m}) + COUNT(*) FILTER (r.{m} = new.{m}) / 2.0::DOUBLE + 1) / (COUNT(*) + 1) FROM pool r WHERE r.{G} = new.{G} AND r.season = new.season), 1) AS pct_{m}" for m in METRICS)} FROM new)
    SELECT player_id, season, pct_shots, pct_tackles, round_even((pct_shots + pct_goals) / 2, 1) AS cat_attack, round_even((shots - a_shots) / s_shots, 5) AS z_shots FROM q JOIN sc USING ({G})""",
)
def platform_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of fewer minutes on the regulars' scale, each as if he alone joined them."""
    rows = held(player_seasons(spark, sf_dir))
    p, new = platform(spark, sf_dir, rows), rows.where("minutes >= 50 AND minutes < 100")
    return p.project(new).select("player_id", "season", "pct_shots", "pct_tackles", "cat_attack", round_even(F.col("z_shots"), 5).alias("z_shots"))


@query(
    "platform_own_seasons",
    f"""WITH {POOL}, d AS (SELECT a.{G}, a.row_key AS q, b.row_key AS k, {_D} AS distance, a.player_id = b.player_id AS own FROM pv a JOIN pv b ON a.{G} = b.{G} AND a.row_key <> b.row_key), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, k) AS rank FROM d), o AS (SELECT * FROM r WHERE own),
    n AS (SELECT {G}, CAST(COUNT(*) - 1 AS BIGINT) AS candidates FROM pv GROUP BY {G})
    SELECT {G}, CAST(COUNT(*) AS BIGINT) AS tested, candidates, round_even(AVG(CAST(rank <= 10 AS DOUBLE)), 3) AS hit_rate, round_even(10.0::DOUBLE / candidates, 3) AS chance, round_even(AVG(CAST(rank <= 10 AS DOUBLE)) / (10.0::DOUBLE / candidates), 1) AS lift, CAST(floor(median(rank)) AS INT) AS median_rank
    FROM o JOIN n USING ({G}) GROUP BY {G}, candidates""",
)
def platform_own_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well all seasons of a player find each other, by exact ranks."""
    return platform(spark, sf_dir, ranked=False).own_seasons()


@query("platform_team_profile", f"WITH {POOL} SELECT pv.team, pv.season, round_even(SUM(pv.cat_attack * pv.mins) / SUM(pv.mins), 4) AS team_mean, (SELECT round_even(median(l.cat_attack), 4) FROM pv l, me WHERE l.season = me.season AND l.league = me.league) AS league_median FROM pv, me WHERE pv.team = me.team AND pv.season = me.season GROUP BY ALL")
def platform_team_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform(spark, sf_dir)
    me = p.row(*_somebody(p)).select("team", "season").first()
    found = p.team_profile(me["team"], me["season"], "cat_attack")
    return found.select(F.lit(me["team"]).alias("team"), F.lit(me["season"]).alias("season"), round_even(F.col("team_mean"), 4).alias("team_mean"), round_even(F.col("league_median"), 4).alias("league_median"))


@query("platform_labels", f"WITH {POOL} SELECT row_key, player_id || ' - ' || team || ' (' || {G} || ', ' || season || ')' AS label FROM pool")
def platform_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform(spark, sf_dir).labels()


@query("platform_peers", f"WITH {POOL} SELECT p.row_key FROM pool p, me WHERE p.{G} = me.{G} AND p.season = me.season")
def platform_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform(spark, sf_dir)
    return p.peers_of(*_somebody(p)).select("row_key")


@query("platform_squad", f"WITH {POOL} SELECT p.row_key, p.mins AS minutes FROM pool p, me WHERE p.team = me.team AND p.season = me.season")
def platform_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform(spark, sf_dir)
    me = p.row(*_somebody(p)).select("team", "season").first()
    return p.squad(me["team"], me["season"]).select("row_key", "minutes")


@query("platform_strengths", f"WITH {POOL}, l AS (SELECT row_key, metric, pct FROM (SELECT row_key, pct_shots AS shots, pct_goals AS goals, pct_passes AS passes, pct_tackles AS tackles FROM pv WHERE row_key = (SELECT row_key FROM me)) UNPIVOT (pct FOR metric IN (shots, goals, passes, tackles))) SELECT metric, pct, 'strength' AS kind FROM (SELECT * FROM l WHERE pct >= 70 ORDER BY pct DESC, metric LIMIT 5) UNION ALL SELECT metric, pct, 'weakness' FROM (SELECT * FROM l WHERE pct <= 30 ORDER BY pct, metric LIMIT 5)")
def platform_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform(spark, sf_dir)
    one = _somebody(p)
    return p.strengths(*one).select("metric", "pct", F.lit("strength").alias("kind")).union(p.weaknesses(*one).select("metric", "pct", F.lit("weakness")))


@query("platform_cheaper", f"WITH {POOL}, n AS (SELECT a.row_key, {_D} AS distance FROM pv a, me b WHERE a.{G} = b.{G} AND a.player_id <> b.player_id AND a.value <= b.value / 2 AND a.age <= b.age - 3) SELECT row_key, CAST(row_number() OVER (ORDER BY distance, row_key) AS INT) AS rank, distance FROM n QUALIFY rank <= 10")
def platform_cheaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like him, for less: the nearest at half his price or less and three years younger."""
    p = platform(spark, sf_dir)
    return p.cheaper_like(*_somebody(p)).select("row_key", "rank", "distance")


@query("platform_findings", f"WITH {POOL} SELECT player_id, season, 'small_sample' AS finding FROM pv WHERE mins < 1350 UNION ALL SELECT player_id, season, 'profile' FROM pv UNION ALL SELECT player_id, season, CASE WHEN GREATEST(cat_attack, cat_build_up, cat_defence) >= 75 THEN 'ready_young' ELSE 'raw_young' END FROM pv WHERE age <= 21 UNION ALL SELECT player_id, season, 'veteran' FROM pv WHERE age >= 30")
def platform_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform(spark, sf_dir).findings().select("player_id", "season", "finding")


# --- hidden gems, all seven components -------------------------------------------------------

GEM = f"""{CATS}, b AS (SELECT *, player_id || '|' || season AS row_key, {FIT} AS perf, CASE league WHEN 'EUROPE' THEN 1.0::DOUBLE WHEN 'AMERICA' THEN 0.9 WHEN 'ASIA' THEN 0.8 ELSE 0.7 END AS st, [shots, goals, tackles] AS x FROM ca WHERE mins >= 200),
  u AS (SELECT row_key, AVG(d) AS u FROM (SELECT a.row_key, round_even(list_distance(a.x, c.x), 6) AS d, c.row_key AS k FROM b a JOIN b c ON a.{G} = c.{G} AND a.row_key <> c.row_key QUALIFY row_number() OVER (PARTITION BY a.row_key ORDER BY d, k) <= 15) GROUP BY row_key),
  s AS (SELECT {G} FROM b GROUP BY {G} HAVING COUNT(*) > 16), w AS (SELECT b.*, CASE WHEN s.{G} IS NOT NULL THEN u END AS far, CASE WHEN value > 0 THEN perf / value END AS per, CASE WHEN value > 0 THEN log10(value) END AS y, 1 AS one FROM b LEFT JOIN u USING (row_key) LEFT JOIN s ON b.{G} = s.{G}),
  ln AS (SELECT {G}, regr_slope(y, perf) AS sl, regr_intercept(y, perf) AS ic FROM w WHERE y IS NOT NULL GROUP BY {G} HAVING COUNT(*) >= 30 AND MAX(perf) - MIN(perf) > 1e-9), r AS (SELECT w.*, round_even(y - (ic + sl * perf), 9) AS res FROM w LEFT JOIN ln USING ({G})),
  c AS (SELECT *, {pct('far', G)} AS uniq, {pct('per', 'one')} AS vfm, CASE WHEN res IS NOT NULL THEN round_even((1 - {pct('res', 'one').split('round_even(')[1].split(', 1)')[0]} / 100) * 100, 1) END AS under FROM r)"""


@query(
    "hidden_gem_all",
    f"""WITH {GEM}, k AS (SELECT player_id, season, uniq, vfm, under, perf, round_even(GREATEST(LEAST(100.0::DOUBLE * (27 - age) / 8.0::DOUBLE, 100), 0), 1) AS up, round_even(GREATEST(LEAST(100.0::DOUBLE * (mins / 1800.0::DOUBLE), 100), 0), 1) AS sz,
      round_even(100.0::DOUBLE * ((SELECT MAX(st) FROM b) - st) / ((SELECT MAX(st) FROM b) - (SELECT MIN(st) FROM b)), 1) AS ex FROM c)
    SELECT player_id, season, uniq, under, round_even((perf * 40 + up * 20 + COALESCE(under * 20, 0) + ex * 15 + COALESCE(vfm * 15, 0) + COALESCE(uniq * 15, 0) + sz * 10) / (85 + CASE WHEN under IS NULL THEN 0 ELSE 20 END + CASE WHEN vfm IS NULL THEN 0 ELSE 15 END + CASE WHEN uniq IS NULL THEN 0 ELSE 15 END), 1) AS hidden_gem_score FROM k""",
)
def hidden_gem_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output, youth, exposure, sample, price for that output, value for money and how unusual a profile is; each player over the components that he has."""
    strength = F.when(F.col("league") == "EUROPE", 1.0).when(F.col("league") == "AMERICA", 0.9).when(F.col("league") == "ASIA", 0.8).otherwise(0.7)
    rows = scored(spark, sf_dir).where("minutes >= 200").withColumns({"row_key": F.concat_ws("|", "player_id", "season"), "perf": recruit.fit_score(WEIGHTS), "st": strength, "x": F.array("shots", "goals", "tackles")})
    rows = held(recruit.exposure(rows, "st", "ex"))
    far = models.uniqueness(rows, "row_key", "x", G)
    rows = ranking.percentiles(rows.join(far, "row_key", "left"), "mean_distance", [G], "uniq")
    rows = recruit.price_line(recruit.value_for_money(rows, "perf", "value", "vfm"), "perf", "value", G)
    rows = rows.withColumns({"up": recruit.age_upside(F.col("age")), "sz": recruit.sample_size(F.col("minutes"))})
    parts = {"Performance": "perf", "Age upside": "up", "Underpriced for output": "value_residual_pct", "Low exposure": "ex", "Value for money": "vfm", "Statistical uniqueness": "uniq", "Sample size": "sz"}
    return rows.select("player_id", "season", "uniq", F.col("value_residual_pct").alias("under"), recruit.gem_score(parts).alias("hidden_gem_score"))


# --- the same people in two sources ----------------------------------------------------------


def _letters(n: Column) -> Column:
    """A word from a number: its digits as letters."""
    return F.translate((n + 10_000).cast("string"), "0123456789", "abcdefghij")


_L = "translate(CAST({} + 10000 AS VARCHAR), '0123456789', 'abcdefghij')"
WHO = f"""who AS (SELECT c_custkey AS k, {_L.format('(c_custkey * 31) % 9973')} AS first, {_L.format('(c_custkey * 17) % 97')} AS last, {_L.format('n_nationkey')} AS nation, r_name AS region, 400 + (c_custkey * 13) % 2500 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _who(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a first and a last name made from their number; last names are shared by many."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c, k = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    return c.select(k.alias("k"), _letters(k * 31 % 9973).alias("first"), _letters(k * 17 % 97).alias("last"), _letters(F.col("n_nationkey")).alias("nation"), F.col("r_name").alias("region"), (400 + k * 13 % 2500).alias("m"))


LINK = f"""{WHO}, ours AS (SELECT 'p' || k AS player_id, 2020 + s AS season, region AS league, m::DOUBLE AS mins, first || ' ' || last AS key, substr(first, 1, 1) || ' ' || last AS short, [first, last] AS ws, nation FROM who, range(2) r(s) WHERE s = 0 OR k % 2 = 0),
  theirs AS (SELECT k + 100000 AS tm_id, 2020 + s AS season, region AS league, (m + CASE WHEN k % 10 = 3 THEN 700 ELSE 40 END)::DOUBLE AS tm_mins, CASE k % 4 WHEN 0 THEN substr(first, 1, 1) || ' ' || last WHEN 2 THEN first || ' x' || last ELSE first || ' ' || last END AS tm_key,
    CASE k % 4 WHEN 0 THEN [substr(first, 1, 1), last] WHEN 2 THEN [first, 'x' || last] ELSE [first, last] END AS tm_ws, nation AS tm_nation FROM who, range(2) r(s) WHERE s = 0 OR k % 3 > 0),
  t2 AS (SELECT *, substr(tm_key, 1, 1) || ' ' || split_part(tm_key, ' ', 2) AS tm_short FROM theirs),
  e AS (SELECT player_id, season, tm_id, 1 AS exact, CAST(nation = tm_nation AS INT) AS same_club, abs(mins - tm_mins) AS gap FROM ours JOIN t2 USING (season, league) WHERE key = tm_key UNION ALL
    SELECT player_id, season, tm_id, 0, 1, abs(mins - tm_mins) FROM ours JOIN t2 USING (season, league) WHERE short = tm_short AND nation = tm_nation),
  b1 AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY exact DESC, same_club DESC, gap, tm_id) = 1),
  lo AS (SELECT player_id, o.season, tm_id, 0 AS exact, 1 AS same_club, abs(mins - tm_mins) AS gap FROM ours o JOIN t2 USING (season, league) WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.player_id = o.player_id AND b1.season = o.season) AND list_has_any(list_filter(ws, lambda w: len(w) >= 4), list_filter(tm_ws, lambda w: len(w) >= 4))
    AND nation = tm_nation AND abs(mins - tm_mins) <= 0.15::DOUBLE * GREATEST(mins, tm_mins, 600)),
  best AS (SELECT * FROM b1 UNION ALL SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY exact DESC, same_club DESC, gap, tm_id) = 1), v AS (SELECT player_id, tm_id, COUNT(*) AS votes, SUM(exact) AS exact FROM best GROUP BY ALL),
  k AS (SELECT *, row_number() OVER w AS r, lead((votes, exact)) OVER w AS nx FROM v WINDOW w AS (PARTITION BY player_id ORDER BY votes DESC, exact DESC, tm_id)), c AS (SELECT * FROM k WHERE r = 1 AND (nx IS NULL OR nx <> (votes, exact)))"""


@query("players_linked", f"WITH {LINK} SELECT player_id, tm_id FROM c QUALIFY COUNT(*) OVER (PARTITION BY tm_id) = 1")
def players_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of the same people, one of which shortens some names, changes others and counts minutes otherwise."""
    w = _who(spark, sf_dir)
    seasons = lambda keep: w.withColumn("s", F.explode(F.when(keep, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ours = seasons(F.col("k") % 2 == 0).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("player_id"), F.concat_ws(" ", "first", "last").alias("player"), (2020 + F.col("s")).alias("season"), F.col("region").alias("league"), F.concat("nation", F.lit(" FC")).alias("team"), F.col("m").cast("double").alias("minutes"))
    initial, k = F.substring("first", 1, 1), F.col("k") % 4
    name = F.when(k == 0, F.concat(initial, F.lit(". "), "last")).when(k == 2, F.concat("first", F.lit(" x"), "last")).otherwise(F.concat_ws(" ", "first", "last"))
    theirs = seasons(F.col("k") % 3 > 0).select((F.col("k") + 100_000).alias("tm_id"), name.alias("name"), (2020 + F.col("s")).alias("season"), F.col("region").alias("league"), F.col("nation").alias("club"), (F.col("m") + F.when(F.col("k") % 10 == 3, 700).otherwise(40)).cast("double").alias("minutes"))
    return joins.link_players(ours, theirs)


ABROAD = f"""{WHO}, me AS (SELECT 'p' || k AS player_id, season, CAST(season[1:4] AS INT) + 1 AS year, CASE WHEN k % 11 = 0 THEN '' ELSE lower(nation) END AS country, CASE WHEN k % 5 = 0 THEN first ELSE first || ' ' || last END AS name, first || ' ' || last || ' ' || {_L.format('k % 7')} AS fn
    FROM who, (SELECT unnest(['2020-21', '2022-23']) AS season)),
  tm AS (SELECT k + 100000 AS tm_id, CASE k % 3 WHEN 0 THEN first || ' ' || last WHEN 1 THEN first || ' ' || {_L.format('k % 7')} ELSE {_L.format('(k * 7) % 9973')} || ' ' || last END AS tm_key, lower(nation) AS tm_country, CASE WHEN k % 13 > 0 THEN 1975 + k % 35 END AS born FROM who),
  named AS (SELECT DISTINCT player_id, season, year, country, unnest([name, fn]) AS tm_key FROM me), able AS (SELECT 1),
  x1 AS (SELECT player_id, season, MIN(tm_id) AS tm_id, 'name' AS how FROM named JOIN tm USING (tm_key) WHERE year - born BETWEEN 16 AND 42 AND (country = tm_country OR country = '' OR tm_country = '') GROUP BY player_id, season HAVING COUNT(DISTINCT tm_id) = 1),
  rest AS (SELECT * FROM me WHERE player_id NOT IN (SELECT player_id FROM x1)), bw AS (SELECT r.player_id, r.season, t.tm_id FROM rest r JOIN tm t ON r.country = t.tm_country AND list_has_all(list_concat(string_split(r.name, ' '), string_split(r.fn, ' ')), string_split(t.tm_key, ' ')) WHERE year - born BETWEEN 16 AND 42),
  x2 AS (SELECT player_id, season, MIN(tm_id) AS tm_id, 'words' AS how FROM bw GROUP BY ALL HAVING COUNT(DISTINCT tm_id) = 1), lf AS (SELECT * FROM rest WHERE (player_id, season) NOT IN (SELECT (player_id, season) FROM bw)),
  x3 AS (SELECT l.player_id, l.season, MIN(tm_id) AS tm_id, 'surname' AS how FROM lf l JOIN tm t ON l.country = t.tm_country AND string_split(l.name, ' ')[-1] = string_split(t.tm_key, ' ')[-1] WHERE len(string_split(l.name, ' ')[-1]) >= 4 AND year - born BETWEEN 16 AND 42 GROUP BY l.player_id, l.season HAVING COUNT(DISTINCT tm_id) = 1),
  f AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3), v AS (SELECT player_id, tm_id, COUNT(*) AS n, arg_min(how, season) AS how FROM f GROUP BY ALL), top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY n DESC, tm_id) = 1),
  lk AS (SELECT player_id, tm_id, how FROM top QUALIFY COUNT(*) OVER (PARTITION BY tm_id) = 1)"""


def _internationals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w, k = held(_who(spark, sf_dir)), F.col("k")
    ours = w.withColumn("season", F.explode(F.array(F.lit("2020-21"), F.lit("2022-23")))).select(
        F.concat(F.lit("p"), k.cast("string")).alias("player_id"), F.when(k % 5 == 0, F.col("first")).otherwise(F.concat_ws(" ", "first", "last")).alias("player"), F.concat_ws(" ", "first", "last", _letters(k % 7)).alias("full_name"), "season",
        F.when(k % 11 > 0, F.col("nation")).alias("nationality"), F.col("m").cast("double").alias("minutes"),
    )
    name = F.when(k % 3 == 0, F.concat_ws(" ", "first", "last")).when(k % 3 == 1, F.concat_ws(" ", "first", _letters(k % 7))).otherwise(F.concat_ws(" ", _letters(k * 7 % 9973), "last"))
    profiles = w.select((k + 100_000).alias("tm_id"), name.alias("name"), F.col("nation").alias("nationality"), F.when(k % 13 > 0, F.concat((1975 + k % 35).cast("string"), F.lit("-07-01"))).alias("date_of_birth"))
    return ours, profiles


@query("internationals_linked", f"WITH {ABROAD} SELECT * FROM lk")
def internationals_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tournament players and profiles: by name, by words of the name, by surname, as country and age allow."""
    return assembly.link_internationals(*_internationals(spark, sf_dir))


@query(
    "link_coverage",
    f"""WITH {ABROAD}, j AS (SELECT me.*, m, tm_id, how FROM me JOIN (SELECT 'p' || k AS player_id, m FROM who) USING (player_id) LEFT JOIN lk USING (player_id)) SELECT CAST(COUNT(*) AS BIGINT) AS players, round_even(AVG(CAST(tm_id IS NOT NULL AS DOUBLE)), 4) AS matched, round_even(SUM(m) FILTER (tm_id IS NOT NULL) / SUM(m), 4) AS minutes_covered,
    CAST(COUNT(*) FILTER (how = 'words') AS BIGINT) AS by_words, CAST(COUNT(*) FILTER (how = 'surname') AS BIGINT) AS by_surname, round_even(AVG(CAST(tm_id IS NOT NULL AS DOUBLE)) FILTER (m >= 270), 4) AS regulars_matched FROM j""",
)
def link_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, profiles = _internationals(spark, sf_dir)
    return assembly.link_coverage(ours.join(assembly.link_internationals(ours, profiles), "player_id", "left"))


_SAME = "(len(a) = 0 OR len(b) = 0 OR CASE WHEN len(a) <= len(b) THEN list_has_all(b, a) ELSE list_has_all(a, b) END)"


@query(
    "other_people_withdrawn",
    f"""WITH {WHO}, l AS (SELECT k, [first, last] AS a, CASE k % 3 WHEN 0 THEN [last] WHEN 1 THEN [first, last, 'junior'] ELSE ['other', last] END AS b, 1990 + k % 5 AS born, 1990 + k % 7 AS theirs FROM who) SELECT k, CASE WHEN NOT (abs(born - theirs) >= 2 AND NOT {_SAME}) THEN k * 2 END AS height FROM l""",
)
def other_people_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came with a link goes where both the year of birth and the name are another's."""
    k = F.col("k")
    other = F.when(k % 3 == 0, F.col("last")).when(k % 3 == 1, F.concat("first", F.lit(" "), "last", F.lit(" Junior"))).otherwise(F.concat(F.lit("Other "), "last"))
    rows = _who(spark, sf_dir).select("k", F.concat_ws(" ", "first", "last").alias("name"), other.alias("theirs"), (1990 + k % 5).alias("born"), (1990 + k % 7).alias("linked_born"), (k * 2).alias("height"))
    return positions.without_other_people(rows, "born", "linked_born", "name", "theirs", ["height"]).select("k", "height")


@query(
    "wrong_positions_withdrawn",
    f"""WITH {WHO}, l AS (SELECT k, [first, last] AS a, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN ['x' || first, last] ELSE [first, last] END AS b, CASE k % 3 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' ELSE 'FW' END AS g, CASE k % 5 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF,MF' WHEN 2 THEN 'FW' WHEN 3 THEN 'MF' ELSE '' END AS r FROM who),
    t AS (SELECT *, CASE WHEN r = '' THEN true WHEN (g = 'GK') <> (r = 'GK') THEN false WHEN g = 'GK' THEN true WHEN g = 'CB' THEN r IN ('DF,MF', 'MF') ELSE r IN ('FW', 'MF', 'DF,MF') END AS fits FROM l) SELECT k, CASE WHEN NOT (b IS NOT NULL AND NOT {_SAME} AND NOT fits) THEN k END AS height FROM t""",
)
def wrong_positions_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose address names another and whose position isn't among the listed roles or next to them."""
    k = F.col("k")
    url = F.when(k % 4 < 3, F.concat(F.when(k % 2 == 0, "x").otherwise(""), "first", F.lit("-"), "last"))
    group = F.when(k % 3 == 0, "GK").when(k % 3 == 1, "CB").otherwise("FW")
    listed = F.when(k % 5 == 0, "GK").when(k % 5 == 1, "DF,MF").when(k % 5 == 2, "FW").when(k % 5 == 3, "MF").otherwise("")
    rows = _who(spark, sf_dir).select("k", F.concat_ws(" ", "first", "last").alias("name"), url.alias("url"), group.alias("g"), listed.alias("listed"), k.alias("height"))
    return positions.without_wrong_links(rows, F.col("g"), "listed", "name", "url", ["height"]).select("k", "height")


# --- readers and feeds -----------------------------------------------------------------------


@query(
    "valuations_merged",
    """WITH a AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, o_totalprice - 50000 AS v, 0 AS f FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice, 1 FROM orders), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT id AS tm_id, CAST(d AS VARCHAR) AS date, v AS value FROM u WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY id, d ORDER BY f, v DESC) = 1""",
)
def valuations_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histories of values: one a day, the first feed's where it has one above 0."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tm_id"), F.to_date("o_orderdate").cast("string").alias("date"), "o_orderkey", "o_totalprice")
    both = readers.valuations(o.where("o_orderkey % 2 = 0").withColumn("value", (F.col("o_totalprice") - 50_000).cast("string")), o.withColumn("value", F.col("o_totalprice").cast("string")))
    return both.withColumn("date", F.col("date").cast("string"))


@query(
    "profiles_first_known",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal ELSE c_acctbal + 1 END AS height, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN c_mktsegment ELSE c_name END AS foot FROM customer",
)
def profiles_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a person with, in each column, the first feed's known value."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    first = c.where("c_custkey % 3 > 0").select(k.alias("id"), F.col("c_acctbal").alias("height"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("foot"))
    return readers.first_known([first, c.select(k.alias("id"), (F.col("c_acctbal") + 1).alias("height"), F.col("c_name").alias("foot"))], "id")


@query("market_enriched", f"""WITH {WHO}, f AS (SELECT k, first || ' ' || last AS name, k % 2 AS season, CASE WHEN k % 4 > 0 THEN m END AS value FROM who), g AS (SELECT name, season, ANY_VALUE(v) AS v FROM (SELECT first || ' ' || last AS name, k % 2 AS season, CASE WHEN k % 3 > 0 THEN m * 10 END AS v FROM who WHERE k % 7 > 0) GROUP BY ALL HAVING COUNT(*) = 1)
    SELECT k, CAST(COALESCE(v, value) AS BIGINT) AS value FROM f LEFT JOIN g USING (name, season)""")
def market_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market values by name and season where the name is unique there; a known one wins."""
    w, k = _who(spark, sf_dir), F.col("k")
    mine = w.select("k", F.upper(F.concat_ws(" ", "first", "last")).alias("player"), (k % 2).alias("season"), F.when(k % 4 > 0, F.col("m")).alias("value"))
    market = w.where("k % 7 > 0").select(F.concat_ws(" ", "first", "last").alias("player"), (k % 2).alias("season"), F.when(k % 3 > 0, F.col("m") * 10).alias("value"))
    return readers.enriched(mine, market, ["value"]).select("k", F.col("value").cast("long").alias("value"))


@query("main_position", "WITH w AS (SELECT o_custkey AS k, o_orderpriority AS p, SUM(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT k, arg_min(p, (-m, p)) AS position FROM w GROUP BY k")
def main_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of most minutes of every player; ties by name."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return aggregates.main_value(met.select(F.col("o_custkey").alias("k"), "o_orderpriority", "l_quantity"), ["k"], "o_orderpriority", "l_quantity", "position")


@query("position_minutes_merged", "WITH w AS (SELECT o_custkey AS k, o_orderpriority AS p, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY ALL) SELECT k, string_agg(p || '=' || n, ',' ORDER BY p) AS positions FROM w GROUP BY k")
def position_minutes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of a key added up entry by entry."""
    maps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.create_map("o_orderpriority", F.lit(1)).alias("m"))
    merged = aggregates.merged_map(maps, ["k"], "m", "m")
    return merged.select("k", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("positions"))


@query("group_counts", f"WITH {PS} SELECT position_group, team, n, round_even(n::DOUBLE / SUM(n) OVER (PARTITION BY position_group), 6) AS share FROM (SELECT position_group, team, CAST(COUNT(*) AS BIGINT) AS n FROM ps GROUP BY ALL)")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each role a group has, and their share."""
    counted = aggregates.value_counts(player_seasons(spark, sf_dir), "position_group", "team")
    return counted.withColumn("share", round_even(F.col("share"), 6))


@query(
    "aggregate_feed",
    """WITH raw AS (SELECT o_custkey AS player_id, c_mktsegment AS team, n_name AS lg, year(o_orderdate) AS y, COUNT(*) AS games, SUM(l_quantity) AS mins, COUNT(*) FILTER (l_returnflag = 'R') AS goals FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    two AS (SELECT * REPLACE (team || ' A' AS team) FROM raw UNION ALL SELECT * REPLACE (team || ' B' AS team, mins / 2 AS mins, 1 AS games) FROM raw WHERE player_id % 5 = 0), live AS (SELECT * REPLACE (goals + 1 AS goals) FROM two WHERE y = 2000), b AS (SELECT * FROM two WHERE y <> 2000 UNION ALL SELECT * FROM live),
    k AS (SELECT * FROM b WHERE lg IN ('NATION_1', 'NATION_2', 'NATION_3'))
    SELECT CAST(player_id AS VARCHAR) AS player_id, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, arg_min(team, (-mins, team)) AS team, CAST(SUM(goals) AS DOUBLE) AS goals, CAST(SUM(mins) AS DOUBLE) AS minutes, CAST(COUNT(DISTINCT team) AS BIGINT) AS clubs FROM k GROUP BY player_id, y""",
)
def aggregate_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of season aggregates, a row a club, with a season that was fetched since: read to player-seasons."""
    t = lambda name: table(spark, sf_dir, name)
    met = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = held(met.groupBy("o_custkey", F.col("c_mktsegment").alias("team"), F.col("n_name").alias("league"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("games"), F.sum("l_quantity").alias("time"), F.count_if(F.col("l_returnflag") == "R").alias("goals")))
    one = per.withColumn("team", F.concat("team", F.lit(" A")))
    both = one.unionByName(per.where("o_custkey % 5 = 0").withColumns({"team": F.concat("team", F.lit(" B")), "time": F.col("time") / 2, "games": F.lit(1).cast("long")}))
    raw = both.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("player"), "team", "league", F.concat("y", F.lit("/"), F.col("y") + 1).alias("season"), *[F.col(c).cast("string").alias(c) for c in ("games", "time", "goals")])
    live = raw.where("startswith(season, '2000')").withColumn("goals", (F.col("goals").cast("int") + 1).cast("string"))
    place = F.struct(F.lit("MID").alias("group"), F.lit("CM").alias("position"), F.lit("feed").alias("source"))
    rows, _ = feeds.aggregate_feed(raw, {c: c.title() for c in ("NATION_1", "NATION_2", "NATION_3")}, {"id": "player_id", "time": "minutes", "games": "matches"}, place, live=live, in_progress=True)
    return rows.select("player_id", "season", "team", "goals", "minutes", F.col("clubs_in_season").alias("clubs"))


@query("profile_cleaning", "SELECT c_custkey AS tm_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 185.0 ELSE 190.0 END AS height_cm, c_mktsegment AS nationality, c_name AS detail FROM customer")
def profile_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as a site writes them, cleaned: names without ids, first nationality, last part of a position, heights in centimetres."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = c.select(
        k.cast("string").alias("player_id"), F.concat("c_name", F.lit(" ("), k.cast("string"), F.lit(")")).alias("player_name"), F.lit("1999-05-01").alias("date_of_birth"), F.when(k % 2 == 0, "1,85 m").otherwise("190").alias("height"), F.lit("left").alias("foot"),
        F.concat("c_mktsegment", F.lit("   Other")).alias("citizenship"), F.lit("Midfield").alias("main_position"), F.concat_ws(" - ", "c_mktsegment", "c_name").alias("position"),
    )
    return feeds.profile_rows(raw).select("tm_id", "name", "height_cm", "nationality", "detail")


@query("country_names", f"SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'korea south' WHEN 1 THEN 'turkey' WHEN 2 THEN 'united states' ELSE {_L.format('n_nationkey')} END AS country FROM nation")
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by one name each, however a feed spells them."""
    n = F.col("n_nationkey")
    name = F.when(n % 4 == 0, "Korea Republic").when(n % 4 == 1, "Türkiye").when(n % 4 == 2, "USA").otherwise(F.upper(_letters(n)))
    return table(spark, sf_dir, "nation").select("n_nationkey", assembly.country(name).alias("country"))


@query("club_tokens", f"SELECT n_nationkey, array_to_string(list_sort(list_filter(list_distinct(string_split({_L.format('n_nationkey')} || ' ' || lower(r_name), ' ')), lambda w: len(w) > 1)), ' ') AS tokens FROM nation JOIN region ON n_regionkey = r_regionkey")
def club_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that tell clubs apart."""
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.select("n_nationkey", F.array_join(F.array_sort(X.club_tokens(F.concat(F.lit("FC "), _letters(F.col("n_nationkey")), F.lit(" A "), "r_name"))), " ").alias("tokens"))


@query(
    "figures",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 100 THEN format('{:,.0f}', l_extendedprice) WHEN l_extendedprice >= 10 THEN format('{:.1f}', l_extendedprice) ELSE format('{:.2f}', l_extendedprice) END AS price, format('{:.2f}', l_discount) AS discount FROM lineitem",
)
def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a reader wants them: more digits the smaller they are."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", naming.figure(F.col("l_extendedprice")).alias("price"), naming.figure(F.col("l_discount")).alias("discount"))


@query(
    "market_value_texts",
    "SELECT o_orderkey, CASE WHEN v >= 1e6 THEN '€' || format('{:.1f}', v / 1e6) || 'm' WHEN v >= 1e3 THEN '€' || format('{:.0f}', v / 1e3) || 'k' ELSE '€' || format('{:.0f}', v) END AS text FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 7)) + 0.25::DOUBLE AS v FROM orders)",
)
def market_value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.market_value(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 7)) + 0.25).alias("text"))


@query(
    "squad_rows",
    "SELECT n_name AS club, c_custkey * 2 + i AS tm_id, c_name AS player, CASE WHEN c_custkey % 2 = 0 THEN 181.0::DOUBLE ELSE 190.0 END AS height_cm, c_mktsegment AS nationality, c_acctbal * 1e6 AS market_value_eur FROM customer JOIN nation ON c_nationkey = n_nationkey, range(2) r(i)",
)
def squad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nested squad payloads; heights in millimetres or centimetres."""
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda i: F.struct(
        (F.col("c_custkey") * 2 + i).alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, 1810.0).otherwise(190.0).alias("height"), F.array("c_mktsegment", F.lit("x")).alias("nationality"), F.col("c_acctbal").alias("value")
    )
    return readers.squad_rows(met.select(F.col("n_name").alias("club"), F.lit("2025").alias("season"), F.array(one(0), one(1)).alias("players"))).drop("season")


@query("cheaper_alternatives", f"WITH {POOL} SELECT p.row_key FROM pv p, me WHERE p.row_key <> me.row_key AND p.age <= me.age - 2 AND p.cat_attack < me.cat_attack")
def cheaper_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Younger players of weaker leagues than somebody's; a category stands for the league's strength."""
    p = platform(spark, sf_dir)
    rows = p.pool.withColumn("league_strength", F.col("cat_attack"))
    one = rows.join(p.row(*_somebody(p)).select("row_key"), "row_key")
    return recruit.cheaper_alternatives(rows, one, "row_key", 2.0, True).select("row_key")


@query("external_ids", "SELECT DISTINCT p_name AS player, 'X' || lpad(CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS VARCHAR), 5, '0') AS player_id, 50.0::DOUBLE AS team_possession, 1 AS league_tier FROM part")
def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Somebody's own table: columns renamed, defaults filled in, ids by the order of names."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("Name"), *[F.lit("x").alias(c) for c in ("position", "team", "league", "season")], F.lit(1.0).alias("minutes"), F.lit(20.0).alias("age"))
    return readers.external_table(rows, {"Name": "player"}).select("player", "player_id", "team_possession", "league_tier").distinct()


@query("season_identity", f"WITH {PS} SELECT CAST(player_id AS VARCHAR) AS player_id, team, CAST(season AS VARCHAR) AS season, mins::DOUBLE AS minutes, shots, NULL::DOUBLE AS unheard FROM ps")
def season_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written season table read with its identity columns and statistics, of which it lacks one."""
    once = held(player_seasons(spark, sf_dir))
    return readers.season_table(spark, once.inputFiles()[0].rsplit("/", 1)[0], ["shots", "unheard"]).select("player_id", "team", "season", "minutes", "shots", "unheard")


@query(
    "fantasy_feed",
    """WITH e AS (SELECT c_custkey AS id, 1990 + c_custkey % 3 + s AS y, c_nationkey AS t, 20 + c_custkey % 900 AS mins, c_custkey % 20 AS goals, c_name FROM customer, range(2) r(s)), w AS (SELECT o_custkey AS id, n_name AS team, COUNT(*) AS matches, SUM(o_orderkey % 90 + 1) AS m FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey GROUP BY ALL),
    a AS (SELECT id, SUM(matches) AS matches, COUNT(DISTINCT team) AS clubs, arg_min(team, (-m, team)) AS team FROM w GROUP BY id)
    SELECT e.id, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, CASE WHEN y = 1991 THEN COALESCE(a.team, n_name) ELSE n_name END AS team, CAST(CASE WHEN y = 1991 THEN COALESCE(matches, 0) ELSE 0 END AS BIGINT) AS matches, CAST(CASE WHEN y = 1991 THEN COALESCE(clubs, 1) ELSE 1 END AS BIGINT) AS clubs, goals::DOUBLE AS goals
    FROM e JOIN nation ON t = n_nationkey LEFT JOIN a USING (id)""",
)
def fantasy_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fantasy game's exports of several seasons with the appearances of one of them."""
    t = lambda name: table(spark, sf_dir, name)
    k = F.col("c_custkey")
    rows = t("customer").withColumn("y", F.explode(F.array(1990 + k % 3, 1991 + k % 3))).select(
        k.cast("string").alias("id"), F.col("c_name").alias("first_name"), F.lit("").alias("second_name"), F.col("c_nationkey").cast("string").alias("team"), F.lit("3").alias("element_type"), F.lit("55").alias("now_cost"), k.cast("string").alias("code"),
        (20 + k % 900).cast("string").alias("minutes"), (k % 20).cast("string").alias("goals_scored"), "y",
    )
    exports = {f"{y}-{(y + 1) % 100:02d}": rows.where(F.col("y") == y).drop("y") for y in (1990, 1991, 1992, 1993)}
    o = t("orders").join(t("nation"), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    weeks = o.select(F.col("o_custkey").alias("element"), F.col("n_name").alias("team"), (F.col("o_orderkey") % 90 + 1).alias("minutes"))
    teams = t("nation").select(F.explode(F.array(*[F.lit(s) for s in exports])).alias("season"), F.col("n_nationkey").alias("team"), F.col("n_name").alias("team_name"))
    out, _ = feeds.fantasy_feed(exports, {"1991-92": weeks}, teams, {"goals_scored": "goals", "minutes": "minutes", "code": "code"}, {3: "MID"})
    return out.select(F.substring("player_id", 4, 20).cast("long").alias("id"), "season", "team", F.col("matches").cast("long").alias("matches"), F.col("clubs_in_season").cast("long").alias("clubs"), "goals")
