"""Player-seasons, metrics, cleaning, ranks, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ratio, round_even
from ..operators import aggregates, cleaning, features, models, ranking, recruit
from ..scratch import held
from .adapters import PS, player_seasons, table
from .catalog import query

STATS = ["attempts", "completed", "shots", "goals", "tackles", "passes", "assists"]
PCT = """100.0::DOUBLE * (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (COUNT(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / COUNT({x}) OVER (PARTITION BY {by})"""


def pct(x: str, by: str = "position_group, season", flip: bool = False) -> str:
    p = PCT.format(x=x, by=by)
    return f"CASE WHEN {x} IS NOT NULL THEN round_even({'100.0 - ' if flip else ''}{p}, 1) END"


@query(
    "scan_project_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 40""",
)
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return lines.where(year & F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("player_season_agg", f"WITH {PS} SELECT * RENAME (mins AS minutes) FROM ps")
def player_season_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_seasons(spark, sf_dir)


@query(
    "league_table",
    f"""WITH {PS} SELECT league, CAST(COUNT(DISTINCT player_id) AS BIGINT) AS players, CAST(COUNT(DISTINCT season) AS BIGINT) AS seasons,
    CAST(COUNT(DISTINCT team) AS BIGINT) AS teams, SUM(mins) AS minutes FROM ps GROUP BY league""",
)
def league_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_seasons(spark, sf_dir).groupBy("league").agg(
        F.countDistinct("player_id").alias("players"), F.countDistinct("season").alias("seasons"), F.countDistinct("team").alias("teams"), F.sum("minutes").alias("minutes")
    )


@query("dedup_exact", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").dropDuplicates()


@query(
    "dedup_keep_best",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) = 1""",
)
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    return ranking.best_of(lines, ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_quantity"]).drop("l_quantity")


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-seasons with defects: too many minutes, negative shots, odd ages, gaps."""
    ps, k = player_seasons(spark, sf_dir), F.col("player_id")
    return ps.withColumns(
        {
            "minutes": F.when(k % 50 == 1, F.col("minutes") + 4000).otherwise(F.col("minutes")),
            "shots": F.when(k % 40 == 3, F.lit(-1.0)).otherwise(F.col("shots")),
            "age": F.when(k % 30 == 5, F.lit(12.0)).otherwise(F.col("age")),
            "tackles": F.when((F.col("season") < 1999) & (k % 20 == 0) | (F.col("season") >= 1999) & (k % 3 == 0), F.lit(None)).otherwise(F.col("tackles")),
        }
    )


DIRTY = f"""{PS}, dirty AS (SELECT * REPLACE (CASE WHEN player_id % 50 = 1 THEN mins + 4000 ELSE mins END AS mins, CASE WHEN player_id % 40 = 3 THEN -1.0::DOUBLE ELSE shots END AS shots,
  CASE WHEN player_id % 30 = 5 THEN 12.0::DOUBLE ELSE age END AS age,
  CASE WHEN season < 1999 AND player_id % 20 = 0 OR season >= 1999 AND player_id % 3 = 0 THEN NULL ELSE tackles END AS tackles) FROM ps)"""


@query(
    "clean_audit",
    f"""WITH {DIRTY}, timed AS (SELECT * FROM dirty WHERE mins > 0 AND mins <= 3420), pos AS (SELECT * FROM timed WHERE NOT (shots < 0))
    SELECT 0 AS step, 'rows in' AS what, CAST(COUNT(*) AS BIGINT) AS n FROM dirty UNION ALL SELECT 1, 'distinct rows', COUNT(*) FROM (SELECT DISTINCT * FROM dirty)
    UNION ALL SELECT 2, 'one row a key', COUNT(*) FROM (SELECT DISTINCT player_id, season FROM dirty) UNION ALL SELECT 3, 'valid minutes', COUNT(*) FROM timed
    UNION ALL SELECT 4, 'no negatives', COUNT(*) FROM pos UNION ALL SELECT 5, 'age withdrawn', COUNT(*) FILTER (NOT age BETWEEN 15 AND 45) FROM pos""",
)
def clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_players(_dirty(spark, sf_dir), STATS, ["team"])[1]


@query(
    "clean_rows",
    f"""WITH {DIRTY}, pos AS (SELECT * FROM dirty WHERE mins > 0 AND mins <= 3420 AND NOT (shots < 0)), cov AS (SELECT season, AVG(CAST(tackles IS NOT NULL AS INT)) >= 0.9 AS ok FROM pos GROUP BY season)
    SELECT player_id, season, mins AS minutes, shots, CASE WHEN age BETWEEN 15 AND 45 THEN age END AS age, CASE WHEN ok THEN COALESCE(tackles, 0.0::DOUBLE) ELSE tackles END AS tackles FROM pos JOIN cov USING (season)""",
)
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_players(_dirty(spark, sf_dir), STATS, ["team"])[0].select("player_id", "season", "minutes", "shots", "age", "tackles")


@query(
    "coverage_by_season",
    f"WITH {DIRTY} SELECT season, round_even(AVG(CAST(tackles IS NOT NULL AS DOUBLE)), 6) AS tackles, round_even(AVG(CAST(shots IS NOT NULL AS DOUBLE)), 6) AS shots FROM dirty GROUP BY season",
)
def coverage_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.coverage(_dirty(spark, sf_dir), ["tackles", "shots"]).select("season", round_even(F.col("tackles"), 6).alias("tackles"), round_even(F.col("shots"), 6).alias("shots"))


@query(
    "coverage_impute",
    f"""WITH {DIRTY}, cov AS (SELECT season, AVG(CAST(tackles IS NOT NULL AS INT)) >= 0.9 AS ok FROM dirty GROUP BY season), m AS (SELECT *  FROM dirty JOIN cov USING (season)),
    med AS (SELECT position_group, COALESCE(median(tackles / NULLIF(mins / 90.0::DOUBLE, 0)), 0) AS typical FROM m WHERE ok GROUP BY position_group)
    SELECT player_id, season, round_even(CASE WHEN tackles IS NULL AND ok THEN COALESCE(typical, 0) * (mins / 90.0::DOUBLE) ELSE tackles END, 6) AS tackles FROM m LEFT JOIN med USING (position_group)""",
)
def coverage_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute(_dirty(spark, sf_dir), "tackles").select("player_id", "season", round_even(F.col("tackles"), 6).alias("tackles"))


@query(
    "zero_fill_reliable",
    f"""WITH {DIRTY}, cov AS (SELECT season, AVG(CAST(tackles IS NOT NULL AS INT)) >= 0.9 AS ok FROM dirty GROUP BY season)
    SELECT player_id, season, CASE WHEN ok THEN COALESCE(tackles, 0.0::DOUBLE) ELSE tackles END AS tackles FROM dirty JOIN cov USING (season)""",
)
def zero_fill_reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.zero_fill(_dirty(spark, sf_dir), ["tackles"]).select("player_id", "season", "tackles")


@query(
    "consistency_clip",
    f"WITH {PS} SELECT player_id, season, LEAST(shots, goals + 1) AS shots_on_target, LEAST(tackles, completed) AS tackles_won FROM (SELECT *, shots + 0 AS s FROM ps)",
)
def consistency_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).select("player_id", "season", "shots", (F.col("goals") + 1).alias("shots_on_target"), F.col("completed").alias("tackles_won"), "tackles")
    return cleaning.consistent(ps).select("player_id", "season", "shots_on_target", "tackles_won")


@query(
    "robust_outliers",
    f"""WITH {PS}, a AS (SELECT *, median(shots) OVER (PARTITION BY position_group) AS m FROM ps), b AS (SELECT *, median(abs(shots - m)) OVER (PARTITION BY position_group) AS mad FROM a)
    SELECT player_id, season, round_even(abs(CASE WHEN mad * 1.4826::DOUBLE = 0 THEN 0 ELSE (shots - m) / (mad * 1.4826::DOUBLE) END), 6) AS largest_z,
    abs(CASE WHEN mad * 1.4826::DOUBLE = 0 THEN 0 ELSE (shots - m) / (mad * 1.4826::DOUBLE) END) > 5.0 AS is_outlier FROM b""",
)
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.flag_outliers(player_seasons(spark, sf_dir), ["shots"], ["position_group"]).select("player_id", "season", round_even(F.col("largest_z"), 6).alias("largest_z"), "is_outlier")


@query("per90", f"WITH {PS} SELECT player_id, season, " + ", ".join(f"round_even({s} / NULLIF(mins / 90.0::DOUBLE, 0), 6) AS {s}_per90" for s in STATS) + " FROM ps")
def per90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.per90(player_seasons(spark, sf_dir), STATS).select("player_id", "season", *[round_even(F.col(f"{s}_per90"), 6).alias(f"{s}_per90") for s in STATS])


def eb(s: str, a: str, k: float) -> str:
    g, t = "OVER (PARTITION BY position_group)", "OVER ()"
    pooled = f"COALESCE(SUM({s}) {g} / NULLIF(SUM({a}) {g}, 0), SUM({s}) {t} / NULLIF(SUM({a}) {t}, 0))"
    return f"round_even(({s} + {k}::DOUBLE * {pooled}) / ({a} + {k}::DOUBLE) * 100.0::DOUBLE, 2)"


RATIOS = {"pass_pct": ("completed", "attempts", 100.0), "conversion_pct": ("goals", "shots", 20.0), "tackle_pct": ("tackles", "attempts", 20.0)}


@query("eb_ratio", f"WITH {PS} SELECT player_id, season, " + ", ".join(f"{eb(*v)} AS {k}" for k, v in RATIOS.items()) + " FROM ps")
def eb_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.shrunk_by_table(player_seasons(spark, sf_dir), RATIOS, ["position_group"]).select("player_id", "season", *RATIOS)


@query(
    "composites",
    f"""WITH {PS} SELECT player_id, season, round_even((goals + assists) / NULLIF(mins / 90.0::DOUBLE, 0), 3) AS goal_involvements_per90,
    round_even(100.0::DOUBLE * (completed / NULLIF(attempts, 0)), 2) AS share, round_even(goals - shots, 3) AS goals_minus_shots FROM ps""",
)
def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.derived(player_seasons(spark, sf_dir))
    return made.select(
        "player_id", "season", "goal_involvements_per90", round_even(100.0 * ratio(F.col("completed"), F.col("attempts")), 2).alias("share"), round_even(F.col("goals") - F.col("shots"), 3).alias("goals_minus_shots")
    )


@query(
    "team_share",
    f"""WITH {PS}, t AS (SELECT season, league, team, SUM(mins) / 11.0::DOUBLE AS tm, SUM(shots) AS ts FROM ps GROUP BY ALL)
    SELECT player_id, season, CASE WHEN tm >= 450 THEN round_even(100.0::DOUBLE * ((shots / NULLIF(mins, 0)) / NULLIF(ts / tm, 0)), 2) END AS team_shot_share FROM ps JOIN t USING (season, league, team)""",
)
def team_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.team_share(player_seasons(spark, sf_dir), "shots", "shots", "team_shot_share").select("player_id", "season", "team_shot_share")


@query(
    "possession_adjust",
    f"""WITH {PS}, p AS (SELECT *, 30.0::DOUBLE + player_id % 60 AS poss FROM ps) SELECT player_id, season, round_even(50.0::DOUBLE / GREATEST(100.0 - poss, 20.0::DOUBLE), 3) AS possession_factor,
    round_even((tackles / NULLIF(mins / 90.0::DOUBLE, 0)) * (50.0::DOUBLE / GREATEST(100.0 - poss, 20.0::DOUBLE)), 3) AS padj_tackles_per90 FROM p""",
)
def possession_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = features.per90(player_seasons(spark, sf_dir), ["tackles"]).withColumn("team_possession", 30.0 + F.col("player_id") % 60)
    return features.possession_adjusted(ps).select("player_id", "season", "possession_factor", "padj_tackles_per90")


@query(
    "combined_seasons",
    f"WITH {PS} SELECT player_id, SUM(mins) AS minutes, round_even(SUM(shots * mins) / SUM(mins), 6) AS shots FROM ps GROUP BY player_id",
)
def combined_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.combined_seasons(player_seasons(spark, sf_dir), ["player_id"], ["shots"]).select("player_id", "minutes", round_even(F.col("shots"), 6).alias("shots"))


@query("percentile_avg_rank", f"WITH {PS} SELECT player_id, season, {pct('shots')} AS pct_shots FROM ps")
def percentile_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.percentiles(player_seasons(spark, sf_dir), "shots", ["position_group", "season"], "pct_shots").select("player_id", "season", "pct_shots")


@query("percentile_flip", f"WITH {PS} SELECT player_id, season, {pct('attempts', flip=True)} AS pct_attempts FROM ps")
def percentile_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.percentiles(player_seasons(spark, sf_dir), "attempts", ["position_group", "season"], "pct_attempts", lower_is_better=True).select("player_id", "season", "pct_attempts")


@query("percentile_two_keys", f"WITH {PS} SELECT player_id, season, {pct('goals', 'position_group, season, league')} AS pct_goals FROM ps")
def percentile_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.percentiles(player_seasons(spark, sf_dir), "goals", ["position_group", "season", "league"], "pct_goals").select("player_id", "season", "pct_goals")


@query(
    "percentile_long",
    f"WITH {PS}, l AS (SELECT player_id, season, position_group, metric, value FROM (SELECT player_id, season, position_group, shots, goals, tackles FROM ps) UNPIVOT (value FOR metric IN (shots, goals, tackles)))"
    f" SELECT player_id, season, metric, {pct('value', 'position_group, season, metric')} AS pct FROM l",
)
def percentile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = models.long_form(player_seasons(spark, sf_dir), ["player_id", "season", "position_group"], ["shots", "goals", "tackles"])
    return ranking.percentiles(long, "value", ["position_group", "season", "metric"], "pct").select("player_id", "season", "metric", "pct")


@query(
    "place_out_of_sample",
    f"""WITH {PS}, r AS (SELECT position_group, shots AS v, COUNT(*) AS c FROM ps WHERE season < 2001 GROUP BY ALL), n AS (SELECT * FROM ps WHERE season = 2001)
    SELECT n.player_id, round_even((COALESCE(SUM(c) FILTER (v < shots), 0) + COALESCE(SUM(c) FILTER (v = shots), 0) / 2.0::DOUBLE + 1) / (SUM(c) + 1) * 100, 1) AS pct FROM n JOIN r USING (position_group) GROUP BY n.player_id, n.shots""",
)
def place_out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).select("player_id", "season", "position_group", "shots")
    return ranking.place_among(ps.where("season < 2001"), ps.where("season = 2001"), "shots", ["position_group"], "pct").select("player_id", "pct")


BASKETS = {"Attack": ("shots", "goals"), "Build Up": ("passes", "assists", "completed"), "Defence": ("tackles",)}
METRICS = [m for ms in BASKETS.values() for m in ms]
CATS = f"""{PS}, pc AS (SELECT *, {', '.join(f'{pct(m)} AS pct_{m}' for m in METRICS)} FROM ps), ca AS (SELECT *, round_even((pct_shots + pct_goals) / 2, 1) AS cat_attack,
  round_even((pct_passes + pct_assists + pct_completed) / 3, 1) AS cat_build_up, round_even(pct_tackles / 1, 1) AS cat_defence FROM pc)"""
WEIGHTS = {"cat_attack": 50.0, "cat_build_up": 30.0, "cat_defence": 20.0}
FIT = "round_even(round_even(COALESCE(cat_attack, 50.0) * 0.5::DOUBLE, 2) + round_even(COALESCE(cat_build_up, 50.0) * 0.3::DOUBLE, 2) + round_even(COALESCE(cat_defence, 50.0) * 0.2::DOUBLE, 2), 1)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-seasons with category scores: all metrics are ranked in one long table, then they go back beside their rows."""
    ps = held(player_seasons(spark, sf_dir))
    long = models.long_form(ps, ["player_id", "season", "position_group"], METRICS)
    ranked = ranking.percentiles(long, "value", ["position_group", "season", "metric"], "pct")
    wide = ranked.groupBy("player_id", "season").agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"pct_{m}") for m in METRICS])
    return features.category_scores(ps.join(wide, ["player_id", "season"]), BASKETS)


@query("category_scores", f"WITH {CATS} SELECT player_id, season, cat_attack, cat_build_up, cat_defence FROM ca")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("player_id", "season", "cat_attack", "cat_build_up", "cat_defence")


@query("fit_score", f"WITH {CATS} SELECT player_id, season, position_group, team, {FIT} AS fit_score FROM ca")
def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("player_id", "season", "position_group", "team", recruit.fit_score(WEIGHTS).alias("fit_score"))


@query(
    "brief_search",
    f"""WITH {CATS} SELECT player_id, season, {FIT} AS fit_score FROM ca WHERE position_group IN ('BUILDING', 'MACHINERY') AND mins >= 100 AND age BETWEEN 18 AND 30 AND league IN ('ASIA', 'EUROPE', 'AFRICA')
    AND (value <= 5000 OR value IS NULL) AND pct_shots >= 40 ORDER BY fit_score DESC, player_id, season LIMIT 25""",
)
def brief_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    brief = recruit.Brief(
        groups=("BUILDING", "MACHINERY"), min_minutes=100, age=recruit.AgeRange(18, 30), leagues=("ASIA", "EUROPE", "AFRICA"), max_price=5000, thresholds=(("pct_shots", ">=", 40),), weights=WEIGHTS
    )
    return recruit.search(scored(spark, sf_dir).withColumn("price", F.col("value")), brief, 25, ["player_id", "season"]).select("player_id", "season", "fit_score")


@query(
    "fold_thin_groups",
    f"""WITH {PS}, g AS (SELECT player_id, season, CASE WHEN player_id % 211 = 0 THEN 'SS' WHEN player_id % 3 = 0 THEN 'AM' WHEN player_id % 301 = 1 THEN 'WM' ELSE 'W' END AS grp FROM ps), a AS (SELECT player_id, season,
    CASE WHEN grp = 'SS' AND COUNT(*) OVER (PARTITION BY grp) < 40 THEN 'AM' ELSE grp END AS grp FROM g) SELECT player_id, season, CASE WHEN grp = 'WM' AND COUNT(*) OVER (PARTITION BY grp) < 40 THEN 'W' ELSE grp END AS grp FROM a""",
)
def fold_thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("player_id")
    group = F.when(k % 211 == 0, "SS").when(k % 3 == 0, "AM").when(k % 301 == 1, "WM").otherwise("W")
    return ranking.fold_thin_groups(player_seasons(spark, sf_dir).select("player_id", "season", group.alias("grp")), "grp", {"SS": "AM", "WM": "W"})


@query(
    "transfer_collapse",
    """WITH c AS (SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, o_orderpriority AS team, SUM(o_totalprice / 100) AS m, SUM(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 1.0::DOUBLE END) AS g, MIN(o_orderkey % 17 = 0) AS f,
    AVG(o_totalprice) AS a FROM orders GROUP BY ALL), d AS (SELECT *, CASE WHEN f THEN NULL ELSE g END AS goals FROM c)
    SELECT player_id, season, arg_min(team, ROW(-round(m, 4), team)) AS team, round_even(SUM(m), 4) AS minutes, CAST(COUNT(DISTINCT team) AS BIGINT) AS clubs_in_season,
    CASE WHEN COUNT(goals) = COUNT(*) THEN SUM(goals) END AS goals, round_even(SUM(a * m) / SUM(m), 3) AS mean_price FROM d GROUP BY ALL""",
)
def transfer_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    miss = F.col("o_orderkey") % 17 == 0
    clubs = orders.groupBy(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("team")).agg(
        F.round(F.sum(F.col("o_totalprice") / 100), 4).alias("minutes"), F.sum(F.when(~miss, 1.0)).alias("goals"), F.avg("o_totalprice").alias("mean_price")
    )
    out = aggregates.collapse_transfers(clubs, ["player_id", "season"], ["goals"], ["mean_price"], [])
    return out.withColumn("minutes", round_even(F.col("minutes"), 4)).withColumn("mean_price", round_even(F.col("mean_price"), 3))


@query("flank_footed", """WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'LB' WHEN 1 THEN 'RW' WHEN 2 THEN 'CB' WHEN 3 THEN 'DEF' WHEN 4 THEN 'LM' ELSE 'FW' END AS position,
    CASE c_custkey % 6 WHEN 0 THEN 'FB' WHEN 1 THEN 'W' WHEN 2 THEN 'CB' WHEN 3 THEN 'DEF' WHEN 4 THEN 'WM' ELSE 'FW' END AS grp, CASE c_custkey % 4 WHEN 0 THEN 'Left' WHEN 1 THEN 'right' WHEN 2 THEN 'both' END AS foot FROM customer),
    f AS (SELECT *, CASE position WHEN 'LB' THEN 'Left' WHEN 'LM' THEN 'Left' WHEN 'RW' THEN 'Right' WHEN 'DEF' THEN NULL ELSE 'Central' END AS flank FROM c)
    SELECT c_custkey, flank, CASE WHEN grp IN ('FB', 'W', 'WM') AND flank IN ('Left', 'Right') AND lower(foot) IN ('left', 'right') THEN CASE WHEN lower(foot) = lower(flank) THEN 'Natural' ELSE 'Inverted' END END AS footed_side FROM f""")  # fmt: skip
def flank_footed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", pick(6, "LB", "RW", "CB", "DEF", "LM", "FW").alias("position"), pick(6, "FB", "W", "CB", "DEF", "WM", "FW").alias("position_group"), pick(4, "Left", "right", "both", None).alias("foot")
    )
    return cleaning.flanks(c).select("c_custkey", "flank", "footed_side")


@query("zscore_scale", f"""WITH {PS}, f AS (SELECT player_id, season, position_group, COALESCE(NULLIF(shots, 0), median(NULLIF(shots, 0)) OVER (PARTITION BY position_group), 0) AS s FROM ps)
    SELECT player_id, season, round_even((s - AVG(s) OVER (PARTITION BY position_group)) / COALESCE(NULLIF(stddev_pop(s) OVER (PARTITION BY position_group), 0), 1), 6) AS z_shots FROM f""")  # fmt: skip
def zscore_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir).withColumn("shots", F.nullif(F.col("shots"), F.lit(0.0)))
    return models.scaled(ps, ["shots"], ["position_group"]).select("player_id", "season", round_even(F.col("z_shots"), 6).alias("z_shots"))
