"""Recruitment, models and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, jaccard, round_even
from ..operators import blocks, clusters, models, moments, ranking, recruit, validate
from ..sources import files
from .adapters import PS, player_seasons, table
from .catalog import query
from .queries_features import CATS, FIT, PCT, WEIGHTS, scored

SHARE = "(" + PCT.replace("100.0::DOUBLE * ", "") + ")"
LINE = f"""{CATS}, sc AS (SELECT *, {FIT} AS perf FROM ca), y AS (SELECT *, CASE WHEN value > 0 AND perf IS NOT NULL THEN log10(value) END AS y FROM sc),
  ln AS (SELECT position_group, regr_slope(y, perf) AS b, regr_intercept(y, perf) AS a FROM y WHERE y IS NOT NULL GROUP BY position_group HAVING COUNT(*) >= 30),
  rs AS (SELECT *, round_even(y - (a + b * perf), 6) AS value_residual, 1 AS one FROM y LEFT JOIN ln USING (position_group))"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("perf", recruit.fit_score(WEIGHTS))
    return recruit.price_line(rows, "perf", "value", "position_group")


@query("value_residual", f"WITH {LINE} SELECT player_id, season, round_even(value_residual, 4) AS value_residual FROM rs")
def value_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("player_id", "season", round_even(round_even(F.col("value_residual"), 6), 4).alias("value_residual"))


@query("value_for_money", f"WITH {CATS}, v AS (SELECT *, CASE WHEN value > 0 THEN {FIT} / value END AS v, 1 AS one FROM ca) SELECT player_id, season, CASE WHEN v IS NOT NULL THEN round_even({SHARE.format(by='one', x='v')} * 100, 1) END AS vfm FROM v")
def value_for_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("perf", recruit.fit_score(WEIGHTS))
    return recruit.value_for_money(rows, "perf", "value", "vfm").select("player_id", "season", "vfm")


@query(
    "age_upside_exposure",
    f"""WITH {PS}, s AS (SELECT *, CASE league WHEN 'EUROPE' THEN 1.0::DOUBLE WHEN 'AMERICA' THEN 0.9 WHEN 'ASIA' THEN 0.8 ELSE 0.7 END AS st FROM ps)
    SELECT player_id, season, round_even(GREATEST(LEAST(100.0::DOUBLE * (27 - age) / 8.0::DOUBLE, 100), 0), 1) AS age_upside, round_even(GREATEST(LEAST(100.0::DOUBLE * (mins / 1800.0::DOUBLE), 100), 0), 1) AS sample_size,
    round_even(100.0::DOUBLE * ((SELECT MAX(st) FROM s) - st) / ((SELECT MAX(st) FROM s) - (SELECT MIN(st) FROM s)), 1) AS exposure FROM s""",
)
def age_upside_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.when(F.col("league") == "EUROPE", 1.0).when(F.col("league") == "AMERICA", 0.9).when(F.col("league") == "ASIA", 0.8).otherwise(0.7)
    rows = recruit.exposure(player_seasons(spark, sf_dir).withColumn("st", strength), "st", "exposure")
    return rows.select("player_id", "season", recruit.age_upside(F.col("age")).alias("age_upside"), recruit.sample_size(F.col("minutes")).alias("sample_size"), "exposure")


@query(
    "hidden_gem",
    f"""WITH {CATS}, g AS (SELECT *, {FIT} AS perf, round_even(GREATEST(LEAST(100.0::DOUBLE * (27 - age) / 8.0::DOUBLE, 100), 0), 1) AS up, round_even(GREATEST(LEAST(100.0::DOUBLE * (mins / 1800.0::DOUBLE), 100), 0), 1) AS sz, 1 AS one FROM ca),
    v AS (SELECT *, CASE WHEN value > 0 THEN perf / value END AS v FROM g), w AS (SELECT *, CASE WHEN v IS NOT NULL THEN round_even({SHARE.format(by='one', x='v')} * 100, 1) END AS vfm FROM v)
    SELECT player_id, season, round_even((perf * 40 + up * 20 + sz * 10 + COALESCE(vfm, 0) * 15) / (70 + CASE WHEN vfm IS NULL THEN 0 ELSE 15 END), 1) AS hidden_gem_score FROM w""",
)
def hidden_gem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"perf": recruit.fit_score(WEIGHTS), "up": recruit.age_upside(F.col("age")), "sz": recruit.sample_size(F.col("minutes"))})
    rows = recruit.value_for_money(rows, "perf", "value", "vfm")
    parts = {"Performance": "perf", "Age upside": "up", "Sample size": "sz", "Value for money": "vfm"}
    return rows.select("player_id", "season", recruit.gem_score(parts).alias("hidden_gem_score"))


REL = f"""{PS}, q AS (SELECT *, dense_rank() OVER (ORDER BY season) AS s FROM ps WHERE mins >= 100), l AS (SELECT player_id, position_group, s, metric, value FROM (SELECT player_id, position_group, s, shots, tackles, attempts FROM q) UNPIVOT (value FOR metric IN (shots, tackles, attempts))),
  z AS (SELECT *, (value - AVG(value) OVER w) / NULLIF(stddev_samp(value) OVER w, 0) AS z FROM l WINDOW w AS (PARTITION BY position_group, s, metric)),
  rel AS (SELECT a.position_group, a.metric, CAST(COUNT(*) AS BIGINT) AS pairs, round_even(corr(a.z, b.z), 3) AS r FROM z a JOIN z b ON a.player_id = b.player_id AND a.metric = b.metric AND b.s = a.s + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 40)"""


def _reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 100 minutes in place of 900, as the tables' quantities are smaller."""
    ps = player_seasons(spark, sf_dir).where("minutes >= 100").withColumn("minutes", F.col("minutes") + 800)
    return models.reliability(ps, ["shots", "tackles", "attempts"])


@query("reliability_corr", f"WITH {REL} SELECT * FROM rel")
def reliability_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reliability(spark, sf_dir)


@query("reliability_weights", f"WITH {REL}, c AS (SELECT position_group, metric, CASE WHEN metric <> 'attempts' THEN pow(GREATEST(r, 0.05::DOUBLE), 2) END AS w FROM rel) SELECT position_group, metric, round_even(COALESCE(w, median(w) OVER (PARTITION BY position_group), 1), 6) AS weight FROM c")
def reliability_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _reliability(spark, sf_dir)
    weights = models.reliability_weights(rel, rel.select("position_group", "metric"), context=("attempts",))
    return weights.withColumn("weight", round_even(F.col("weight"), 6))


@query("corr_pairs", f"WITH {PS} SELECT a, b, round_even(r, 4) AS r FROM (SELECT 'attempts' AS a, 'completed' AS b, corr(attempts, completed) AS r FROM ps UNION ALL SELECT 'attempts', 'tackles', corr(attempts, tackles) FROM ps UNION ALL SELECT 'completed', 'tackles', corr(completed, tackles) FROM ps) WHERE abs(r) >= 0.5")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.correlated(player_seasons(spark, sf_dir), ["attempts", "completed", "tackles"], 0.5)
    return found.select("a", "b", round_even(F.col("r"), 4).alias("r"))


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """120 metrics of the vectors, some of them measured in some rows only: the 64 numbers, and 56 products of neighbours where the first is above -0.1."""
    v = _vectors(spark, sf_dir)
    at = lambda i: F.get("v", F.lit(i))
    columns = [at(i).alias(f"f{i}") for i in range(64)] + [F.when(at(i) > -0.1, at(i) * at(i + 1) + 1000).alias(f"p{i}") for i in range(56)]
    return v.select(*columns), [f"f{i}" for i in range(64)] + [f"p{i}" for i in range(56)]


@query(
    "corr_matrix",
    """WITH m AS (SELECT vec_id, 'f' || i AS metric, i AS k, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i) UNION ALL
      SELECT vec_id, 'p' || i, 64 + i, CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > -0.1::DOUBLE THEN CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[i + 2] AS DOUBLE) END FROM embeddings, range(56) r(i)),
    k AS (SELECT * FROM m WHERE x IS NOT NULL)
    SELECT a.metric AS a, b.metric AS b, CAST(COUNT(*) AS BIGINT) AS n, round_even(corr(a.x, b.x), 5) + 0.0 AS r FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY ALL""",
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 7,140 pairs of 120 metrics, each over the rows that measure both."""
    return moments.correlations(*_wide(spark, sf_dir)).withColumn("r", round_even(F.col("r"), 5) + 0.0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


COS = "round_even(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _topk(distance: str, k: int) -> str:
    return f"""WITH {EMB}, d AS (SELECT b.vec_id AS query, a.vec_id, {distance} AS distance FROM e b JOIN e a ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance FROM d QUALIFY rank <= {k}"""


@query("cosine_topk", _topk(COS, 10))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of its label, for every vector."""
    return blocks.nearest(_vectors(spark, sf_dir), "vec_id", "v", 10, "cosine", "label")


@query("euclid_topk", _topk("round_even(list_distance(a.v, b.v), 6)", 10))
def euclid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nearest(_vectors(spark, sf_dir), "vec_id", "v", 10, "euclid", "label")


@query(
    "weighted_cosine",
    f"""WITH {EMB}, w AS (SELECT vec_id, label, list_transform(v, lambda x, i: x * sqrt(CAST(i AS DOUBLE) / 2080)) AS v FROM e), d AS (SELECT b.vec_id AS query, a.vec_id, {COS} AS distance FROM w b JOIN w a ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT query, vec_id, round_even(GREATEST(LEAST((1 - distance) * 100, 100), 0), 1) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 5""",
)
def weighted_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("v", models.weighted_vector(F.col("v"), [float(i) for i in range(1, 65)]))
    near = blocks.nearest(v, "vec_id", "v", 5, "cosine", "label")
    return near.select("query", "vec_id", models.similarity_percent(F.col("distance")).alias("similarity"))


@query("explain_pair", f"WITH {EMB}, p AS (SELECT unnest(range(0, 64)) AS k, unnest(a.v) AS x, unnest(b.v) AS y FROM e a, e b WHERE a.vec_id = 0 AND b.vec_id = 1) SELECT 'f' || k AS feature, round_even(abs(x - y), 6) AS gap, round_even(pow(abs(x - y), 2) / SUM(pow(abs(x - y), 2)) OVER (), 6) AS share FROM p")
def explain_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    pair = v.where("vec_id = 0").select(F.col("v").alias("x")).crossJoin(v.where("vec_id = 1").select(F.col("v").alias("y")))  # one row
    out = models.explained(pair, "x", "y", [f"f{i}" for i in range(64)], [1.0] * 64)
    return out.select("feature", round_even(F.col("gap"), 6).alias("gap"), round_even(F.col("share"), 6).alias("share"))


@query("replacements", f"WITH {EMB}, d AS (SELECT a.vec_id, {COS} AS distance, CAST(a.vec_id % 101 AS DOUBLE) AS fit FROM e b JOIN e a ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id = 7), n AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 60), s AS (SELECT *, round_even(0.6::DOUBLE * round_even(GREATEST(LEAST((1 - distance) * 100, 100), 0), 1) + 0.4::DOUBLE * fit, 1) AS score FROM n) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty nearest, ranked again by similarity and fit to the role."""
    v = _vectors(spark, sf_dir)
    one = v.where("vec_id = 7").select(F.col("label"), F.col("v").alias("q"))
    near = v.join(F.broadcast(one), "label").where("vec_id <> 7").select("vec_id", round_even(1.0 - cosine(F.col("v"), F.col("q")), 6).alias("d")).orderBy("d", "vec_id").limit(60)
    score = round_even(0.6 * models.similarity_percent(F.col("d")) + 0.4 * (F.col("vec_id") % 101).cast("double"), 1)
    return near.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("knn_uniqueness", f"WITH {EMB}, d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d) SELECT vec_id, round_even(AVG(d), 5) AS mean_distance FROM n WHERE r <= 15 GROUP BY vec_id")
def knn_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = models.mean_distances(_vectors(spark, sf_dir), "vec_id", "v", "label", digits=None)
    return means.withColumn("mean_distance", round_even(F.col("mean_distance"), 5))


@query("jaccard_topk", "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part), j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round_even(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS j FROM p a JOIN p b ON a.p_partkey % 100 = 0 AND a.p_partkey <> b.p_partkey AND list_has_any(a.w, b.w)) SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) <= 10")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts most like every hundredth one, among all. Sets of words meet on the words they share; of a set's parts, and for one asked for, the first eleven can be among the ten."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("wb")).where("wb IS NOT NULL")
    first = lambda df, by, order: df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r <= 11").drop("_r")
    asked = p.where("b % 100 = 0").select(F.col("b").alias("a"), F.col("wb").alias("wa"))
    sets = p.select("wb").distinct().withColumn("t", F.explode("wb"))
    met = asked.select("wa").distinct().withColumn("t", F.explode("wa")).join(sets, "t").where(F.array_min(F.array_intersect("wa", "wb")) == F.col("t"))
    scores = met.select("wa", "wb", round_even(jaccard(F.col("wa"), F.col("wb")), 6).alias("j")).join(first(p, "wb", ["b"]), "wb").select("wa", "j", "b")
    near = asked.join(first(scores, "wa", [F.desc("j"), "b"]), "wa").where("a <> b").select("a", "b", "j")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("j"), "b"))).where("_r <= 10").drop("_r")


GROW = f"""{PS}, q AS (SELECT *, dense_rank() OVER (ORDER BY season) AS s FROM ps), g AS (SELECT a.*, CASE WHEN a.attempts > 0 AND b.attempts > 0 THEN log10(b.attempts / a.attempts) END AS growth, 1 AS one FROM q a LEFT JOIN q b ON a.player_id = b.player_id AND b.s = a.s + 2)"""


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.growth(ranking.season_index(player_seasons(spark, sf_dir), "season", "s"), "shots", "attempts", "player_id", "s")


@query(
    "growth_deciles",
    f"""WITH {GROW}, k AS (SELECT * FROM g WHERE growth IS NOT NULL), d AS (SELECT *, CAST(floor(LEAST({SHARE.format(by='one', x='shots')} * 10, 9.999::DOUBLE)) + 1 AS INT) AS decile FROM k)
    SELECT decile, CAST(COUNT(*) AS BIGINT) AS players, median(shots) AS median_score, median(attempts) AS median_value, round_even(pow(10.0::DOUBLE, median(growth)), 2) AS growth_x, round_even(AVG(CAST(growth > 0 AS DOUBLE)), 3) AS share_up FROM d GROUP BY decile""",
)
def growth_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.growth_by_decile(_grown(spark, sf_dir), "shots", "attempts")


@query(
    "growth_summary",
    f"""WITH {GROW}, k AS (SELECT * FROM g WHERE growth IS NOT NULL), c AS (SELECT quantile_cont(shots, 0.9) AS cut FROM k), m AS (SELECT *, shots >= cut AS top FROM k, c),
    r AS (SELECT corr({SHARE.format(by='one', x='shots')}, {SHARE.format(by='one', x='growth')}) OVER () AS rho FROM k LIMIT 0), rr AS (SELECT corr(a, b) AS rho FROM (SELECT {SHARE.format(by='one', x='shots')} AS a, {SHARE.format(by='one', x='growth')} AS b FROM k))
    SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM g) AS candidates, CAST(COUNT(*) AS BIGINT) AS tested, round_even(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM g), 3) AS coverage, round_even(pow(10.0::DOUBLE, median(growth) FILTER (top)), 2) AS top_growth_x,
      round_even(pow(10.0::DOUBLE, median(growth) FILTER (NOT top)), 2) AS rest_growth_x, round_even(AVG(CAST(growth > 0 AS DOUBLE)) FILTER (top), 3) AS top_up, round_even(AVG(CAST(growth > 0 AS DOUBLE)) FILTER (NOT top), 3) AS rest_up,
      (SELECT round_even(round_even(rho, 4), 3) FROM rr) AS rank_correlation FROM m HAVING COUNT(*) >= 100""".replace(
        f"r AS (SELECT corr({SHARE.format(by='one', x='shots')}, {SHARE.format(by='one', x='growth')}) OVER () AS rho FROM k LIMIT 0), ", ""
    ),
)
def growth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tenth by score against the rest, two seasons on."""
    return validate.growth_summary(_grown(spark, sf_dir), "shots")


CELLS = f"""{GROW}, b AS (SELECT *, CASE WHEN age < 21 THEN 'under 21' WHEN age < 24 THEN '21-23' WHEN age < 28 THEN '24-27' ELSE '28+' END AS age_band, row_number() OVER (ORDER BY attempts, player_id, season) AS r, COUNT(*) OVER () AS n FROM g WHERE growth IS NOT NULL),
    c AS (SELECT *, CAST(GREATEST(1, ceil(5.0::DOUBLE * (r - 1) / (n - 1))) AS INT) AS value_band FROM b), k AS (SELECT age_band, value_band, {SHARE.format(by='age_band, value_band', x='shots')} AS x, {SHARE.format(by='age_band, value_band', x='growth')} AS y, shots FROM c),
    cells AS (SELECT age_band, value_band, CAST(COUNT(*) AS BIGINT) AS n, round_even(corr(x, y), 4) AS rho FROM k GROUP BY ALL HAVING COUNT(*) >= 40 AND COUNT(DISTINCT shots) >= 5 AND corr(x, y) IS NOT NULL AND NOT isnan(corr(x, y)))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.growth_cells(_grown(spark, sf_dir), "shots", "attempts", "age", ["player_id", "season"])


@query("growth_cells", f"WITH {CELLS} SELECT * FROM cells")
def growth_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("growth_strata", f"WITH {CELLS} SELECT CAST(COUNT(*) AS BIGINT) AS cells, CAST(SUM(n) AS BIGINT) AS players, round_even(SUM(rho * n) / SUM(n), 3) AS rank_correlation, CAST(COUNT(*) FILTER (rho > 0) AS BIGINT) AS positive FROM cells HAVING COUNT(*) > 0")
def growth_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the score foretells growth within cells of age and price."""
    return validate.growth_strata(_cells(spark, sf_dir))


@query("place_bands", f"WITH {PS}, r AS (SELECT player_id, season, row_number() OVER (ORDER BY shots, player_id, season) AS place, COUNT(*) OVER () AS n FROM ps) SELECT player_id, season, place, CAST(GREATEST(1, ceil(5.0::DOUBLE * (place - 1) / (n - 1))) AS INT) AS band FROM r")
def place_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player-season's place and fifth among all."""
    ps = player_seasons(spark, sf_dir).select("player_id", "season", "shots")
    placed = ranking.numbered(ps, [], ["shots", "player_id", "season"], "place")
    return ranking.quintiles(placed, "shots", ["player_id", "season"], "band").select("player_id", "season", "place", "band")


@query("quintile_bands", f"WITH {PS}, r AS (SELECT player_id, season, row_number() OVER (PARTITION BY season ORDER BY shots, player_id) AS r, COUNT(*) OVER (PARTITION BY season) AS n FROM ps) SELECT player_id, season, CAST(GREATEST(1, ceil(5.0::DOUBLE * (r - 1) / (n - 1))) AS INT) AS band FROM r")
def quintile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quintiles(player_seasons(spark, sf_dir), "shots", ["player_id"], "band", ["season"]).select("player_id", "season", "band")


@query("feed_agreement", """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, SUM(c_custkey % 100) AS v, CAST(COUNT(*) AS DOUBLE) * 100 AS m FROM customer GROUP BY ALL), b AS (SELECT k, s, v - k % 3 AS v, m FROM a),
    j AS (SELECT a.v AS x, b.v AS y, abs(a.v - b.v) AS gap FROM a JOIN b USING (k, s) WHERE a.m >= 900 AND b.m >= 900) SELECT CAST(COUNT(*) AS BIGINT) AS players, round_even(AVG(CAST(gap = 0 AS DOUBLE)), 4) AS equal, round_even(AVG(CAST(gap <= 1 AS DOUBLE)), 4) AS within_one,
    round_even(AVG(CAST(gap <= 0.05::DOUBLE * GREATEST(abs(x), 1) AS DOUBLE)), 4) AS within_5_pct, round_even(corr(x, y), 4) AS r FROM j""")  # fmt: skip
def feed_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.sum(F.col("c_custkey") % 100).alias("v"), (F.count("*").cast("double") * 100).alias("minutes"))
    return validate.agreement(c, c.withColumn("v", F.col("v") - F.col("k") % 3), ["k", "s"], "v")


NEAREST = f"{EMB}, d AS (SELECT b.vec_id AS query, a.vec_id, a.label, {COS} AS distance FROM e b JOIN e a ON a.label = b.label AND a.vec_id <> b.vec_id), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 10)"


def nearest_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nearest(_vectors(spark, sf_dir), "vec_id", "v", 10, "cosine", "label")


@query("team_mate_bias", f"WITH {NEAREST}, s AS (SELECT vec_id % 5 AS t, COUNT(*) AS n FROM e GROUP BY t) SELECT CAST(COUNT(*) AS BIGINT) AS pairs, round_even(AVG(CAST(query % 5 = vec_id % 5 AS DOUBLE)), 6) AS same_team, round_even((SELECT SUM(n * (n - 1)) / (SUM(n) * (SUM(n) - 1)) FROM s), 6) AS chance FROM t")
def team_mate_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("team"))
    out = validate.team_bias(nearest_ten(spark, sf_dir), rows, "vec_id", ["team"])
    return out.select("pairs", round_even(F.col("same_team"), 6).alias("same_team"), round_even(F.col("chance"), 6).alias("chance"))


@query(
    "self_season_recall",
    f"""WITH {EMB}, d AS (SELECT b.label, b.vec_id AS query, a.vec_id, {COS} AS distance FROM e b JOIN e a ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM d),
    o AS (SELECT * FROM r WHERE query // 40 = vec_id // 40), n AS (SELECT label, CAST(COUNT(*) - 1 AS BIGINT) AS candidates FROM e GROUP BY label)
    SELECT label, CAST(COUNT(*) AS BIGINT) AS tested, candidates, round_even(AVG(CAST(rank <= 10 AS DOUBLE)), 3) AS hit_rate, round_even(10.0::DOUBLE / candidates, 3) AS chance, round_even(AVG(CAST(rank <= 10 AS DOUBLE)) / (10.0::DOUBLE / candidates), 1) AS lift,
      CAST(floor(median(rank)) AS INT) AS median_rank FROM o JOIN n USING (label) GROUP BY label, candidates""",
)
def self_season_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well rows of one person (forty vectors in a row) find each other within their label: all of them, by exact ranks."""
    people = _vectors(spark, sf_dir).withColumn("person", F.floor(F.col("vec_id") / 40))
    return validate.own_season_report(people, "vec_id", "v", "label", "person")


@query("squad_profile", f"WITH {CATS}, t AS (SELECT team, league, season, SUM(cat_attack * mins) / SUM(mins) AS attack FROM ca GROUP BY ALL), l AS (SELECT league, season, median(cat_attack) AS mid FROM ca GROUP BY ALL) SELECT team, season, round_even(attack, 3) AS attack, round_even(mid, 3) AS league_median FROM t JOIN l USING (league, season)")
def squad_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    clubs = rows.groupBy("team", "league", "season").agg((F.sum(F.col("cat_attack") * F.col("minutes")) / F.sum("minutes")).alias("attack"))
    league = rows.groupBy("league", "season").agg(F.median("cat_attack").alias("mid"))
    return clubs.join(league, ["league", "season"]).select("team", "season", round_even(F.col("attack"), 3).alias("attack"), round_even(F.col("mid"), 3).alias("league_median"))


@query("trajectory", f"WITH {PS} SELECT player_id, season, shots, CAST(row_number() OVER (PARTITION BY player_id ORDER BY season) AS INT) AS step FROM ps QUALIFY COUNT(*) OVER (PARTITION BY player_id) >= 2")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("player_id")
    ps = player_seasons(spark, sf_dir).select("player_id", "season", "shots", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("season")).alias("step"))
    return ps.where("n >= 2").drop("n")


@query("publish_gate", f"WITH {PS}, a AS (SELECT season, COUNT(*) AS n FROM ps GROUP BY season), b AS (SELECT season, COUNT(*) AS m FROM ps WHERE season <> 1999 AND (season <> 2000 OR player_id % 5 > 0) GROUP BY season) SELECT season, CAST(n AS BIGINT) AS before, CAST(COALESCE(m, 0) AS BIGINT) AS after, COALESCE(m, 0) < 0.9::DOUBLE * n AS refused FROM a LEFT JOIN b USING (season)")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = player_seasons(spark, sf_dir)
    return validate.shrinkage_gate(ps, ps.where("season <> 1999 AND (season <> 2000 OR player_id % 5 > 0)"), "season")


@query("cluster_purity", "WITH c AS (SELECT vec_id % 4 AS c, label FROM embeddings), n AS (SELECT c, label, COUNT(*) AS n FROM c GROUP BY ALL), a AS (SELECT c, MAX(n) AS top, SUM(n) AS a FROM n GROUP BY c), b AS (SELECT label, SUM(n) AS b FROM n GROUP BY label), s AS (SELECT (SELECT SUM(a) FROM a) AS n, (SELECT SUM(top) FROM a) AS top, (SELECT SUM(a * (a - 1) / 2.0::DOUBLE) FROM a) AS pa, (SELECT SUM(b * (b - 1) / 2.0::DOUBLE) FROM b) AS pb, (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) FROM n) AS pab) SELECT CAST(n AS BIGINT) AS n, round_even(top / n, 4) AS purity, round_even((pab - pa * pb / (n * (n - 1) / 2.0::DOUBLE)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2.0::DOUBLE)), 4) AS ari FROM s")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.purity(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("c"), "label"), "c", "label")


@query("silhouette", f"WITH {EMB}, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, AVG(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL), s AS (SELECT vec_id, la, MIN(d) FILTER (la = lb) AS own, MIN(d) FILTER (la <> lb) AS other FROM p GROUP BY ALL) SELECT vec_id, round_even(COALESCE((other - own) / GREATEST(own, other), 0), 5) AS silhouette FROM s")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact silhouettes of every hundredth vector, against all of them."""
    out = models.exact_silhouette(_vectors(spark, sf_dir), "vec_id", "v", "label", F.col("vec_id") % 100 == 0)
    return out.select("vec_id", round_even(F.col("silhouette"), 5).alias("silhouette"))


@query("kmeans_archetypes")
def kmeans_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label clustered, each into as many clusters as suit it best among all numbers that it may have."""
    v = _vectors(spark, sf_dir).withColumn("grp", F.col("label").cast("int"))
    choices = clusters.select_clusters(v, "vec_id", "v", "grp")
    return clusters.assigned(v, "v", "grp", choices).select("vec_id", "label", "cluster")


@query("cluster_choice")
def cluster_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was held against each other: silhouette, inertia and least cluster of each number of clusters of each label."""
    v = _vectors(spark, sf_dir).withColumn("grp", F.col("label").cast("int"))
    rows = [(g, k, fit.silhouette, fit.inertia, min(fit.sizes), k == c.k, k == c.elbow) for g, c in clusters.select_clusters(v, "vec_id", "v", "grp").items() for k, fit in c.fits.items()]
    return spark.createDataFrame(rows, "label int, k int, silhouette double, inertia double, smallest int, chosen boolean, elbow boolean")  # a row a number


@query("nearest_archetype", f"WITH {EMB}, c AS (SELECT vec_id AS k, v AS c FROM e WHERE vec_id IN (3, 5, 8)), d AS (SELECT e.vec_id, round_even(list_distance(v, c), 9) AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(v, c), k) - 1 AS r, CAST(CASE k WHEN 3 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS INT) AS cluster FROM e, c) SELECT vec_id, cluster FROM d WHERE r = 0")
def nearest_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to fixed centres: three of the vectors."""
    v = _vectors(spark, sf_dir)
    centers = [r["v"] for r in v.where("vec_id IN (3, 5, 8)").orderBy("vec_id").collect()]  # three rows
    return clusters.Clusters(3, centers, 0.0).assign(v, "v").select("vec_id", "cluster")


@query("pca_map")
def pca_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pca_map(_vectors(spark, sf_dir), "v")[0].select("vec_id", "label", "pc_1", "pc_2")


LINES = f"""{CATS}, l AS (SELECT 'season=' || season AS folder, concat_ws(',', player_id, team, mins::BIGINT, matches, COALESCE(floor(cat_attack)::BIGINT::VARCHAR, ''), COALESCE(floor(cat_defence)::BIGINT::VARCHAR, '')) AS line, team, player_id FROM ca),
  n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY team, player_id, line) AS nth, floor(20000 / (MAX(strlen(line)) OVER (PARTITION BY folder) + 1))::BIGINT AS each FROM l)"""


@query("season_payload", f"WITH {LINES} SELECT folder, CAST((nth - 1) // each AS INT) AS part, CAST(COUNT(*) AS BIGINT) AS rows, sha256(string_agg(line, chr(10) ORDER BY nth)) AS sha256 FROM n GROUP BY ALL")
def season_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of all seasons would write: each part's rows and digest, parts of 20,000 bytes."""
    whole = lambda c: F.floor(c).cast("long")
    rows = scored(spark, sf_dir).select("player_id", "team", F.col("minutes").cast("long").alias("minutes"), "matches", whole("cat_attack").alias("attack"), whole("cat_defence").alias("defence"), "season")
    lines = rows.withColumn("line", files.csv_line(["player_id", "team", "minutes", "matches", "attack", "defence"]))
    return files.parts_of(lines, F.concat(F.lit("season="), F.col("season").cast("string")), ["team", "player_id", "line"], 20_000).drop("text")
