"""Whether the answers hold: recall, bias, growth, agreement."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import euclid, round_even
from ..scratch import held
from . import blocks
from .joins import unique_both_sides
from .models import weighted_neighbours
from .ranking import deciles, medians, quintiles, rank_share, rank_share_of_all


# Balanced accuracies from which two positions are different jobs, and up to which they are one.
APART, ALIKE = 0.75, 0.65


def own_season_report(df: DataFrame, key: str, vector: str, by: str, person: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(by, tested, candidates, hit_rate, chance, lift, median_rank): how often a player's other season is among the k nearest of his group, against chance.

    Each ordered pair of a player's rows is tested by its exact rank among all rows of the group; ranks are counted in blocks, no list of neighbours is made.
    """
    ranks, _ = blocks.counted_ranks(df, key, vector, by, person, metric)
    sizes = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).groupBy(by).agg((F.count("*") - 1).alias("candidates"))
    per = ranks.groupBy(by).agg(F.count("*").alias("tested"), F.avg((F.col("rank") <= k).cast("double")).alias("_hit"))
    per = per.join(medians(ranks, by, "rank", "_median").select(by, F.floor("_median").cast("int").alias("median_rank")), by)
    chance = F.lit(float(k)) / F.greatest(F.col("candidates"), F.lit(1))
    return per.join(sizes, by).select(
        by, "tested", "candidates", round_even(F.col("_hit"), 3).alias("hit_rate"), round_even(chance, 3).alias("chance"), round_even(F.col("_hit") / chance, 1).alias("lift"), "median_rank"
    )


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, minutes: str = "minutes", least: float = 900.0) -> DataFrame:
    """How two feeds agree on a figure, over names unique in both and players with 900 minutes in both."""
    a = left.select(*keys, F.col(value).alias("_a"), F.col(minutes).alias("_ma"))
    b = right.select(*keys, F.col(value).alias("_b"), F.col(minutes).alias("_mb"))
    both = unique_both_sides(a, b, keys).where((F.col("_ma") >= least) & (F.col("_mb") >= least))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.count("*").alias("players"), round_even(F.avg((gap == 0).cast("double")), 4).alias("equal"), round_even(F.avg((gap <= 1).cast("double")), 4).alias("within_one"),
        round_even(F.avg((gap <= 0.05 * F.greatest(F.abs("_a"), F.lit(1.0))).cast("double")), 4).alias("within_5_pct"), round_even(F.corr("_a", "_b"), 4).alias("r"),
    )


def growth(df: DataFrame, score: str, value: str, player: str, index: str, horizon: int = 2) -> DataFrame:
    """Rows with log_growth: log10 of the value ``horizon`` seasons on over today's; null where either is unknown or not above 0."""
    later = df.select(player, (F.col(index) - horizon).alias(index), F.col(value).alias("_later"))
    joined = df.join(later, [player, index], "left")
    return joined.withColumn("log_growth", F.when((F.col(value) > 0) & (F.col("_later") > 0), F.log10(F.col("_later") / F.col(value))))


def growth_by_decile(grown: DataFrame, score: str, value: str) -> DataFrame:
    """(decile, players, median_score, median_value, growth_x, share_up) by deciles of the score among rows followed up; growth as a factor."""
    known = rank_share_of_all(grown.where("log_growth IS NOT NULL"), score, "_share").withColumn("decile", deciles(F.col("_share")))
    return known.groupBy("decile").agg(
        F.count("*").alias("players"), F.median(score).alias("median_score"), F.median(value).alias("median_value"), round_even(F.pow(F.lit(10.0), F.median("log_growth")), 2).alias("growth_x"),
        round_even(F.avg((F.col("log_growth") > 0).cast("double")), 3).alias("share_up"),
    )


# Rows that a backtest and a cell of it need, different scores that a cell needs, ages from which bands begin.
BACKTEST_ROWS, CELL_ROWS, CELL_SCORES = 100, 40, 5
AGE_BANDS = {"under 21": 0, "21-23": 21, "24-27": 24, "28+": 28}


def growth_summary(grown: DataFrame, score: str, top_share: float = 0.10) -> DataFrame:
    """(candidates, tested, coverage, top_growth_x, rest_growth_x, top_up, rest_up, rank_correlation) of the rows with a score; no row under ``BACKTEST_ROWS`` tested.

    The top are the rows from the linearly interpolated quantile of the score on.
    """
    candidates = held(grown.where(F.col(score).isNotNull()))
    tested = candidates.where("log_growth IS NOT NULL")
    cut = tested.agg(F.percentile(score, F.lit(1 - top_share)).alias("_cut"))
    marked = tested.crossJoin(F.broadcast(cut)).withColumn("_top", F.col(score) >= F.col("_cut"))  # one row
    side = lambda top: F.when(F.col("_top") if top else ~F.col("_top"), F.col("log_growth"))
    factor = lambda top: round_even(F.pow(F.lit(10.0), F.median(side(top))), 2)
    up = lambda top: round_even(F.avg((side(top) > 0).cast("double")), 3)
    whole = marked.agg(F.count("*").alias("tested"), factor(True).alias("top_growth_x"), factor(False).alias("rest_growth_x"), up(True).alias("top_up"), up(False).alias("rest_up"))
    rho = spearman(tested.withColumn("_one", F.lit(1)), score, "log_growth", ["_one"]).select(round_even(F.col("rho"), 3).alias("rank_correlation"))
    every = candidates.agg(F.count("*").alias("candidates")).crossJoin(whole).crossJoin(rho)  # one row each
    return every.where(F.col("tested") >= BACKTEST_ROWS).select(
        "candidates", "tested", round_even(F.col("tested") / F.col("candidates"), 3).alias("coverage"), "top_growth_x", "rest_growth_x", "top_up", "rest_up", "rank_correlation"
    )


def growth_cells(grown: DataFrame, score: str, value: str, age: str, ties: list[str]) -> DataFrame:
    """(age_band, value_band, n, rho): the score's rank correlation with growth within cells of age and of fifths of the price at the start.

    Fifths are of first-come ranks of the price among the rows followed up of known age; ``ties`` order equal prices. Cells of too few rows or scores are left out.
    """
    known = grown.where(F.col("log_growth").isNotNull() & F.col(score).isNotNull() & (F.col(age) >= 0) & (F.col(age) < 99))
    band = F.lit(None).cast("string")
    for name, least in AGE_BANDS.items():
        band = F.when(F.col(age) >= least, name).otherwise(band)
    banded = held(quintiles(known, value, ties, "value_band").withColumn("age_band", band))
    cells = ["age_band", "value_band"]
    enough = banded.groupBy(*cells).agg(F.count("*").alias("_n"), F.countDistinct(score).alias("_scores")).where((F.col("_n") >= CELL_ROWS) & (F.col("_scores") >= CELL_SCORES)).select(*cells)
    return spearman(banded.join(enough, cells, "left_semi"), score, "log_growth", cells).where("rho IS NOT NULL AND NOT isnan(rho)")


def growth_strata(cells: DataFrame) -> DataFrame:
    """(cells, players, rank_correlation, positive): the mean of ``growth_cells`` weighted by rows, and how many are positive; no row if there are none."""
    return cells.agg(
        F.count("*").alias("cells"), F.sum("n").alias("players"), round_even(F.sum(F.col("rho") * F.col("n")) / F.sum("n"), 3).alias("rank_correlation"), F.count_if(F.col("rho") > 0).alias("positive")
    ).where("cells > 0")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, rho) over rows that know both, with average ranks."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rank_share(rank_share(known, a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), round_even(F.corr("_ra", "_rb"), 4).alias("rho"))


def purity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(n, purity, ari) of clusters against known classes, from their contingency table."""
    cells = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    per_cluster = cells.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("a"))
    one = per_cluster.agg(F.sum("top").alias("top"), F.sum("a").alias("n"), pairs(F.col("a")).alias("pa"))
    two = cells.groupBy(truth).agg(F.sum("n").alias("b")).agg(pairs(F.col("b")).alias("pb"))
    three = cells.agg(pairs(F.col("n")).alias("pab"))
    every = one.crossJoin(two).crossJoin(three)  # one row each
    chance = F.col("pa") * F.col("pb") / (F.col("n") * (F.col("n") - 1) / 2)
    return every.select("n", round_even(F.col("top") / F.col("n"), 4).alias("purity"), round_even((F.col("pab") - chance) / F.nullif((F.col("pa") + F.col("pb")) / 2 - chance, F.lit(0.0)), 4).alias("ari"))


def shrinkage_gate(before: DataFrame, after: DataFrame, season: str, allowed: float = 0.10) -> DataFrame:
    """Seasons that vanished or lost more than the allowed share of rows."""
    return shrinkage(before.groupBy(season).agg(F.count("*").alias("before")), after.groupBy(season).agg(F.count("*").alias("after")), season, allowed)


def shrinkage(before: DataFrame, after: DataFrame, key: str, allowed: float = 0.10) -> DataFrame:
    """(key, before, after, refused) from numbers of rows by key."""
    both = before.join(after, key, "full_outer").fillna(0, ["before", "after"])
    return both.withColumn("refused", (F.col("before") > 0) & (F.col("after") < (1 - allowed) * F.col("before")))


def role_agreement(neighbours: DataFrame, rows: DataFrame, key: str, role: str, group: str) -> DataFrame:
    """(group, roles, same_role, chance, lift): how often a query's neighbours (query, rank, key) share its role, and how often anybody would."""
    side = rows.select(F.col(key).alias("_k"), F.col(role).alias("_r"), F.col(group).alias("_g"))
    met = neighbours.join(side.withColumnsRenamed({"_k": "query", "_r": "_qr"}), "query").join(side.select(F.col("_k").alias(key), "_r"), key)
    per = met.groupBy("_g", "query").agg(F.avg((F.col("_r") == F.col("_qr")).cast("double")).alias("hit")).groupBy("_g").agg(F.avg("hit").alias("same_role"))
    sizes = rows.where(F.col(role).isNotNull()).groupBy(F.col(group).alias("_g"), role).agg(F.count("*").alias("n"))
    chance = sizes.groupBy("_g").agg(F.count("*").alias("roles"), (F.sum(F.pow("n", 2)) / F.pow(F.sum("n"), 2)).alias("chance"))
    return per.join(chance, "_g").select(
        F.col("_g").alias(group), "roles", round_even(F.col("same_role"), 3).alias("same_role"), round_even(F.col("chance"), 3).alias("chance"), round_even(F.col("same_role") / F.col("chance"), 2).alias("lift")
    )


def hashed_pairs(rows: DataFrame, key: str, vector: str, group: str, each: int = 4) -> DataFrame:
    """(group, a, b, x, y): ``each`` partners for every row, those next to it in the order of a hash; so a sample of pairs that is the same every time.

    Stands for random pairs: neighbours by a hash are unlike as any two rows are. Each group is sorted in 64 parts, none of which is gathered.
    """
    digest = lambda salt: F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    part = F.conv(F.substring(digest(1), 1, 2), 16, 10).cast("int") % 64
    parts = rows.select(F.col(group).alias("_g"), F.col(key).alias("a"), F.col(vector).alias("x"), part.alias("_part"), digest(2).alias("_h"))
    w = Window.partitionBy("_g", "_part").orderBy("_h", "a")
    ahead = parts.withColumn("_ahead", F.array(*[F.lead(F.struct("a", "x"), k).over(w) for k in range(1, each + 1)]))
    met = ahead.withColumn("p", F.explode("_ahead")).where("p IS NOT NULL")
    return met.select(F.col("_g").alias(group), "a", F.col("p.a").alias("b"), "x", F.col("p.x").alias("y"))


def reference_distance(rows: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(group, reference): the median distance of pairs of the group, 1 where it is 0 or there are none."""
    return hashed_pairs(rows, key, vector, group).groupBy(group).agg(F.median(euclid(F.col("x"), F.col("y"))).alias("_m")).select(group, F.coalesce(F.nullif("_m", F.lit(0.0)), F.lit(1.0)).alias("reference"))


def feature_dominance(rows: DataFrame, key: str, vector: str, group: str, features: list[str], weights: list[float]) -> DataFrame:
    """(group, feature, weight_share, distance_share, vs_even): each feature's mean share of the squared weighted distance of pairs."""
    total = sum(weights) or 1.0
    shares = [w / total for w in weights]
    w = F.array(*[F.lit(float(s)) for s in shares])
    squares = F.zip_with(F.zip_with("x", "y", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), w, lambda d, s: d * s)
    each = hashed_pairs(rows, key, vector, group).select(group, squares.alias("_d")).withColumn("_t", F.aggregate("_d", F.lit(0.0), lambda s, v: s + v))
    share = each.select(group, F.posexplode(F.transform("_d", lambda v: F.coalesce(v / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)))).alias("k", "share"))
    mean = share.groupBy(group, "k").agg(F.avg("share").alias("s"))
    name = F.array(*[F.lit(f) for f in features])
    return mean.select(
        group, F.get(name, F.col("k")).alias("feature"), round_even(F.get(w, F.col("k")), 4).alias("weight_share"), round_even(F.col("s"), 4).alias("distance_share"),
        round_even(F.col("s") * len(features), 2).alias("vs_even"),
    )


def compared(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(top_k_overlap, rank_correlation) of two lists of neighbours (query, rank, key): mean Jaccard, and mean Spearman over at least three in both."""
    both = base.select("query", key, F.col("rank").alias("_a")).join(other.select("query", key, F.col("rank").alias("_b")), ["query", key], "full_outer")
    order = Window.partitionBy("query")
    met = both.withColumn("_both", F.col("_a").isNotNull() & F.col("_b").isNotNull())
    # Ranks among those that both lists have.
    met = met.withColumns({c: F.when(F.col("_both"), F.rank().over(order.orderBy(F.when(F.col("_both"), F.col(c)).asc_nulls_last()))) for c in ("_a", "_b")})
    per = met.groupBy("query").agg((F.count_if("_both") / F.count("*")).alias("overlap"), F.when(F.count_if("_both") >= 3, F.corr("_a", "_b")).alias("rho"))
    return per.agg(round_even(F.avg("overlap"), 3).alias("top_k_overlap"), round_even(F.avg("rho"), 3).alias("rank_correlation"))


def sensitivity(rows: DataFrame, queries: DataFrame, key: str, vector: str, group: str, features: list[str], weights: list[float], changes: dict[str, dict[str, float]], k: int = 10) -> DataFrame:
    """(change, top_k_overlap, rank_correlation): how much of the neighbours stays if weights are multiplied; ``changes``: {name: {feature: factor}}.

    A factor of 0 takes a feature out. ``queries`` are rows of the table, all of them if wanted; they meet it in blocks, once for all changes.
    """
    weighted = [weights, *([w * factors.get(f, 1.0) for f, w in zip(features, weights, strict=True)] for factors in changes.values())]
    found, out = held(weighted_neighbours(rows, queries, key, vector, k, weighted, by=group)), None
    of = lambda at: found.where(F.col("scale") == at).drop("scale")
    for at, name in enumerate(changes, 1):
        row = compared(of(0), of(at), key).select(F.lit(name).alias("change"), "*")
        out = row if out is None else out.union(row)
    return out


def dropped(features: list[str]) -> dict[str, dict[str, float]]:
    """Changes that take out one feature at a time."""
    return {f: {f: 0.0} for f in features}


def reweighted(baskets: dict[str, tuple[str, ...]], features: list[str], factor: float = 3.0) -> dict[str, dict[str, float]]:
    """Changes that multiply the weights of one basket at a time."""
    return {name: found for name, ms in baskets.items() if (found := {m: factor for m in ms if m in features})}


def separability(rows: DataFrame, pairs: list[tuple[str, str, bool]], position: str, key: str, features: list[str], folds: int = 5, fewest: int = 60, seed: int = 7) -> DataFrame:
    """(pair, players, balanced_accuracy, majority_class, verdict): whether two positions can be told apart by their own figures.

    ``pairs``: (first, second, modelled apart). A logistic regression on standardised figures (gaps: the pair's medians), judged on folds dealt by a hash
    of the key within each class; balanced accuracy is the mean of both classes' recalls. Pairs of fewer players are left out.
    """
    spark, out = rows.sparkSession, []
    for first, second, apart in pairs:
        both = rows.where(F.col(position).isin(first, second)).withColumn("label", (F.col(position) == first).cast("double"))
        n, ones, *middle = both.agg(F.count("*"), F.sum("label"), *[F.median(f) for f in features]).first()
        if n < fewest or not 0 < (ones or 0) < n:
            continue
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0 if m is None else float(m))) for f, m in zip(features, middle, strict=True)])
        data = both.select("label", array_to_vector(values).alias("raw"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold")).persist()
        right = None
        for fold in range(folds):
            model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=100, regParam=1.0 / n, featuresCol="features", labelCol="label")]).fit(data.where(F.col("fold") != fold))
            told = model.transform(data.where(F.col("fold") == fold)).groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("recall"))
            right = told if right is None else right.union(told)
        accuracy = right.groupBy("label").agg(F.avg("recall").alias("r")).agg(F.avg("r")).first()[0]
        data.unpersist()
        finding, agrees = ("different jobs", apart) if accuracy >= APART else ("the same job", not apart) if accuracy <= ALIKE else ("borderline", True)
        out.append((f"{first} / {second}", n, round(accuracy, 3), round(max(ones, n - ones) / n, 3), finding if agrees else f"{finding}, against the taxonomy"))
    return spark.createDataFrame(out, "pair string, players long, balanced_accuracy double, majority_class double, verdict string")


def repeatability(rel: DataFrame, group: str = "position_group") -> DataFrame:
    """(group, metrics, mean_r, least_r, most_r, under_half) over reliability's rows."""
    return rel.groupBy(group).agg(
        F.count("*").alias("metrics"), round_even(F.avg("r"), 3).alias("mean_r"), F.min("r").alias("least_r"), F.max("r").alias("most_r"), F.count_if(F.col("r") < 0.5).alias("under_half")
    )


def team_bias(neighbours: DataFrame, rows: DataFrame, key: str, team: list[str]) -> DataFrame:
    """(pairs, same_team, chance): share of neighbours from the query's own team, and what chance would give."""
    side = rows.select(F.col(key).alias("_k"), F.struct(*team).alias("_t"))
    met = neighbours.join(side.withColumnsRenamed({"_k": "query", "_t": "_qt"}), "query").join(side.withColumnRenamed("_k", key), key)
    sizes = rows.groupBy(*team).agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    chance = sizes.agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.nullif(F.first("_all") * (F.first("_all") - 1), F.lit(0))).alias("chance"))
    out = met.agg(F.count("*").alias("pairs"), F.avg((F.col("_t") == F.col("_qt")).cast("double")).alias("same_team"))
    return out.crossJoin(chance)  # one row each
