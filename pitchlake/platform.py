"""A session over one pool of player-seasons: build it once, ask it many questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.numbers import cosine, euclid, round_even
from .operators import assembly, blocks, clusters, models, naming, ranking, recruit, report, validate
from .operators.features import category_scores
from .registry.metrics import BOUNDS, LOWER_IS_BETTER, PARENTS
from .scratch import held

KEY = ["player_id", "season"]
#: Groups of fewer rows get no model.
MODEL_ROWS = 18


@dataclass
class Platform:
    """Percentiles, categories and similarity within peer groups (position group and season)."""

    pool: DataFrame
    features: list[str]
    peers: list[str]
    scaler: DataFrame
    baskets: dict[str, tuple[str, ...]]
    lower_is_better: frozenset = LOWER_IS_BETTER
    weights: dict[str, float] = field(default_factory=dict)
    archetypes: dict[object, clusters.Choice] = field(default_factory=dict)
    labels_of_archetypes: DataFrame | None = None

    @classmethod
    def build(
        cls, rows: DataFrame, metrics: list[str], baskets: dict[str, tuple[str, ...]], *, min_minutes: float = 900, seasons=None, leagues=None,
        lower_is_better: frozenset = LOWER_IS_BETTER, weights: dict[str, float] | None = None, ranked: bool = True,
    ) -> Platform:
        """Scope, fold thin groups, rank every metric among peers in one long window, score categories, scale features.

        Without ``ranked``, the pool has no percentiles and categories, for questions that are about vectors alone.
        """
        pool = rows.where(F.col("minutes") >= min_minutes)
        if seasons:
            pool = pool.where(F.col("season").isin(*seasons))
        if leagues:
            pool = pool.where(F.col("league").isin(*leagues))
        pool = ranking.fold_thin_groups(pool, "position_group", PARENTS, BOUNDS.thin_group)
        peers = ["position_group", "season"]
        # Only a pool of both genders is split by it.
        if "gender" in pool.columns and pool.agg(F.countDistinct("gender")).first()[0] > 1:
            peers.append("gender")
        if ranked:
            long = models.long_form(pool, [*KEY, *[p for p in peers if p not in KEY]], metrics)
            pct = ranking.percentiles(long, "value", [*peers, "metric"], "pct", F.col("metric").isin(*lower_is_better) if lower_is_better else False)
            wide = pct.groupBy(*KEY).agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"pct_{m}") for m in metrics])
            scored = held(category_scores(pool.join(wide, KEY), baskets))  # the scaler and every question read it
        else:
            scored = pool.dropna(subset=KEY)
        scaler = models.fitted_scaler(scored, metrics, ["position_group"])
        w = {m: float((weights or {}).get(m, 1.0)) for m in metrics}
        return cls(cls._with_vectors(models.apply_scaler(scored, scaler, metrics, ["position_group"]), metrics, w), metrics, peers, scaler, baskets, lower_is_better, w)

    @staticmethod
    def _with_vectors(scaled: DataFrame, metrics: list[str], weights: dict[str, float]) -> DataFrame:
        z = F.array(*[F.col(f"z_{m}") for m in metrics])
        return scaled.withColumn("vector", models.weighted_vector(z, [weights[m] for m in metrics])).withColumn("row_key", F.concat_ws("|", *KEY))

    def row(self, player_id, season) -> DataFrame:
        return self.pool.where((F.col("player_id") == player_id) & (F.col("season") == season))

    def has(self, column: str) -> bool:
        """Whether anything is measured there."""
        return column in self.pool.columns and not self.pool.where(F.col(column).isNotNull()).isEmpty()

    def peers_of(self, player_id, season) -> DataFrame:
        one = self.row(player_id, season).select(*self.peers)
        return self.pool.join(F.broadcast(one), self.peers, "left_semi")  # one row

    def no_model_reason(self, group: str) -> str | None:
        """Why a group has no model; None if it has one."""
        n = self.pool.where(F.col("position_group") == group).count()
        return f"only {n} players, {MODEL_ROWS} are needed" if n < MODEL_ROWS else None

    def similar(self, player_id, season, n: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        """The nearest players of the group, other seasons of the same one left out; Euclidean likeness is against the group's usual distance."""
        near = models.neighbours(self.pool, self.row(player_id, season), "row_key", "vector", n, metric, by="position_group", person="player_id", where=where)
        met = near.join(self.pool, "row_key")
        if metric == "cosine":
            return met.withColumn("similarity", models.similarity_percent(F.col("distance"))).orderBy("rank")
        usual = validate.reference_distance(self.pool, "row_key", "vector", "position_group")
        return met.join(usual, "position_group").withColumn("similarity", models.similarity_percent(F.col("distance"), F.col("reference"))).drop("reference").orderBy("rank")

    def pair(self, a: tuple, b: tuple, metric: str = "cosine") -> DataFrame:
        """(similarity) of two rows; null across groups."""
        one = lambda k, x: self.row(*k).select(F.col("position_group").alias(f"g{x}"), F.col("vector").alias(f"v{x}"))
        d = 1.0 - cosine(F.col("va"), F.col("vb")) if metric == "cosine" else euclid(F.col("va"), F.col("vb"))
        return one(a, "a").crossJoin(one(b, "b")).select(F.when(F.col("ga") == F.col("gb"), models.similarity_percent(d)).alias("similarity"))  # one row each

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, feature, value_a, value_b, z_a, z_b) for pairs of the pool's rows, by their row keys (a, b)."""
        each = lambda x: models.long_form(self.pool, ["row_key"], self.features).withColumnsRenamed({"row_key": x, "metric": "feature", "value": f"value_{x}"}).join(
            models.long_form(self.pool.select("row_key", *[F.col(f"z_{m}").alias(m) for m in self.features]), ["row_key"], self.features).withColumnsRenamed({"row_key": x, "metric": "feature", "value": f"z_{x}"}), [x, "feature"]
        )
        return pairs.join(each("a"), "a").join(each("b"), ["b", "feature"]).select("a", "b", "feature", "value_a", "value_b", "z_a", "z_b")

    def explain(self, a: tuple, b: tuple, n: int = 5) -> DataFrame:
        """What two rows of the pool share, and where they differ (``naming.contrasts``); ``naming.told`` words it."""
        one = lambda k, x: self.row(*k).select(F.col("row_key").alias(x))
        return naming.contrasts(self.compared(one(a, "a").crossJoin(one(b, "b"))), ["a", "b"], n)  # one row each

    def replacements(self, player_id, season, weights: dict[str, float], n: int = 10, similarity_weight: float = 0.6) -> DataFrame:
        """Of the max(6 n, 60) nearest, the best by similarity and fit; each player once, with how much better he fits than the one replaced."""
        fit = recruit.fit_score(weights)
        one = self.row(player_id, season).select(fit.alias("_fit"))
        near = self.similar(player_id, season, max(6 * n, 60)).withColumn("role_fit", fit).crossJoin(F.broadcast(one))  # one row
        near = near.withColumn("score", round_even(similarity_weight * F.col("similarity") + (1 - similarity_weight) * F.col("role_fit"), 1))
        near = near.withColumn("fit_delta", round_even(F.col("role_fit") - F.col("_fit"), 1)).drop("_fit")
        return ranking.best_of(near, ["player_id"], [F.desc("score"), "row_key"]).orderBy(F.desc("score"), "row_key").limit(n)

    def cheaper_like(self, player_id, season, price: str = "value", n: int = 10) -> DataFrame:
        """The closest at half his price or less and three years younger or more."""
        one = self.row(player_id, season).select(F.col(price).alias("_price"), F.col("age").alias("_age"))
        fits = (F.col(price) <= F.col("_price") / 2) & (F.col("age") <= F.col("_age") - 3)
        near = models.neighbours(self.pool.crossJoin(F.broadcast(one)), self.row(player_id, season), "row_key", "vector", n, by="position_group", person="player_id", where=fits)  # one row
        return near.orderBy("rank")

    def all_similar(self, n: int = 10, metric: str = "cosine") -> DataFrame:
        """(query, rank, row_key, distance): the nearest of every row of the pool, other seasons of the same player left out."""
        return blocks.nearest(self.pool, "row_key", "vector", n, metric, "position_group", "player_id")

    def own_seasons(self, k: int = 10, metric: str = "cosine") -> DataFrame:
        """How well a player's other seasons are found by the seasons themselves (``validate.own_season_report``)."""
        return validate.own_season_report(self.pool, "row_key", "vector", "position_group", "player_id", k, metric)

    def search(self, brief: recruit.Brief, n: int = 20) -> DataFrame:
        return recruit.search(self.pool, brief, n, KEY)

    def matching(self, conditions: list[tuple[str, str, float]], n: int = 20) -> DataFrame:
        """Players whose percentiles meet all conditions."""
        return recruit.matching_profile(self.pool, conditions, KEY, n)

    def squad(self, team: str, season) -> DataFrame:
        return self.pool.where((F.col("team") == team) & (F.col("season") == season)).orderBy(F.desc("minutes"), *KEY)

    def watched(self, entries: DataFrame) -> DataFrame:
        return assembly.watchlist(entries, self.pool)

    def trajectory(self, player_id) -> DataFrame:
        """His seasons in order; none if he has but one."""
        mine = self.pool.where(F.col("player_id") == player_id)
        return mine.withColumn("_n", F.count("*").over(Window.partitionBy("player_id"))).where("_n >= 2").drop("_n").orderBy("season")

    def percentiles(self, player_id, season) -> DataFrame:
        """(key, metric, pct) of one row."""
        long = models.long_form(self.row(player_id, season), KEY, [f"pct_{m}" for m in self.features])
        return long.select(*KEY, F.substring("metric", 5, 1000).alias("metric"), F.col("value").alias("pct"))

    def strengths(self, player_id, season, n: int = 5, least: float = 70.0) -> DataFrame:
        return self.percentiles(player_id, season).where(F.col("pct") >= least).orderBy(F.desc("pct"), "metric").limit(n)

    def weaknesses(self, player_id, season, n: int = 5, most: float = 30.0) -> DataFrame:
        return self.percentiles(player_id, season).where(F.col("pct") <= most).orderBy("pct", "metric").limit(n)

    def league_table(self) -> DataFrame:
        return self.pool.groupBy("league").agg(F.countDistinct("player_id").alias("players"), F.countDistinct("season").alias("seasons"), F.countDistinct("team").alias("teams")).orderBy("league")

    def labels(self) -> DataFrame:
        return self.pool.select("row_key", F.concat(F.col("player_id").cast("string"), F.lit(" - "), "team", F.lit(" ("), "position_group", F.lit(", "), F.col("season").cast("string"), F.lit(")")).alias("label"))

    def find_label(self, label: str) -> DataFrame:
        return self.labels().where(F.col("label") == label)

    def fit_archetypes(self, concepts: dict[str, tuple[str, ...]], words: DataFrame | None = None, template: str = "%s", plain: str = "plain %d", ks: range | None = None) -> DataFrame:
        """(position_group, cluster, players, traits, score, place, label): every group clustered, in the same jobs, and each cluster told by what sets it apart.

        ``concepts``: {name: metrics}; ``words``, ``template`` and ``plain`` as in ``naming.worded``.
        """
        spark = self.pool.sparkSession
        self.archetypes = clusters.select_clusters(self.pool, "row_key", "vector", "position_group", ks=ks)
        total = sum(self.weights.values()) or 1.0
        roots = [(self.weights[m] / total) ** 0.5 for m in self.features]
        centers = [(g, k, m, v / r if r else 0.0) for g, choice in self.archetypes.items() for k, c in enumerate(choice.chosen.centers) for m, v, r in zip(self.features, c, roots, strict=True)]
        long = spark.createDataFrame(centers, "position_group string, cluster int, feature string, z double")  # a row a centre and feature
        traits = naming.distinct_traits(naming.concept_scores(long, naming.concept_table(spark, concepts), ["position_group", "cluster"]), ["position_group"], "cluster")
        no_words = spark.createDataFrame([], "concept string, direction int, word string")
        sizes = spark.createDataFrame([(g, k, n) for g, choice in self.archetypes.items() for k, n in enumerate(choice.chosen.sizes)], "position_group string, cluster int, players long")
        self.labels_of_archetypes = naming.worded(traits, no_words if words is None else words, template, plain).join(sizes, ["position_group", "cluster"])
        return self.labels_of_archetypes

    def with_archetypes(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows (the pool, by default) with the label of the nearest centre of their group; null for groups without clusters."""
        rows = self.pool if rows is None else rows
        near = clusters.assigned(rows, "vector", "position_group", self.archetypes, "_cluster")
        labels = self.labels_of_archetypes.select("position_group", F.col("cluster").alias("_cluster"), F.col("label").alias("archetype"))
        return near.join(labels, ["position_group", "_cluster"], "left").drop("_cluster")

    def project(self, newcomers: DataFrame, metrics: list[str] | None = None) -> DataFrame:
        """Players outside the pool on the regulars' scale, who stay as they are: percentiles as if each alone joined them, categories, vectors.

        All metrics are placed in one long sort; z-scores and gaps are by the regulars' medians, means and deviations.
        """
        metrics = [m for m in (metrics or self.features) if m in newcomers.columns]
        keys = [*KEY, *[p for p in self.peers if p not in KEY]]
        regulars = models.long_form(self.pool, keys, metrics).select(*[k for k in keys if k in self.peers], "metric", "value")
        placed = ranking.place_among(regulars, models.long_form(newcomers, keys, metrics), "value", [*self.peers, "metric"], "pct")
        pct = F.when(F.col("metric").isin(*self.lower_is_better), round_even(100 - F.col("pct"), 1)).otherwise(F.col("pct")) if self.lower_is_better else F.col("pct")
        wide = placed.withColumn("pct", pct).groupBy(*KEY).agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"pct_{m}") for m in metrics])
        gaps = {m: F.lit(None).cast("double") for m in self.features if m not in newcomers.columns}
        scored = category_scores(newcomers.withColumns(gaps).join(wide, KEY, "left"), self.baskets)
        return self._with_vectors(models.apply_scaler(scored, self.scaler, self.features, ["position_group"]), self.features, self.weights)

    def team_profile(self, team: str, season, category: str) -> DataFrame:
        """(team mean weighted by minutes, league median) of a category; unmeasured ones don't weigh."""
        mine = self.pool.where((F.col("team") == team) & (F.col("season") == season) & F.col(category).isNotNull())
        league = self.pool.where(F.col("season") == season).join(mine.select("league").distinct(), "league", "left_semi").agg(F.median(category).alias("league_median"))
        return mine.agg((F.sum(F.col(category) * F.col("minutes")) / F.sum("minutes")).alias("team_mean")).crossJoin(league)  # one row each

    def findings(self, rows: DataFrame | None = None) -> DataFrame:
        """What the figures of rows (the pool, by default) say of each player (``report.findings``)."""
        return report.findings(self.pool if rows is None else rows, self.categories(), KEY)

    def categories(self) -> dict[str, str]:
        """{category: its column}."""
        named = {c: f"cat_{c.lower().replace(' ', '_')}" for c in self.baskets}
        return {c: column for c, column in named.items() if column in self.pool.columns}

    def report(self, player_id, season, name: str) -> str:
        """One player's dossier in Markdown."""
        mine = self.row(player_id, season)
        (row,) = mine.collect()  # one row
        categories = {c: row[column] for c, column in self.categories().items()}
        facts = {"team": row["team"], "season": row["season"], "position": row["position_group"], "minutes": f"{row['minutes']:,.0f}"}
        near = self.similar(player_id, season, 5).select("player_id", "season", "team", "similarity")
        notes = [r["note"] for r in report.noted(self.findings(mine)).collect()]  # a row a rule at most
        return report.player_report(name, facts, categories, self.strengths(player_id, season).select("metric", "pct"), self.weaknesses(player_id, season).select("metric", "pct"), near, notes)


def season_index(platforms: dict[str, Platform]) -> DataFrame:
    """(row_key, season, position_group, team, z): every season's vectors as maps of metric to z-score, in one table."""
    out = None
    for p in platforms.values():
        z = F.map_from_arrays(F.array(*[F.lit(m) for m in p.features]), F.array(*[F.col(f"z_{m}") for m in p.features]))
        each = p.pool.select("row_key", F.col("season").cast("string").alias("season"), "position_group", "team", F.map_filter(z, lambda k, v: v.isNotNull()).alias("z"))
        out = each if out is None else out.union(each)
    return out


def across_seasons(index: DataFrame, row_key: str, n: int = 10, shared: float = 0.6) -> DataFrame:
    """(row_key, season, shared, similarity): the nearest of the group in any season, on the metrics that both have; seasons that share too few are left out."""
    one = index.where(F.col("row_key") == row_key).select("position_group", F.col("z").alias("_q"))
    met = index.where(F.col("row_key") != row_key).join(F.broadcast(one), "position_group")  # one row
    both = F.filter(F.map_entries(F.map_zip_with("z", "_q", lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))), lambda e: e["value"]["a"].isNotNull() & e["value"]["b"].isNotNull())
    add = lambda f: F.aggregate("_both", F.lit(0.0), lambda s, e: s + f(e["value"]["a"], e["value"]["b"]))
    met = met.withColumn("_both", both).withColumn("shared", F.size("_both") / F.size("_q")).where(F.col("shared") >= shared)
    cosine = F.coalesce(add(lambda a, b: a * b) / F.nullif(F.sqrt(add(lambda a, b: a * a)) * F.sqrt(add(lambda a, b: b * b)), F.lit(0.0)), F.lit(0.0))
    return met.select("row_key", "season", round_even(F.col("shared"), 3).alias("shared"), models.similarity_percent(1.0 - cosine).alias("similarity")).orderBy(F.desc("similarity"), "row_key").limit(n)
