"""Finding players: briefs, fit, price lines, hidden gems."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip, round_even, true
from ..registry.metrics import GEM_WEIGHTS, normalised
from .ranking import rank_share_of_all

OPERATORS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
AGE_FLOOR, AGE_CEILING, FULL_MINUTES, LINE_PLAYERS = 19.0, 27.0, 1800.0, 30


@dataclass(frozen=True)
class AgeRange:
    """Bounds that only exclude unknown ages once somebody has set them."""

    low: float
    high: float
    active: bool = True

    def mask(self, age: Column) -> Column:
        return F.coalesce(age.between(self.low, self.high), F.lit(not self.active))


@dataclass
class Brief:
    """What is looked for; fields left out don't filter."""

    groups: tuple[str, ...] = ()
    min_minutes: float | None = None
    max_minutes: float | None = None
    age: AgeRange | None = None
    leagues: tuple[str, ...] = ()
    seasons: tuple = ()
    max_strength: float | None = None
    max_price: float | None = None
    foot: str | None = None
    positions: tuple[str, ...] = ()
    flanks: tuple[str, ...] = ()
    footed_sides: tuple[str, ...] = ()
    thresholds: tuple[tuple[str, str, float], ...] = ()
    weights: dict[str, float] = field(default_factory=dict)

    def condition(self) -> Column:
        """All filters as one condition; unknown prices pass, other unknowns don't."""
        c, parts = F.col, []
        for column, values in (("position_group", self.groups), ("league", self.leagues), ("season", self.seasons), ("position", self.positions), ("flank", self.flanks), ("footed_side", self.footed_sides)):
            if values:
                parts.append(true(c(column).isin(*values)))
        if self.min_minutes is not None:
            parts.append(true(c("minutes") >= self.min_minutes))
        if self.max_minutes is not None:
            parts.append(true(c("minutes") <= self.max_minutes))
        if self.age:
            parts.append(self.age.mask(c("age")))
        if self.max_strength is not None:
            parts.append(true(c("league_strength") <= self.max_strength))
        if self.max_price is not None:
            parts.append(F.coalesce(c("price") <= self.max_price, F.lit(True)))
        if self.foot:
            parts.append(true(F.lower("foot") == self.foot.lower()))
        parts += [true(OPERATORS[op](c(metric), value)) for metric, op, value in self.thresholds]
        return reduce(operator.and_, parts, F.lit(True))

    def summary(self) -> str:
        return ", ".join(f"{m} {op} {v:g}" for m, op, v in self.thresholds) or "no thresholds"


def fit_score(weights: dict[str, float]) -> Column:
    """Weighted mean of category scores (50 where unknown); each part is rounded before they are added."""
    shares = normalised(weights)
    parts = [round_even(F.coalesce(F.col(k), F.lit(50.0)) * (w / 100.0), 2) for k, w in shares.items()]
    return round_even(reduce(operator.add, parts), 1)


def search(pool: DataFrame, brief: Brief, n: int, key: list[str]) -> DataFrame:
    """The n best fits of a brief with their rank."""
    found = pool.where(brief.condition()).withColumn("fit_score", fit_score(brief.weights)).orderBy(F.desc("fit_score"), *key).limit(n)
    return found


def age_upside(age: Column) -> Column:
    return round_even(clip(100.0 * (AGE_CEILING - age) / (AGE_CEILING - AGE_FLOOR), 0, 100), 1)


def sample_size(minutes: Column) -> Column:
    return round_even(clip(100.0 * (minutes / FULL_MINUTES), 0, 100), 1)


def exposure(df: DataFrame, strength: str, out: str) -> DataFrame:
    """100 in the weakest league of the pool, 0 in the strongest; null where all are alike."""
    ends = df.agg(F.min(strength).alias("_lo"), F.max(strength).alias("_hi"))
    score = 100.0 * (F.col("_hi") - F.col(strength)) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, round_even(score, 1)).drop("_lo", "_hi")  # one row


def value_for_money(df: DataFrame, performance: str, price: str, out: str) -> DataFrame:
    """Rank share of output per price, in percent."""
    per = df.withColumn("_v", F.when(F.col(price) > 0, F.col(performance) / F.col(price)))
    return rank_share_of_all(per.withColumnRenamed("_v", "_per"), "_per", "_share").withColumn(out, round_even(F.col("_share") * 100, 1)).drop("_per", "_share")


def price_line(df: DataFrame, performance: str, price: str, group: str) -> DataFrame:
    """value_residual: how far the log price is above what the group pays for that output; value_residual_pct: how cheap that is.

    A group needs 30 priced players whose outputs differ.
    """
    known = df.withColumn("_y", F.when((F.col(price) > 0) & F.col(performance).isNotNull(), F.log10(price)))
    usable = known.where("_y IS NOT NULL")
    line = usable.groupBy(group).agg(
        F.regr_slope("_y", performance).alias("_slope"), F.regr_intercept("_y", performance).alias("_at0"), F.count("*").alias("_n"), (F.max(performance) - F.min(performance)).alias("_range")
    )
    line = line.where((F.col("_n") >= LINE_PLAYERS) & (F.col("_range") > 1e-9)).select(group, "_slope", "_at0")
    fitted = known.join(line, group, "left").withColumn("value_residual", F.col("_y") - (F.col("_at0") + F.col("_slope") * F.col(performance)))
    ranked = rank_share_of_all(fitted, "value_residual", "_share")
    return ranked.withColumn("value_residual_pct", round_even((1 - F.col("_share")) * 100, 1)).drop("_y", "_slope", "_at0", "_share")


def price_fit(df: DataFrame, performance: str, price: str, group: str) -> DataFrame:
    """(group, players, slope, intercept, r2) of the log price on performance; a group needs 30 priced players."""
    known = df.where((F.col(price) > 0) & F.col(performance).isNotNull()).withColumn("_y", F.log10(price))
    fit = known.groupBy(group).agg(
        F.count("*").alias("players"), F.regr_slope("_y", performance).alias("slope"), F.regr_intercept("_y", performance).alias("intercept"), F.regr_r2("_y", performance).alias("r2")
    )
    return fit.where(F.col("players") >= LINE_PLAYERS)


def matching_profile(pool: DataFrame, conditions: list[tuple[str, str, float]], key: list[str], n: int | None = None) -> DataFrame:
    """Rows whose percentiles (pct_<metric>) meet all conditions (metric, operator, value), the best mean of those first; unmeasured ones fail."""
    wanted = [true(OPERATORS[op](F.col(f"pct_{m}"), v)) for m, op, v in conditions]
    mean = reduce(operator.add, [F.col(f"pct_{m}") for m, _, _ in conditions]) / len(conditions) if conditions else F.lit(None)
    found = pool.where(reduce(operator.and_, wanted, F.lit(True))).withColumn("profile_mean", mean).orderBy(F.desc("profile_mean"), *key)
    return found.limit(n) if n else found


def gem_score(components: dict[str, str], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the components that a row has; components: {name: column}."""
    w = weights or GEM_WEIGHTS
    total = reduce(operator.add, [F.when(F.col(c).isNotNull(), F.col(c) * float(w.get(n, 0))).otherwise(0.0) for n, c in components.items()])
    used = reduce(operator.add, [F.when(F.col(c).isNotNull(), float(w.get(n, 0))).otherwise(0.0) for n, c in components.items()])
    return round_even(total / F.when(used > 0, used), 1)


def cheaper_alternatives(pool: DataFrame, reference: DataFrame, key: str, max_age_delta: float = 0.0, lower_league: bool = False) -> DataFrame:
    """Players younger than the reference row by some years and, if asked, in a weaker league."""
    one = reference.limit(1).select(F.col(key).alias("_key"), F.col("age").alias("_age"), F.col("league_strength").alias("_strength"))
    young = F.col("_age").isNull() | true(F.col("age") <= F.col("_age") - max_age_delta)
    weaker = true(F.col("league_strength") < F.col("_strength")) if lower_league else F.lit(True)
    return pool.crossJoin(F.broadcast(one)).where((F.col(key) != F.col("_key")) & young & weaker).drop("_key", "_age", "_strength")  # one row
