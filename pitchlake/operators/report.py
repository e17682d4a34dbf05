"""Stat sheets and reports: small results as Markdown. What is collected here is one player's rows or one row a metric."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_even
from ..registry.metrics import TEAM_CONTEXT

# Ages of the young and the old, minutes of a sample that can be relied on, percentile of the top quartile, goals over expectation worth a
# word, coefficient of a league that has none.
YOUNG, VETERAN, RELIABLE, TOP_QUARTILE, LUCK, UNKNOWN_STRENGTH = 21, 30, 1350, 75, 0.10, 0.8


@dataclass(frozen=True)
class Sheet:
    """What is shown of a player and in which order: ``rows`` {category: metrics}, orders by group, and metrics of keepers and outfield players only."""

    rows: dict[str, tuple[str, ...]]
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keeper_only: frozenset[str] = frozenset()
    outfield_only: frozenset[str] = frozenset()
    headlines: dict[str, tuple[str, ...]] = field(default_factory=dict)
    style: frozenset[str] = frozenset()

    def order(self, group: str) -> list[str]:
        return [c for c in self.orders.get(group, tuple(self.rows)) if c in self.rows]

    def for_group(self, group: str, have) -> list[tuple[str, list[str]]]:
        """(category, metrics) that the feed has; a metric comes once, where it is met first."""
        barred, left, out = self.outfield_only if group == "GK" else self.keeper_only, set(have), []
        for category in self.order(group):
            found = [m for m in dict.fromkeys(self.rows[category]) if m in left and m not in barred]
            left -= set(found)
            if found:
                out.append((category, found))
        return out

    def metrics(self, group: str) -> list[str]:
        return [m for _, ms in self.for_group(group, {m for ms in self.rows.values() for m in ms}) for m in ms]

    def headline(self, group: str, have, n: int = 4) -> list[str]:
        return [m for m in self.headlines.get(group, ()) if m in set(have) and m not in self.style][:n]

    def for_role(self, role: str, group: str, have) -> dict:
        """A role's reading order over its group's sheet, and its headline figures."""
        sheet = dict(self.for_group(group, have))
        return {"order": [c for c in self.order(role) if c in sheet], "headline": self.headline(role, have)}


def category_averages(percentiles: DataFrame, sheet: Sheet, group: str, key: list[str]) -> DataFrame:
    """(key, category, average, metrics): the mean of a row's whole-number percentiles by category, without team readings and matters of style.

    percentiles: key, metric, pct (long form).
    """
    pairs = [(m, c) for c, ms in sheet.for_group(group, {m for ms in sheet.rows.values() for m in ms}) for m in ms if m not in TEAM_CONTEXT and m not in sheet.style]
    of = percentiles.sparkSession.createDataFrame(pairs, "metric string, category string")
    met = percentiles.where("pct IS NOT NULL").join(F.broadcast(of), "metric")  # a row a metric
    return met.groupBy(*key, "category").agg(round_even(F.avg(F.rint("pct")), 1).alias("average"), F.count("*").alias("metrics"))


def markdown_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """A small result as a Markdown table, in its own order."""
    columns = columns or df.columns
    text = lambda x: "" if x is None else f"{x:g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"| {' | '.join(text(r[c]) for c in columns)} |" for r in df.select(*columns).collect()]  # small: one row a metric, group or cell
    return "\n".join([f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |", *lines])


def validation_report(parts: dict[str, DataFrame]) -> str:
    """The checks' small tables one below the other; empty ones are named as such."""
    out = ["# Validation"]
    for title, table in parts.items():
        body = markdown_table(table)
        out += [f"## {title}", body if body.count("\n") > 1 else "Nothing to report."]
    return "\n\n".join(out) + "\n"


#: Findings: what sets them off, and the figures that they carry. Columns: age, minutes, league_tier, league_strength, position_group,
#: np_goals_minus_npxg_per90; best, worst (category, pct) and top (how many categories are in the top quartile), added from the categories.
RULES: dict[str, tuple[str, dict[str, str]]] = {
    "profile": ("best IS NOT NULL", {"best": "best.pct", "worst": "worst.pct"}),
    "ready_young": (f"age <= {YOUNG} AND top > 0", {"age": "age", "categories": "top"}),
    "raw_young": (f"age <= {YOUNG} AND top = 0", {"age": "age"}),
    "veteran": (f"age >= {VETERAN}", {"age": "age"}),
    "small_sample": (f"minutes < {RELIABLE}", {"minutes": "minutes"}),
    "weaker_league": ("league_tier > 1", {"tier": "league_tier", "strength": f"coalesce(league_strength, {UNKNOWN_STRENGTH})"}),
    "finishing": (f"position_group <> 'GK' AND abs(np_goals_minus_npxg_per90) >= {LUCK}", {"over_expected": "np_goals_minus_npxg_per90"}),
}


def findings(rows: DataFrame, categories: dict[str, str], key: list[str], rules: dict[str, tuple[str, dict[str, str]]] = RULES) -> DataFrame:
    """(key, finding, figures, concerning): a row for each rule that a player's row sets off, with the figures that did, for all rows at once.

    ``categories``: {name: column of its score}; ``concerning``: the categories that the finding is about, best first. Columns that the rows lack, and nulls, set nothing off.
    """
    blank = {"age": "double", "minutes": "double", "league_tier": "int", "league_strength": "double", "position_group": "string", "np_goals_minus_npxg_per90": "double"}
    full = rows.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in rows.columns})
    scores = F.array(*[F.struct(F.lit(name).alias("category"), F.col(column).cast("double").alias("pct")) for name, column in categories.items()])
    known = F.array_sort(F.filter(scores, lambda s: s["pct"].isNotNull()), lambda x, y: F.when(x["pct"] > y["pct"], -1).when(x["pct"] < y["pct"], 1).when(x["category"] < y["category"], -1).otherwise(1))
    full = full.withColumn("_known", known).withColumns({"best": F.get("_known", F.lit(0)), "worst": F.try_element_at("_known", F.lit(-1)), "_top": F.filter("_known", lambda s: s["pct"] >= TOP_QUARTILE)})
    full = full.withColumn("top", F.size("_top"))
    about = {"profile": F.array("best.category", "worst.category"), "ready_young": F.transform("_top", lambda s: s["category"])}
    nothing = F.array().cast("array<string>")
    made = [
        F.when(
            F.expr(condition),
            F.struct(
                F.lit(name).alias("finding"), F.map_from_arrays(F.array(*[F.lit(k) for k in figures]), F.array(*[F.expr(f"CAST({x} AS DOUBLE)") for x in figures.values()])).alias("figures"),
                about.get(name, nothing).alias("concerning"),
            ),
        )
        for name, (condition, figures) in rules.items()
    ]
    return full.select(*key, F.explode(F.filter(F.array(*made), lambda m: m.isNotNull())).alias("_m")).select(*key, "_m.*")


#: printf templates of ``noted``: the categories concerned, then the figures in the order of the rule.
NOTES = {
    "profile": "Strongest and weakest categories: %1$s (%2$.0f, %3$.0f)",
    "ready_young": "Aged %2$.1f, among the best quarter in: %1$s",
    "raw_young": "Aged %2$.1f, in no category among the best quarter so far",
    "veteran": "Aged %2$.1f: plan without a later sale",
    "small_sample": "%2$,.0f minutes: too few for steady rates",
    "weaker_league": "Level %2$.0f league: scale figures by %3$.2f",
    "finishing": "%2$+.2f goals per 90 against expectation; seldom lasts",
}


def noted(found: DataFrame, templates: dict[str, str] = NOTES, rules: dict[str, tuple[str, dict[str, str]]] = RULES, out: str = "note") -> DataFrame:
    """``findings`` with a text from the caller's templates; null for findings that have none."""
    text = F.lit(None).cast("string")
    for name, template in templates.items():
        figures = [F.try_element_at("figures", F.lit(k)) for k in rules[name][1]]
        text = F.when(F.col("finding") == name, F.format_string(template, F.array_join("concerning", ", "), *figures)).otherwise(text)
    return found.withColumn(out, text)


def player_report(name: str, facts: dict[str, object], categories: dict[str, float | None], strengths: DataFrame, weaknesses: DataFrame, similar: DataFrame, notes: list[str]) -> str:
    """One player's dossier; the tables are of a few rows each."""
    return "\n\n".join(
        [
            f"# {name}", "\n".join(f"- {k}: {v}" for k, v in facts.items()), "## Findings", "\n".join(f"- {n}" for n in notes), "## Categories",
            "\n".join(f"- {c}: {'not measured' if v is None else f'{v:.1f}'}" for c, v in categories.items()), "## Strengths", markdown_table(strengths), "## Weaknesses", markdown_table(weaknesses),
            "## Similar players", markdown_table(similar),
        ]
    ) + "\n"
