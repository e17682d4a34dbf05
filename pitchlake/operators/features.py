"""Metrics of a player-season, as one generated projection a step."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip, ratio, round_even
from ..registry import metrics as M



def _exposure() -> Column:
    return F.nullif(F.col("minutes") / 90.0, F.lit(0.0))


def per90(df: DataFrame, stats: Iterable[str]) -> DataFrame:
    """<stat>_per90 for each counting stat that the table has; unrounded."""
    return df.withColumns({f"{s}_per90": F.col(s) / _exposure() for s in stats if s in df.columns and s not in M.NOT_PER90})


def shrunk_by_table(df: DataFrame, specs: dict[str, tuple[str, str, float]], by: list[str], scale: float = 100.0, digits: int = 2) -> DataFrame:
    """Shrunken ratios {out: (success, attempts, prior)}: one small aggregate over groups, joined back, so rows aren't sorted."""
    if not specs:
        return df
    pools = [x for out, (s, a, _) in specs.items() for x in (F.sum(s).alias(f"_s_{out}"), F.sum(a).alias(f"_a_{out}"))]
    groups = df.groupBy(*by).agg(*pools)
    total = df.agg(*pools).select(*[F.col(f"_{k}_{out}").alias(f"_all_{k}_{out}") for out in specs for k in "sa"])
    joined = df.join(F.broadcast(groups), by, "left").crossJoin(F.broadcast(total))  # one row of totals

    def rate(out: str) -> Column:
        s, a, prior = specs[out]
        own = F.col(f"_s_{out}") / F.when(F.col(f"_a_{out}") > 0, F.col(f"_a_{out}"))
        everyone = F.col(f"_all_s_{out}") / F.when(F.col(f"_all_a_{out}") > 0, F.col(f"_all_a_{out}"))
        value = (F.col(s) + prior * F.coalesce(own, everyone)) / (F.col(a) + prior)
        return round_even(F.when(F.col(f"_all_a_{out}") > 0, value) * scale, digits)

    return joined.withColumns({out: rate(out) for out in specs}).select(*df.columns, *specs)


def derived(df: DataFrame) -> DataFrame:
    """Composites, shares and differences whose parts the table has; null where a part is."""
    has, x, c = set(df.columns), _exposure(), F.col

    def total(*parts: str) -> Column:
        out = c(parts[0])
        for p in parts[1:]:
            out = out + c(p)
        return out

    def each90(*parts: str) -> Column:
        return round_even(total(*parts) / x, 3)

    def share(part: str, *whole: str) -> Column:
        return round_even(100.0 * ratio(c(part), total(*whole)), 2)

    keeper = c("position_group") == "GK" if "position_group" in has else F.lit(True)
    specs: dict[str, tuple[tuple[str, ...], Column]] = {
        "np_goals_minus_npxg_per90": (("np_goals", "npxg"), round_even((c("np_goals") - c("npxg")) / x, 3)),
        "aerials_contested_per90": (("aerials_won", "aerials_lost"), each90("aerials_won", "aerials_lost")),
        "defensive_actions_per90": (("tackles", "interceptions", "blocks", "clearances"), each90("tackles", "interceptions", "blocks", "clearances")),
        "progressive_actions_per90": (("progressive_passes", "progressive_carries"), each90("progressive_passes", "progressive_carries")),
        "pressured_pass_share": (("passes_under_pressure", "passes_attempted"), share("passes_under_pressure", "passes_attempted")),
        "open_play_npxg_share": (("npxg_open_play", "npxg"), share("npxg_open_play", "npxg")),
        "clean_sheet_rate": (("clean_sheets", "matches"), share("clean_sheets", "matches")),
        "starts_share": (("starts", "matches"), clip(share("starts", "matches"), high=100)),
        "goal_involvements_per90": (("goals", "assists"), each90("goals", "assists")),
        "xgi_per90": (("xg", "xa"), each90("xg", "xa")),
        "np_goal_contributions_per90": (("np_goals", "assists"), each90("np_goals", "assists")),
        "contributions_above_expected_per90": (("np_goals", "assists", "npxg", "xa"), round_even((c("np_goals") + c("assists") - c("npxg") - c("xa")) / x, 3)),
        "possession_lost_per90": (("miscontrols", "dispossessed"), each90("miscontrols", "dispossessed")),
        "att_third_touch_share": (("touches_att_third", "touches_mid_third", "touches_def_third"), share("touches_att_third", "touches_att_third", "touches_mid_third", "touches_def_third")),
        "mid_third_touch_share": (("touches_att_third", "touches_mid_third", "touches_def_third"), share("touches_mid_third", "touches_att_third", "touches_mid_third", "touches_def_third")),
        "def_third_touch_share": (("touches_att_third", "touches_mid_third", "touches_def_third"), share("touches_def_third", "touches_att_third", "touches_mid_third", "touches_def_third")),
        "box_touch_share": (("touches_att_pen", "touches"), share("touches_att_pen", "touches")),
        "att_third_tackle_share": (("tackles_att_third", "tackles_mid_third", "tackles_def_third"), share("tackles_att_third", "tackles_att_third", "tackles_mid_third", "tackles_def_third")),
        "pass_progress_per_pass": (("progressive_pass_distance", "passes_attempted"), round_even(ratio(c("progressive_pass_distance"), c("passes_attempted")), 2)),
        "carry_progress_per_carry": (("progressive_carry_distance", "carries"), round_even(ratio(c("progressive_carry_distance"), c("carries")), 2)),
        "set_piece_sca_share": (("sca_set_piece", "sca"), share("sca_set_piece", "sca")),
        "gk_psxg_minus_ga_per90": (("gk_psxg", "gk_goals_against"), F.when(keeper, round_even((c("gk_psxg") - c("gk_goals_against")) / x, 3))),
        "gk_xgc_minus_ga_per90": (("xgc", "gk_goals_against"), F.when(keeper, round_even((c("xgc") - c("gk_goals_against")) / x, 3))),
        "tackles_interceptions_per90": (("tackles", "interceptions"), each90("tackles", "interceptions")),
        "dribbled_past_per90": (("dribblers_challenged", "dribblers_tackled"), round_even((c("dribblers_challenged") - c("dribblers_tackled")) / x, 3)),
        "passes_blocked_per90": (("blocks", "shots_blocked"), round_even((c("blocks") - c("shots_blocked")) / x, 3)),
        "npxg_xa_per90": (("npxg", "xa"), each90("npxg", "xa")),
        "assists_minus_xa_per90": (("assists", "xa"), round_even((c("assists") - c("xa")) / x, 3)),
        "short_pass_share": (("short_passes_attempted", "passes_attempted"), share("short_passes_attempted", "passes_attempted")),
        "medium_pass_share": (("medium_passes_attempted", "passes_attempted"), share("medium_passes_attempted", "passes_attempted")),
        "long_pass_share": (("long_passes_attempted", "passes_attempted"), share("long_passes_attempted", "passes_attempted")),
        "progressive_pass_rate": (("progressive_passes", "passes_attempted"), share("progressive_passes", "passes_attempted")),
        "progressive_carry_rate": (("progressive_carries", "carries"), share("progressive_carries", "carries")),
        "turnover_rate": (("miscontrols", "dispossessed", "touches"), round_even(100.0 * ratio(c("miscontrols") + c("dispossessed"), c("touches")), 2)) if {"miscontrols", "dispossessed"} <= has else ((), F.lit(None)),
        "take_on_rate": (("dribbles_attempted", "touches"), share("dribbles_attempted", "touches")),
        "buildup_share": (("xg_buildup", "xg_chain"), clip(round_even(100.0 * c("xg_buildup") / F.when(c("xg_chain") >= 0.5, c("xg_chain")), 2), high=100)),
        "ict": (("influence", "creativity", "threat"), F.coalesce("influence", F.lit(0.0)) + F.coalesce("creativity", F.lit(0.0)) + F.coalesce("threat", F.lit(0.0))),
    }
    return df.withColumns({name: e for name, (needs, e) in specs.items() if needs and set(needs) <= has})


def ratios(df: DataFrame, by: list[str]) -> DataFrame:
    """The registered ratios whose parts the table has; keeper ratios for keepers only."""
    helpers = {"_aerials_total": ("aerials_won", "aerials_lost"), "_saves_plus_conceded": ("gk_saves", "gk_goals_against")}
    base = df.withColumns({h: F.col(a) + F.col(b) for h, (a, b) in helpers.items() if {a, b} <= set(df.columns)})
    specs = {out: (s, a, float(k)) for out, (s, a, k) in M.RATIOS.items() if {s, a} <= set(base.columns)}
    out = shrunk_by_table(base, specs, by).drop(*helpers)
    if "position_group" in out.columns:
        out = out.withColumns({r: F.when(F.col("position_group") == "GK", F.col(r)) for r in specs if r.startswith("gk_") or r == "save_rate"})
    return out


def shrunken(df: DataFrame, by: list[str], shots_include_penalties: bool = False) -> DataFrame:
    """Shrunken rates: goals a shot and the like. Penalties come out of conversion where the feed lets them, as its shots hold them or not."""
    has = set(df.columns)
    specs = {out: spec for out, spec in M.SHRUNKEN.items() if {spec[0], spec[1]} <= has}
    base = df
    if {"shots", "np_goals"} <= has and (not shots_include_penalties or has & {"pens_taken", "goals"}):
        goals, shots = F.col("np_goals"), F.col("shots")
        if shots_include_penalties and "pens_taken" in has:
            shots = F.col("shots") - F.coalesce("pens_taken", F.lit(0))
        elif shots_include_penalties:
            goals = F.col("goals")
        base = df.withColumns({"_goals": goals, "_shots": shots})
        specs["shot_conversion_pct"] = ("_goals", "_shots", M.BOUNDS.conversion_prior, 100, 2)
    for scale, digits in sorted({(s[3], s[4]) for s in specs.values()}):
        base = shrunk_by_table(base, {o: (s, a, float(k)) for o, (s, a, k, x, d) in specs.items() if (x, d) == (scale, digits)}, by, float(scale), digits)
    out = base.select(*df.columns, *specs)
    if "gk_psxg_per_sot" in specs and "position_group" in has:
        out = out.withColumn("gk_psxg_per_sot", F.when(F.col("position_group") == "GK", F.col("gk_psxg_per_sot")))
    return out


def build(df: DataFrame, stats: Iterable[str], by: list[str] | None = None, shots_include_penalties: bool = False) -> DataFrame:
    """All metrics of a player-season table, step by step: rates, ratios, composites, shrunken rates, team shares, possession."""
    by = by or ["position_group"]
    out = shrunken(derived(ratios(per90(df, stats), by)), by, shots_include_penalties)
    helper = {"tackles", "interceptions"} <= set(out.columns)
    if helper:
        out = out.withColumn("_tackles_interceptions", F.col("tackles") + F.col("interceptions"))
    for name, (mine, theirs) in M.TEAM_SHARES.items():
        if {mine, theirs, "season", "league", "team"} <= set(out.columns):
            out = team_share(out, mine, theirs, name)
    if "team_possession" in out.columns:
        out = possession_adjusted(out)
    return out.drop("_tackles_interceptions") if helper else out


def possession_adjusted(df: DataFrame, possession: str = "team_possession") -> DataFrame:
    """Defensive rates as if the opponent had the ball half the time."""
    factor = 50.0 / F.greatest(100.0 - F.col(possession), F.lit(20.0))
    factor = F.when(F.col(possession).isNotNull(), factor)
    padj = {f"padj_{m}_per90": round_even(F.col(f"{m}_per90") * factor, 3) for m in M.POSSESSION_ADJUSTED if f"{m}_per90" in df.columns}
    return df.withColumns({"possession_factor": round_even(factor, 3)} | padj)


def team_share(df: DataFrame, mine: str, theirs: str, out: str, team: list[str] | None = None, clubs: str | None = "clubs_in_season") -> DataFrame:
    """A player's share of what his team does while he plays: 100 * (mine / minutes) / (team's / (team minutes / 11)).

    Null for players of several clubs, for teams of under 5 matches, and where under 97 % of the team's minutes are measured.
    """
    team = team or ["season", "league", "team"]
    totals = df.groupBy(*team).agg(
        (F.sum("minutes") / 11.0).alias("_team"), F.sum(theirs).alias("_theirs"), (F.sum(F.when(F.col(theirs).isNotNull(), F.col("minutes"))) / F.sum("minutes")).alias("_covered")
    )
    fine = (F.col("_team") >= 90.0 * M.BOUNDS.share_min_matches) & (F.col("_covered") >= M.BOUNDS.share_min_coverage)
    if clubs and clubs in df.columns:
        fine = fine & (F.coalesce(F.col(clubs), F.lit(1)) == 1)
    value = 100.0 * ratio(F.col(mine) / F.nullif(F.col("minutes"), F.lit(0.0)), F.col("_theirs") / F.col("_team"))
    return df.join(totals, team, "left").withColumn(out, F.when(fine, round_even(value, 2))).drop("_team", "_theirs", "_covered")


def keeper_full_match_rates(df: DataFrame) -> DataFrame:
    """Rates over full matches replace those per 90 where there are such matches."""
    n = F.nullif(F.col("full_matches"), F.lit(0))
    return df.withColumns(
        {
            "xgc_per90": F.coalesce(round_even(F.col("full_xga") / n, 3), F.col("xgc_per90")),
            "goals_conceded_per90": F.coalesce(round_even(F.col("full_conceded") / n, 3), F.col("goals_conceded_per90")),
            "gk_xgc_minus_ga_per90": F.coalesce(round_even((F.col("full_xga") - F.col("full_conceded")) / n, 3), F.col("gk_xgc_minus_ga_per90")),
            "clean_sheet_rate": F.coalesce(round_even(100.0 * F.col("full_clean_sheets") / n, 2), F.col("clean_sheet_rate")),
        }
    )


def category_scores(pcts: DataFrame, baskets: dict[str, tuple[str, ...]], prefix: str = "cat_") -> DataFrame:
    """Mean of the measured percentiles pct_<metric> of each basket; one decimal, null if none is measured."""

    def mean(metrics: tuple[str, ...]) -> Column:
        known = F.filter(F.array(*[F.col(f"pct_{m}") for m in metrics if f"pct_{m}" in pcts.columns]), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, round_even(F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known), 1))

    usable = {name: ms for name, ms in baskets.items() if any(f"pct_{m}" in pcts.columns for m in ms)}
    return pcts.withColumns({prefix + name.lower().replace(" ", "_"): mean(ms) for name, ms in usable.items()})


def combined_seasons(df: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Several seasons as one: rates are means weighted by minutes, minutes add up."""
    weighted = [(F.sum(F.col(m) * F.col("minutes")) / F.sum(F.when(F.col(m).isNotNull(), F.col("minutes")))).alias(m) for m in metrics]
    return df.groupBy(*key).agg(F.sum("minutes").alias("minutes"), *weighted)
