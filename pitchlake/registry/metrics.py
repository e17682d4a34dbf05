"""What is measured: counting stats, ratios, shares, category baskets; all expressions are generated from these."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

# Fixed values. Ratios: numerator, denominator, weight of the prior.
RATIOS = {
    "pass_pct": ("passes_completed", "passes_attempted", 100),
    "pass_pct_under_pressure": ("passes_completed_under_pressure", "passes_under_pressure", 40),
    "long_pass_pct": ("long_passes_completed", "long_passes_attempted", 30),
    "tackle_win_pct": ("tackles_won", "tackles", 20),
    "pressure_success_pct": ("pressures_successful", "pressures", 50),
    "dribble_success_pct": ("dribbles_completed", "dribbles_attempted", 15),
    "shot_accuracy_pct": ("shots_on_target", "shots", 15),
    "aerial_win_pct": ("aerials_won", "_aerials_total", 20),
    "gk_save_pct": ("gk_saves", "gk_shots_on_target_against", 30),
    "save_rate": ("gk_saves", "_saves_plus_conceded", 25),
    "gk_cross_stop_pct": ("gk_crosses_stopped", "gk_crosses_faced", 30),
    "gk_launch_pct": ("gk_launches_completed", "gk_launches_attempted", 30),
    "gk_pen_save_pct": ("gk_pens_saved", "gk_pens_faced", 3),
    "short_pass_pct": ("short_passes_completed", "short_passes_attempted", 50),
    "medium_pass_pct": ("medium_passes_completed", "medium_passes_attempted", 40),
    "dribbler_stop_pct": ("dribblers_tackled", "dribblers_challenged", 20),
}
# Fixed values. Team shares: the player's stat, the team's.
TEAM_SHARES = {
    "team_shot_share": ("shots", "shots"),
    "team_npxg_share": ("npxg", "npxg"),
    "team_key_pass_share": ("key_passes", "key_passes"),
    "team_xg_chain_share": ("xg_chain", "xg"),
    "team_touch_share": ("touches", "touches"),
    "team_progressive_pass_share": ("progressive_passes", "progressive_passes"),
    "team_defensive_action_share": ("_tackles_interceptions", "_tackles_interceptions"),
}
# Metrics adjusted for the ball their team doesn't have.
POSSESSION_ADJUSTED = ("tackles", "interceptions", "blocks", "clearances", "ball_recoveries", "pressures", "defensive_actions")
# Fixed values: (success, attempts); a success is never above its attempts. Order matters, as pairs chain.
CONSISTENT = (
    ("passes_completed", "passes_attempted"), ("passes_under_pressure", "passes_attempted"), ("passes_completed_under_pressure", "passes_under_pressure"),
    ("npxg_open_play", "npxg"), ("long_passes_completed", "long_passes_attempted"), ("tackles_won", "tackles"), ("pressures_successful", "pressures"),
    ("dribbles_completed", "dribbles_attempted"), ("shots_on_target", "shots"), ("np_goals", "shots"), ("pens_scored", "pens_taken"),
    ("gk_saves", "gk_shots_on_target_against"), ("gk_crosses_stopped", "gk_crosses_faced"), ("gk_launches_completed", "gk_launches_attempted"),
    ("carries_into_final_third", "progressive_carries"),
)
# Metrics that feeds may lack, imputed where a season is well covered.
OPTIONAL = (
    "xa", "xg", "npxg", "gk_psxg", "sca", "gca", "pressures", "pressures_successful", "passes_under_pressure", "passes_completed_under_pressure",
    "npxg_open_play", "npxg_set_piece",
)
NOT_PER90 = frozenset({"pens_scored", "pens_taken"})
# Position groups, and which a thin group joins.
PARENTS = {"SS": "AM", "WM": "W"}
# Side of the pitch by position.
FLANKS = {
    "LB": "Left", "LW": "Left", "LM": "Left", "RB": "Right", "RW": "Right", "RM": "Right", "Left-Back": "Left", "Left Winger": "Left", "Left Midfield": "Left",
    "Right-Back": "Right", "Right Winger": "Right", "Right Midfield": "Right",
}
UNKNOWN_FLANK = ("DEF", "MID", "FWD")
WIDE_GROUPS = ("FB", "W", "WM")
# Category baskets of outfield players and keepers.
OUTFIELD = {
    "Finishing": ("np_goals_per90", "npxg_per90", "npxg_open_play_per90", "shots_per90", "shot_accuracy_pct", "npxg_per_shot"),
    "Box Threat": ("touches_att_pen_per90", "carries_into_pen_area_per90", "shots_per90"),
    "Chance Creation": ("assists_per90", "xa_per90", "key_passes_per90", "sca_per90", "passes_into_pen_area_per90", "through_balls_per90"),
    "Passing": ("pass_pct", "pass_pct_under_pressure", "passes_attempted_per90", "long_pass_pct", "switches_per90"),
    "Ball Progression": (
        "progressive_passes_per90", "progressive_carries_per90", "passes_into_final_third_per90", "carries_into_final_third_per90", "progressive_receptions_per90",
    ),
    "Dribbling": ("dribbles_completed_per90", "dribbles_attempted_per90", "dribble_success_pct", "progressive_carries_per90"),
    "Defending": ("tackles_per90", "interceptions_per90", "blocks_per90", "clearances_per90", "ball_recoveries_per90", "pressures_per90", "tackle_win_pct"),
    "Aerial": ("aerials_won_per90", "aerial_win_pct", "aerials_contested_per90"),
}
KEEPER = {
    "Shot Stopping": ("gk_save_pct", "gk_psxg_minus_ga_per90", "gk_xgc_minus_ga_per90", "gk_saves_per90"),
    "Goal Prevention": ("gk_goals_against_per90", "gk_psxg_minus_ga_per90", "gk_xgc_minus_ga_per90"),
    "Claiming Crosses": ("gk_cross_stop_pct", "gk_crosses_stopped_per90"),
    "Sweeping": ("gk_def_actions_outside_box_per90",),
    "Distribution": ("pass_pct", "passes_attempted_per90", "progressive_passes_per90"),
    "Long Distribution": ("gk_launch_pct", "long_pass_pct", "long_passes_attempted_per90"),
}
BUCKET = {
    "Goal Threat": ("npxg_per90", "xg_per90", "goals_per90", "threat_per90", "shots_per90"),
    "Chance Creation": ("xa_per90", "assists_per90", "creativity_per90", "key_passes_per90"),
    "Build-up Involvement": ("xg_chain_per90", "xg_buildup_per90", "influence_per90"),
    "Defensive Work": ("tackles_per90", "ball_recoveries_per90", "cbi_per90", "defensive_contribution_per90"),
    "Defensive Solidity": ("clean_sheet_rate", "goals_conceded_per90", "xgc_per90"),
    "Overall Rating": ("bps_per90", "ict_per90"),
    "Availability": ("starts_share", "minutes"),
}
BUCKET_KEEPER = {
    "Shot Stopping": ("save_rate", "gk_saves_per90", "gk_xgc_minus_ga_per90"),
    "Goal Prevention": ("goals_conceded_per90", "xgc_per90", "clean_sheet_rate"),
    "Overall Rating": ("bps_per90", "influence_per90"),
    "Availability": ("starts_share", "minutes"),
}
# Metrics of which less is better, and those that are mostly the team's.
LOWER_IS_BETTER = frozenset(
    {
        "goals_conceded_per90", "xgc_per90", "yellow_cards_per90", "red_cards_per90", "miscontrols_per90", "dispossessed_per90", "fouls_committed_per90", "errors_per90",
        "gk_goals_against_per90", "aerials_lost_per90", "pens_taken_per90", "offsides_per90", "pens_conceded_per90", "possession_lost_per90", "dribbled_past_per90", "turnover_rate",
    }
)
TEAM_CONTEXT = frozenset({"clean_sheet_rate", "goals_conceded_per90", "xgc_per90", "gk_goals_against_per90", "gk_saves_per90"})
# Fixed values. Shrunken rates: numerator, denominator, weight of the prior, scale, digits.
SHRUNKEN = {
    "npxg_per_shot": ("npxg", "shots", 15, 1, 4),
    "xa_per_key_pass": ("xa", "key_passes", 15, 1, 4),
    "cross_box_pct": ("crosses_into_pen_area", "crosses", 20, 100, 2),
    "gk_psxg_per_sot": ("gk_psxg", "gk_shots_on_target_against", 30, 1, 4),
}
# Fixed values. Weights of the hidden-gem components.
GEM_WEIGHTS = {
    "Performance": 40, "Age upside": 20, "Underpriced for output": 20, "Low exposure": 15, "Value for money": 15, "Statistical uniqueness": 15, "Sample size": 10,
}


@dataclass(frozen=True)
class Bounds:
    """Limits and thresholds of the analysis."""

    max_minutes: int = 3420
    height: tuple[float, float] = (150.0, 215.0)
    age: tuple[float, float] = (15.0, 45.0)
    coverage: float = 0.90
    outlier: float = 5.0
    shot_prior: float = 15.0
    conversion_prior: float = 20.0
    share_min_matches: int = 5
    share_min_coverage: float = 0.97
    reliability_minutes: int = 900
    reliability_pairs: int = 40
    reliability_floor: float = 0.05
    thin_group: int = 40


BOUNDS = Bounds()


def categories_for(group: str, taxonomy: str = "detailed") -> dict[str, tuple[str, ...]]:
    """The baskets of a group: those of keepers are their own under either taxonomy."""
    if taxonomy == "bucket":
        return BUCKET_KEEPER if group == "GK" else BUCKET
    if group in UNKNOWN_FLANK:
        return BUCKET
    return KEEPER if group == "GK" else OUTFIELD


def percentile_metrics(have: Iterable[str], groups: Iterable[str], taxonomy: str = "detailed") -> list[str]:
    """Every metric that some group's basket uses and the table has, in first-seen order."""
    have = set(have)
    wanted = (m for g in groups for ms in categories_for(g, taxonomy).values() for m in ms)
    return [m for m in dict.fromkeys(wanted) if m in have]


def model_features(have: dict[str, float], group: str, taxonomy: str = "detailed", features: dict[str, tuple[str, ...]] | None = None, least: float = 0.6, fewest: int = 5) -> list[str]:
    """Features of a group's model: those of its list that enough rows measure (``have``: {metric: share}); none if too few are left.

    ``features``: {group: metrics}, the analyst's own lists; without one, the metrics of the group's baskets.
    """
    wanted = (features or {}).get(group) or [m for ms in categories_for(group, taxonomy).values() for m in ms]
    found = [m for m in dict.fromkeys(wanted) if have.get(m, 0.0) >= least]
    return found if len(found) >= fewest else []


def membership(features: Iterable[str], baskets: dict[str, tuple[str, ...]]) -> list[list[int]]:
    """For each feature the numbers of the baskets that it is in, in their order: what a reader needs to weigh features by basket."""
    places: dict[str, list[int]] = {}
    for i, metrics in enumerate(baskets.values()):
        for m in dict.fromkeys(metrics):
            places.setdefault(m, []).append(i)
    return [places.get(f, []) for f in features]


@dataclass(frozen=True)
class Roles:
    """Weights of the baskets by group and role: ``templates`` {group: {role: {basket: weight}}}, ``defaults`` {group: {basket: weight}}."""

    templates: dict[str, dict[str, dict[str, float]]]
    defaults: dict[str, dict[str, float]]
    default_role: str = "Balanced (position default)"

    def weights(self, group: str, role: str | None = None, taxonomy: str = "detailed") -> dict[str, float]:
        """The role's, else the group's, else all baskets alike."""
        chosen = self.templates.get(group, {}).get(role) if role and role != self.default_role else None
        return dict(chosen or self.defaults.get(group) or dict.fromkeys(categories_for(group, taxonomy), 1.0))

    def names(self, group: str) -> list[str]:
        return [self.default_role, *sorted(self.templates.get(group, {}))]


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Non-negative weights that sum to 100; equal ones where all are 0."""
    kept = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(kept.values())
    return {k: 100 * v / total if total else 100 / len(kept) for k, v in kept.items()}
