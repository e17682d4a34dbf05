"""Match events: ordered sequences with nested details, one row an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if, true
from ..functions.text import clock_minutes

# Pitch, windows, vocabularies.
YARD = 0.9144
GOAL_X, GOAL_Y, BOX_X, BOX_LOW, BOX_HIGH, THIRD_1, THIRD_2, HALFWAY, OWN_BOX = 120.0, 40.0, 102.0, 18.0, 62.0, 40.0, 80.0, 60.0, 18.0
LONG_PASS, LAUNCH, WINDOW, STOPPAGE = 30.0, 40.0, 5, 60
TERMINAL = ("Substitution - Off", "Sent Off", "Red Card", "Second Yellow")
ON_TARGET = ("Goal", "Saved", "Saved to Post", "Saved Off Target")
SET_PIECES = ("From Corner", "From Free Kick")
SAVES = ("Shot Saved", "Save", "Penalty Saved", "Shot Saved to Post", "Shot Saved Off Target")
CLAIMS = ("Collected", "Punch", "Claim", "Smother", "Keeper Sweeper")
DUEL_WON = ("Won", "Success", "Success In Play", "Success Out")
RECEIPTS = ("Ball Receipt*", "Ball Recovery", "Interception", "Clearance", "Block")
DEAD_BALLS, LOST = ("Free Kick", "Corner"), ("Lost", "Lost Out")
ON_BALL = ("Pass", "Carry", "Ball Receipt*", "Dribble", "Shot", "Clearance", "Ball Recovery", "Interception")


def distance_to_goal(p: Column) -> Column:
    """In metres."""
    return F.sqrt(F.pow(GOAL_X - F.get(p, 0), 2) + F.pow(GOAL_Y - F.get(p, 1), 2)) * YARD


def progressive(start: Column, end: Column) -> Column:
    """Nearer to goal by 30 m within the own half, 15 m across halves, 10 m in the other half."""
    gain = distance_to_goal(start) - distance_to_goal(end)
    own, still = F.get(start, 0) < HALFWAY, F.get(end, 0) < HALFWAY
    return true(F.when(own & still, gain >= 30).when(own != still, gain >= 15).otherwise(gain >= 10))


def in_box(p: Column) -> Column:
    return true((F.get(p, 0) >= BOX_X) & F.get(p, 1).between(BOX_LOW, BOX_HIGH))


def third(p: Column) -> Column:
    return F.when(F.get(p, 0) < THIRD_1, "def").when(F.get(p, 0) < THIRD_2, "mid").when(F.get(p, 0).isNotNull(), "att")


def seconds() -> Column:
    return F.col("minute") * 60 + F.col("second")


def match_ends(events: DataFrame) -> DataFrame:
    """(match_id, match_end): the last end of a half, in minutes; else the last event's minute."""
    clock = F.col("minute") + F.col("second") / 60.0
    return events.groupBy("match_id").agg(F.coalesce(F.max(F.when(F.col("type.name") == "Half End", clock)), F.max("minute").cast("double"), F.lit(90.0)).alias("match_end"))


def related(events: DataFrame, kind: str, out: str) -> DataFrame:
    """(match_id, id) of events that name an event of that kind among their related ones, with ``out`` true."""
    named = events.select("match_id", "id", F.explode("related_events").alias("_other"))
    those = events.where(F.col("type.name") == kind).select("match_id", F.col("id").alias("_other"))
    return named.join(those, ["match_id", "_other"], "left_semi").select("match_id", "id").distinct().withColumn(out, F.lit(True))


def possession_time(events: DataFrame) -> DataFrame:
    """(match_id, team, seconds): each gap of up to a minute to the next event of a period goes to the team in possession at its start."""
    w = Window.partitionBy("match_id", "period").orderBy("index")
    gap = F.lead(seconds()).over(w) - seconds()
    each = events.select("match_id", F.col("possession_team.name").alias("team"), gap.alias("gap"))
    return each.where((F.col("gap") > 0) & (F.col("gap") <= STOPPAGE)).groupBy("match_id", "team").agg(F.sum("gap").cast("double").alias("seconds"))


def minutes_played(lineups: DataFrame) -> DataFrame:
    """(match_id, player_id, minutes, started, positions) from spells.

    lineups: match_id, match_end, player_id, spells (array of position, from, to, start_reason, end_reason). Spells are taken in order of
    their start, never overlap, and end with the first that ends in leaving the pitch; a match counts 90 minutes.
    """
    each = lineups.select("match_id", "match_end", "player_id", F.posexplode("spells").alias("place", "s"))
    start, end = F.coalesce(clock_minutes(F.col("s.from")), F.lit(0.0)), clock_minutes(F.col("s.to"))
    each = each.select("match_id", "match_end", "player_id", "place", "s", start.alias("start"), F.least(F.coalesce(end, F.col("match_end")), F.col("match_end")).alias("end"))
    each = each.withColumn("leaves", F.coalesce(F.col("s.end_reason").rlike("|".join(TERMINAL)), F.lit(False)).cast("int"))
    before = Window.partitionBy("match_id", "player_id").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
    scale = F.when(F.col("match_end") > 0, 90.0 / F.col("match_end")).otherwise(1.0)
    played = (
        each.withColumn("cursor", F.coalesce(F.max("end").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.max("leaves").over(before), F.lit(0)))
        .where("gone = 0")
        .withColumn("m", F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", "cursor")) * scale)
    )
    per = played.groupBy("match_id", "player_id", F.coalesce("s.position", F.lit("Unknown")).alias("position")).agg(
        F.sum("m").alias("m"), F.max((F.coalesce(F.col("s.start_reason"), F.lit("")) == "Starting XI").cast("int")).alias("started")
    )
    out = per.groupBy("match_id", "player_id").agg(
        F.least(F.sum("m"), F.lit(90.0)).alias("minutes"), (F.max("started") == 1).alias("started"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", "m")))).alias("positions")
    )
    return out.where("minutes > 0")


def counters(events: DataFrame) -> DataFrame:
    """Per match and player, what single events tell: passes, carries, shots, duels, defence, keeping."""
    kind = F.col("type.name")
    is_ = lambda name: kind == name
    here, end, carry = F.col("location"), F.col("pass.end_location"), F.col("carry.end_location")
    complete = is_("Pass") & F.col("pass.outcome.name").isNull()
    penalty = is_("Shot") & true(F.col("shot.type.name") == "Penalty")
    open_shot = is_("Shot") & ~penalty
    goal = is_("Shot") & true(F.col("shot.outcome.name") == "Goal")
    set_piece = F.coalesce(F.col("play_pattern.name").isin(*SET_PIECES), F.lit(False)) | F.coalesce(F.col("shot.type.name").isin(*DEAD_BALLS), F.lit(False))
    xg = F.col("shot.statsbomb_xg")
    tackle = is_("Duel") & true(F.col("duel.type.name") == "Tackle")
    won = F.coalesce(F.col("duel.outcome.name").isin(*DUEL_WON), F.lit(False))
    pressured = true(F.col("under_pressure"))
    keeper = F.col("goalkeeper.type.name")
    # Winning the ball is a touch; what is done with it is counted by itself.
    touch = kind.isin(*RECEIPTS) & F.col("team.name").isNotNull() & ~(is_("Ball Receipt*") & F.col("ball_receipt.outcome.name").isNotNull())
    into_third = lambda to: true(F.get(to, 0) >= THIRD_2) & ~true(F.get(here, 0) >= THIRD_2)
    technique = F.col("pass.technique.name") == "Through Ball" if "technique" in events.schema["pass"].dataType.names else F.lit(False)
    into_box = is_("Carry") & in_box(carry) & ~in_box(here)
    sums = {
        "touches": touch, "touches_def_third": touch & true(third(here) == "def"), "touches_mid_third": touch & true(third(here) == "mid"), "touches_att_third": touch & true(third(here) == "att"),
        "touches_att_pen": (touch & is_("Ball Receipt*") & in_box(here)) | into_box | (is_("Shot") & in_box(here)),
        "passes_attempted": is_("Pass"), "passes_completed": complete, "passes_under_pressure": is_("Pass") & pressured, "passes_completed_under_pressure": complete & pressured,
        "progressive_passes": complete & progressive(here, end), "passes_into_final_third": complete & into_third(end),
        "passes_into_pen_area": complete & in_box(end) & ~in_box(here), "long_passes_attempted": is_("Pass") & true(F.col("pass.length") >= LONG_PASS),
        "long_passes_completed": complete & true(F.col("pass.length") >= LONG_PASS), "crosses": is_("Pass") & true(F.col("pass.cross")), "switches": is_("Pass") & true(F.col("pass.switch")),
        "through_balls": is_("Pass") & (true(F.col("pass.through_ball")) | true(technique)), "key_passes": is_("Pass") & (true(F.col("pass.shot_assist")) | true(F.col("pass.goal_assist"))),
        "assists": is_("Pass") & true(F.col("pass.goal_assist")),
        "carries": is_("Carry"), "progressive_carries": is_("Carry") & progressive(here, carry), "carries_into_pen_area": into_box,
        "carries_into_final_third": is_("Carry") & progressive(here, carry) & into_third(carry),
        "goals": goal, "np_goals": goal & ~penalty, "pens_taken": penalty, "pens_scored": penalty & goal, "shots": open_shot,
        "shots_on_target": open_shot & F.coalesce(F.col("shot.outcome.name").isin(*ON_TARGET), F.lit(False)),
        "dribbles_attempted": is_("Dribble"), "dribbles_completed": is_("Dribble") & true(F.col("dribble.outcome.name") == "Complete"),
        "tackles": tackle, "tackles_won": tackle & won, "tackles_def_third": tackle & true(third(here) == "def"), "tackles_mid_third": tackle & true(third(here) == "mid"),
        "tackles_att_third": tackle & true(third(here) == "att"), "recoveries_opp_half": is_("Ball Recovery") & ~true(F.col("ball_recovery.recovery_failure")) & true(F.get(here, 0) >= HALFWAY),
        "pressures_att_third": is_("Pressure") & true(third(here) == "att"), "interceptions": is_("Interception") & ~F.coalesce(F.col("interception.outcome.name").isin(*LOST), F.lit(False)),
        "blocks": is_("Block"), "clearances": is_("Clearance"), "ball_recoveries": is_("Ball Recovery") & ~true(F.col("ball_recovery.recovery_failure")), "miscontrols": is_("Miscontrol"),
        "dispossessed": is_("Dispossessed"), "pressures": is_("Pressure"), "counterpressures": is_("Pressure") & true(F.col("counterpress")),
        "aerials_won": true(F.col("pass.aerial_won")) | true(F.col("clearance.aerial_won")) | true(F.col("miscontrol.aerial_won")) | true(F.col("shot.aerial_won")),
        "aerials_lost": is_("Duel") & true(F.col("duel.type.name") == "Aerial Lost"), "fouls_committed": is_("Foul Committed"), "fouls_won": is_("Foul Won"),
        "gk_saves": is_("Goal Keeper") & keeper.isin(*SAVES), "gk_crosses_stopped": is_("Goal Keeper") & keeper.isin(*CLAIMS),
        "gk_def_actions_outside_box": is_("Goal Keeper") & true(F.get(here, 0) > OWN_BOX) & ~F.coalesce(keeper.isin(*SAVES), F.lit(False)),
    }
    floats = {"xg": is_("Shot"), "npxg": open_shot, "npxg_open_play": open_shot & ~set_piece, "npxg_set_piece": open_shot & set_piece}
    return events.where("player.id IS NOT NULL").groupBy("match_id", F.col("player.id").alias("player_id")).agg(
        *[count_if(F.coalesce(cond, F.lit(False))).alias(n) for n, cond in sums.items()], *[F.sum(F.when(cond, F.coalesce(xg, F.lit(0.0))).otherwise(0.0)).alias(n) for n, cond in floats.items()]
    )


def expected_assists(events: DataFrame) -> DataFrame:
    """(match_id, player_id, xa): a shot's xG goes to whoever made its key pass."""
    shots = events.where("type.name = 'Shot' AND shot.key_pass_id IS NOT NULL").select("match_id", F.col("shot.key_pass_id").alias("id"), F.col("shot.statsbomb_xg").alias("xg"))
    passes = events.where("type.name = 'Pass'").select("match_id", "id", F.col("player.id").alias("player_id"))
    return shots.join(passes, ["match_id", "id"]).groupBy("match_id", "player_id").agg(F.sum("xg").alias("xa"))


def shot_creation(events: DataFrame, look_back: int = 39) -> DataFrame:
    """(match_id, player_id, sca, gca): the last two players with a creative action before each shot, of the shooting team and in its unbroken possession.

    Creative are completed passes and dribbles and fouls won, within ``look_back`` events. A match is cut into cells of as many events, and shots meet the actions of
    their cell and the one before.
    """
    w = Window.partitionBy("match_id").orderBy("index")
    changed = F.when(F.col("possession").eqNullSafe(F.lag("possession").over(w)), 0).otherwise(1)
    runs = events.select("match_id", "index", "possession", "type", "team", "player", "shot", "pass", "dribble").withColumns({"_new": changed, "_n": F.row_number().over(w)}).withColumn("_run", F.sum("_new").over(w))
    cell = F.floor(F.col("_n") / look_back)
    shots = runs.where("type.name = 'Shot'").select("match_id", "_run", F.col("_n").alias("at"), cell.alias("_cell"), F.col("team.name").alias("team"), true(F.col("shot.outcome.name") == "Goal").alias("goal"))
    creative = (F.col("type.name") == "Pass") & F.col("pass.outcome.name").isNull() | (F.col("type.name") == "Dribble") & true(F.col("dribble.outcome.name") == "Complete") | (F.col("type.name") == "Foul Won")
    acts = runs.where(creative & F.col("player.id").isNotNull()).select("match_id", "_run", "_n", F.explode(F.array(cell, cell + 1)).alias("_cell"), F.col("team.name").alias("team"), F.col("player.id").alias("player_id"))
    near = shots.join(acts, ["match_id", "_run", "_cell", "team"]).where((F.col("_n") < F.col("at")) & (F.col("at") - F.col("_n") <= look_back))
    per = near.groupBy("match_id", "at", "goal", "player_id").agg(F.max("_n").alias("last"))
    top = per.withColumn("_r", F.row_number().over(Window.partitionBy("match_id", "at").orderBy(F.desc("last")))).where("_r <= 2")
    return top.groupBy("match_id", "player_id").agg(F.count("*").cast("double").alias("sca"), count_if(F.col("goal")).alias("gca"))


def successful_pressures(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """(match_id, player_id, pressures_successful): the presser's team has the ball in a later event within five seconds."""
    base = events.select("match_id", "index", "period", seconds().alias("t"), F.col("type.name").alias("kind"), F.col("team.name").alias("team"), F.col("possession_team.name").alias("holder"), F.col("player.id").alias("player_id"))
    press = base.where("kind = 'Pressure'").select("match_id", "period", F.col("index").alias("at"), F.col("t").alias("t0"), "team", "player_id")
    later = base.where(F.col("kind").isin(*ON_BALL)).select("match_id", "period", "index", "t", F.col("holder").alias("team"))
    # Events meet pressures of the same five-second cell or the one before, so a match is never crossed with itself.
    cells = press.withColumn("cell", F.explode(F.array(F.floor(F.col("t0") / window), F.floor(F.col("t0") / window) + 1)))
    met = cells.join(later.withColumn("cell", F.floor(F.col("t") / window)), ["match_id", "period", "team", "cell"])
    good = met.where((F.col("index") > F.col("at")) & (F.col("t") <= F.col("t0") + window)).select("match_id", "player_id", "at").distinct()
    return good.groupBy("match_id", "player_id").agg(F.count("*").cast("double").alias("pressures_successful"))


def dribblers_and_blocks(events: DataFrame) -> DataFrame:
    """(match_id, player_id, dribblers_tackled, dribblers_challenged, shots_blocked): tackles that answer a dribble, those and times beaten, blocks of a shot."""
    some = events.where("player.id IS NOT NULL AND type.name IN ('Duel', 'Dribbled Past', 'Block')")
    marked = some.join(related(events, "Dribble", "_dribble"), ["match_id", "id"], "left").join(related(events, "Shot", "_shot"), ["match_id", "id"], "left")
    stopped = true(F.col("duel.type.name") == "Tackle") & true(F.col("_dribble"))
    return marked.groupBy("match_id", F.col("player.id").alias("player_id")).agg(
        count_if(stopped).alias("dribblers_tackled"), count_if(stopped | (F.col("type.name") == "Dribbled Past")).alias("dribblers_challenged"), count_if((F.col("type.name") == "Block") & true(F.col("_shot"))).alias("shots_blocked")
    )


def receptions(events: DataFrame) -> DataFrame:
    """(match_id, player_id, progressive_receptions): completed progressive passes, for whom they reached."""
    passes = events.where("type.name = 'Pass' AND pass.outcome.name IS NULL AND pass.recipient.id IS NOT NULL").where(progressive(F.col("location"), F.col("pass.end_location")))
    return passes.groupBy("match_id", F.col("pass.recipient.id").alias("player_id")).agg(F.count("*").cast("double").alias("progressive_receptions"))


def errors(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """(match_id, player_id, errors): losses of the ball that a shot of the other team follows, later and within five seconds."""
    base = events.select("match_id", "index", seconds().alias("t"), F.col("type.name").alias("kind"), F.col("team.name").alias("team"), F.col("player.id").alias("player_id"), F.col("pass.outcome.name").alias("failed"))
    lost = base.where("player_id IS NOT NULL AND (kind IN ('Miscontrol', 'Dispossessed') OR kind = 'Pass' AND failed IS NOT NULL)")
    lost = lost.select("match_id", F.col("index").alias("at"), F.col("t").alias("t0"), F.col("team").alias("mine"), "player_id")
    shots = base.where("kind = 'Shot'").select("match_id", "index", "t", F.col("team").alias("theirs"))
    # Losses meet shots of the same cell of five seconds or the next.
    cells = lost.withColumn("cell", F.explode(F.array(F.floor(F.col("t0") / window), F.floor(F.col("t0") / window) + 1)))
    met = cells.join(shots.withColumn("cell", F.floor(F.col("t") / window)), ["match_id", "cell"])
    good = met.where((F.col("index") > F.col("at")) & (F.col("t") <= F.col("t0") + window) & (F.col("theirs") != F.col("mine"))).select("match_id", "player_id", "at").distinct()
    return good.groupBy("match_id", "player_id").agg(F.count("*").cast("double").alias("errors"))


def keeper_context(events: DataFrame, spells: DataFrame) -> DataFrame:
    """(match_id, player_id, gk_shots_on_target_against, gk_goals_against, gk_crosses_faced): what the other team did while a keeper was on the pitch.

    spells: match_id, team, player_id, start, end (minutes, end null: to the end), of keepers; of spells that overlap, the first counts.
    Events meet the spells of their match's other teams by cells of ten minutes.
    """
    minute, outcome = F.col("minute") + F.col("second") / 60.0, F.col("shot.outcome.name")
    shot = F.col("type.name") == "Shot"
    on_target, scored = shot & F.coalesce(outcome.isin(*ON_TARGET), F.lit(False)), shot & true(outcome == "Goal")
    crossed = (F.col("type.name") == "Pass") & true(F.col("pass.cross")) & in_box(F.col("pass.end_location"))
    some = events.where(shot | crossed).select(
        "match_id", "id", F.col("team.name").alias("attacking"), minute.alias("m"), F.floor(minute / 10).alias("cell"), on_target.alias("on_target"), scored.alias("scored"), crossed.alias("crossed")
    )
    last = F.coalesce(F.col("end"), F.lit(200.0))
    # Of spells of one length and team only the first keeper's can count.
    alike = spells.groupBy("match_id", "team", "start", last.alias("end")).agg(F.min("player_id").alias("player_id"))
    cells = alike.select("match_id", "team", "player_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 10), F.floor(F.col("end") / 10))).alias("cell"))
    met = some.join(cells, ["match_id", "cell"]).where((F.col("team") != F.col("attacking")) & (F.col("start") <= F.col("m")) & (F.col("m") < F.col("end")))
    one = met.groupBy("match_id", "id", "on_target", "scored", "crossed").agg(F.min_by("player_id", F.struct("start", "player_id")).alias("player_id"))
    return one.groupBy("match_id", "player_id").agg(count_if(F.col("on_target")).alias("gk_shots_on_target_against"), count_if(F.col("scored")).alias("gk_goals_against"), count_if(F.col("crossed")).alias("gk_crosses_faced"))


def keeper_distribution(events: DataFrame, keepers: DataFrame) -> DataFrame:
    """(match_id, player_id, gk_launches_attempted, gk_launches_completed): passes of forty yards and more by whoever kept goal that match."""
    long = events.where(F.col("type.name") == "Pass").where(true(F.col("pass.length") >= LAUNCH)).select("match_id", F.col("player.id").alias("player_id"), F.col("pass.outcome.name").isNull().alias("complete"))
    met = long.join(keepers.select("match_id", "player_id").distinct(), ["match_id", "player_id"], "left_semi")
    return met.groupBy("match_id", "player_id").agg(F.count("*").cast("double").alias("gk_launches_attempted"), count_if(F.col("complete")).alias("gk_launches_completed"))


def keeper_spells(lineups: DataFrame) -> DataFrame:
    """(match_id, team, player_id, start, end) of spells in goal; line-ups with a team."""
    each = lineups.select("match_id", "team", "player_id", F.explode("spells").alias("s")).where("s.position = 'Goalkeeper'")
    return each.select("match_id", "team", "player_id", F.coalesce(clock_minutes(F.col("s.from")), F.lit(0.0)).alias("start"), clock_minutes(F.col("s.to")).alias("end"))


def possession_shares(events: DataFrame) -> DataFrame:
    """(match_id, team, possession): each team's share of the time that somebody had the ball, in percent."""
    held = possession_time(events)
    return held.withColumn("possession", 100.0 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy("match_id"))).drop("seconds")  # a row a team


def player_matches(events: DataFrame, lineups: DataFrame) -> DataFrame:
    """One row a player and match: minutes, counters, credits; what keepers face too where line-ups name their team."""
    keys = ["match_id", "player_id"]
    out = minutes_played(lineups)
    parts = [counters(events), expected_assists(events), shot_creation(events), successful_pressures(events), dribblers_and_blocks(events), receptions(events), errors(events)]
    if "team" in lineups.columns:
        spells = keeper_spells(lineups)
        parts += [keeper_context(events, spells), keeper_distribution(events, spells)]
    for part in parts:
        out = out.join(part, keys, "left")
    return out.fillna(0.0, [c for c, t in out.dtypes if t == "double"])


def player_seasons(matches: DataFrame, sums: list[str]) -> DataFrame:
    """One row a player, league and season from player-matches (player, nationality, team, possession, positions, minutes, started, counters).

    Counters and minutes add up (minutes rounded at the end), the club is that of most minutes, possession is weighted by minutes (50 without any), and
    the position is that of most minutes over all matches; ties go by name.
    """
    key = ["player_id", "league", "season"]
    clubs = matches.groupBy(*key, "team").agg(F.sum("minutes").alias("m"))
    team = clubs.groupBy(*key).agg(F.min_by("team", F.struct(-F.col("m"), F.col("team"))).alias("team"), F.count("*").alias("clubs_in_season"))
    places = matches.select(*key, F.explode("positions").alias("position", "m")).groupBy(*key, "position").agg(F.sum("m").alias("m"))
    place = places.groupBy(*key).agg(F.min_by("position", F.struct(-F.col("m"), F.col("position"))).alias("position"))
    played = matches.groupBy(*key).agg(
        F.max_by("player", "match_id").alias("player"), F.mode("nationality", True).alias("nationality"), F.rint(F.sum("minutes")).cast("int").alias("minutes"), F.count("*").alias("matches"),
        count_if(F.col("started")).alias("starts"), F.coalesce(F.sum(F.col("possession") * F.col("minutes")) / F.nullif(F.sum("minutes"), F.lit(0.0)), F.lit(50.0)).alias("team_possession"), *[F.sum(c).alias(c) for c in sums],
    )
    return played.join(team, key).join(place, key, "left").withColumn("position", F.coalesce("position", F.lit("CM")))
