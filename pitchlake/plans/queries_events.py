"""Match events through the event operators: a day of the events table is a match, every kind of event and detail comes from its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_even
from ..operators import events
from ..sources import feeds
from .adapters import table
from .catalog import query

KINDS = (
    "Pass", "Pass", "Carry", "Shot", "Dribble", "Duel", "Interception", "Clearance", "Block", "Ball Recovery", "Miscontrol", "Dispossessed", "Foul Committed", "Foul Won", "Pressure", "Ball Receipt*", "Goal Keeper",
    "Dribbled Past",
)


def _pick(n: Column, *values: str | None) -> Column:
    """The n-th (modulo) of some values."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def _named(x: Column) -> Column:
    return F.struct(x.alias("name"))


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a match event. The kind goes by the event's number; ``a`` counts rounds of kinds and picks the details."""
    ev = table(spark, sf_dir, "events")
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    a, here = F.floor(n / len(KINDS)), F.array((n % 121).cast("double"), (n % 81).cast("double"))
    ahead, every = F.array(((n * 7) % 121).cast("double"), ((n * 5) % 81).cast("double")), lambda k, r=0: a % k == r
    minute = F.hour(ts) * 60 + F.minute(ts)
    team = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    rows = ev.select(
        F.unix_date(F.to_date(ts)).cast("long").alias("match_id"), n.cast("string").alias("id"), n.alias("index"), F.lit(1).alias("period"), minute.alias("minute"), F.second(ts).alias("second"),
        _named(_pick(n, *KINDS)).alias("type"), _named(team).alias("team"), F.struct(F.col("user_id").alias("id")).alias("player"), F.floor(minute / 3).cast("int").alias("possession"), _named(team).alias("possession_team"),
        here.alias("location"), every(4, 1).alias("under_pressure"), every(3, 1).alias("counterpress"), _named(_pick(a, "From Corner", "From Free Kick", "Regular Play", "Regular Play")).alias("play_pattern"),
        F.when(~every(3, 1), F.array((n - 1).cast("string"), (n - 5).cast("string"))).alias("related_events"),
        F.struct(
            ahead.alias("end_location"), (a % 60).cast("double").alias("length"), _named(_pick(a, "Incomplete", None, None)).alias("outcome"), F.struct((F.col("user_id") + 1).alias("id")).alias("recipient"), every(4).alias("cross"),
            every(5).alias("switch"), every(7).alias("through_ball"), every(6).alias("shot_assist"), every(13).alias("goal_assist"), every(9).alias("aerial_won"), _named(_pick(a, "Through Ball", *[None] * 10)).alias("technique"),
        ).alias("pass"),
        F.struct(ahead.alias("end_location")).alias("carry"),
        F.struct(
            F.col("value").alias("statsbomb_xg"), F.when(every(2), (n - 3).cast("string")).alias("key_pass_id"), _named(_pick(a, "Penalty", "Free Kick", "Corner", *["Open Play"] * 5)).alias("type"),
            _named(_pick(a, "Goal", "Saved", "Off T", "Saved to Post", "Wayward")).alias("outcome"), every(10).alias("aerial_won"),
        ).alias("shot"),
        F.struct(_named(_pick(a, "Complete", "Incomplete")).alias("outcome")).alias("dribble"),
        F.struct(_named(_pick(a, "Tackle", "Aerial Lost")).alias("type"), _named(_pick(a, "Won", "Lost In Play", "Success Out")).alias("outcome")).alias("duel"),
        F.struct(_named(_pick(a, "Lost", "Lost Out", "Won", "Lost In Play")).alias("outcome")).alias("interception"),
        F.struct(every(3).alias("aerial_won")).alias("clearance"), F.struct(every(3, 1).alias("aerial_won")).alias("miscontrol"), F.struct(every(4).alias("recovery_failure")).alias("ball_recovery"),
        F.struct(_named(_pick(a, "Incomplete", None, None)).alias("outcome")).alias("ball_receipt"),
        F.struct(_named(_pick(a, "Shot Saved", "Punch", "Keeper Sweeper", "Goal Conceded", "Smother")).alias("type")).alias("goalkeeper"),
    )
    # Details belong to their kind of event only.
    own = {"pass": "Pass", "carry": "Carry", "shot": "Shot", "dribble": "Dribble", "duel": "Duel", "interception": "Interception", "clearance": "Clearance", "miscontrol": "Miscontrol", "ball_recovery": "Ball Recovery", "ball_receipt": "Ball Receipt*", "goalkeeper": "Goal Keeper"}
    return rows.withColumns({c: F.when(F.col("type.name") == kind, F.col(c)) for c, kind in own.items()})


FE = """fe AS (SELECT CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS match_id, event_id AS n, event_id % 18 AS k, event_id // 18 AS a, user_id, user_id % 2 AS team, value, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS mi, CAST(floor(second(ts)) AS BIGINT) AS se,
  event_id % 121 AS x, event_id % 81 AS y, (event_id * 7) % 121 AS x2, (event_id * 5) % 81 AS y2 FROM events)"""
_GAIN = "(sqrt(pow(120 - x, 2) + pow(40 - y, 2)) - sqrt(pow(120 - x2, 2) + pow(40 - y2, 2))) * 0.9144::DOUBLE"
_PROG = f"CASE WHEN x < 60 AND x2 < 60 THEN {_GAIN} >= 30 WHEN (x < 60) <> (x2 < 60) THEN {_GAIN} >= 15 ELSE {_GAIN} >= 10 END"
_HERE, _THERE = "(x >= 102 AND y BETWEEN 18 AND 62)", "(x2 >= 102 AND y2 BETWEEN 18 AND 62)"
_PASS, _DONE, _TOUCH, _OPEN, _TACKLE = "k <= 1", "k <= 1 AND a % 3 <> 0", "(k IN (6, 7, 8, 9) OR k = 15 AND a % 3 <> 0)", "k = 3 AND a % 8 <> 0", "k = 5 AND a % 2 = 0"
_DEAD = "(a % 4 <= 1 OR a % 8 IN (1, 2))"
COUNTS = {
    "touches": _TOUCH, "touches_def_third": f"{_TOUCH} AND x < 40", "touches_mid_third": f"{_TOUCH} AND x >= 40 AND x < 80", "touches_att_third": f"{_TOUCH} AND x >= 80",
    "touches_att_pen": f"k = 15 AND a % 3 <> 0 AND {_HERE} OR k = 2 AND {_THERE} AND NOT {_HERE} OR k = 3 AND {_HERE}", "passes_attempted": _PASS, "passes_completed": _DONE, "passes_under_pressure": f"{_PASS} AND a % 4 = 1",
    "passes_completed_under_pressure": f"{_DONE} AND a % 4 = 1", "progressive_passes": f"{_DONE} AND {_PROG}", "passes_into_final_third": f"{_DONE} AND x2 >= 80 AND x < 80", "passes_into_pen_area": f"{_DONE} AND {_THERE} AND NOT {_HERE}",
    "long_passes_attempted": f"{_PASS} AND a % 60 >= 30", "long_passes_completed": f"{_DONE} AND a % 60 >= 30", "crosses": f"{_PASS} AND a % 4 = 0", "switches": f"{_PASS} AND a % 5 = 0", "through_balls": f"{_PASS} AND (a % 7 = 0 OR a % 11 = 0)",
    "key_passes": f"{_PASS} AND (a % 6 = 0 OR a % 13 = 0)", "assists": f"{_PASS} AND a % 13 = 0", "carries": "k = 2", "progressive_carries": f"k = 2 AND {_PROG}", "carries_into_pen_area": f"k = 2 AND {_THERE} AND NOT {_HERE}",
    "carries_into_final_third": f"k = 2 AND x2 >= 80 AND x < 80 AND {_PROG}", "goals": "k = 3 AND a % 5 = 0", "np_goals": f"{_OPEN} AND a % 5 = 0", "pens_taken": "k = 3 AND a % 8 = 0", "pens_scored": "k = 3 AND a % 8 = 0 AND a % 5 = 0",
    "shots": _OPEN, "shots_on_target": f"{_OPEN} AND a % 5 IN (0, 1, 3)", "dribbles_attempted": "k = 4", "dribbles_completed": "k = 4 AND a % 2 = 0", "tackles": _TACKLE, "tackles_won": f"{_TACKLE} AND a % 3 <> 1", "tackles_def_third": f"{_TACKLE} AND x < 40",
    "tackles_mid_third": f"{_TACKLE} AND x >= 40 AND x < 80", "tackles_att_third": f"{_TACKLE} AND x >= 80", "recoveries_opp_half": "k = 9 AND a % 4 <> 0 AND x >= 60", "pressures_att_third": "k = 14 AND x >= 80", "interceptions": "k = 6 AND a % 4 >= 2",
    "blocks": "k = 8", "clearances": "k = 7", "ball_recoveries": "k = 9 AND a % 4 <> 0", "miscontrols": "k = 10", "dispossessed": "k = 11", "pressures": "k = 14", "counterpressures": "k = 14 AND a % 3 = 1",
    "aerials_won": f"{_PASS} AND a % 9 = 0 OR k = 7 AND a % 3 = 0 OR k = 10 AND a % 3 = 1 OR k = 3 AND a % 10 = 0", "aerials_lost": "k = 5 AND a % 2 = 1", "fouls_committed": "k = 12", "fouls_won": "k = 13", "gk_saves": "k = 16 AND a % 5 = 0",
    "gk_crosses_stopped": "k = 16 AND a % 5 IN (1, 2, 4)", "gk_def_actions_outside_box": "k = 16 AND x > 18 AND a % 5 <> 0",
}
XG = {"xg": "k = 3", "npxg": _OPEN, "npxg_open_play": f"{_OPEN} AND NOT {_DEAD}", "npxg_set_piece": f"{_OPEN} AND {_DEAD}"}
_SUMS = [*[f"CAST(COUNT(*) FILTER ({c}) AS DOUBLE) AS {n}" for n, c in COUNTS.items()], *[f"round_even(COALESCE(SUM(value) FILTER ({c}), 0), 6) AS {n}" for n, c in XG.items()]]


@query("event_counters", f"WITH {FE} SELECT match_id, user_id AS player_id, {', '.join(_SUMS)} FROM fe GROUP BY ALL")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that single events tell of every player and match."""
    found = events.counters(full_events(spark, sf_dir))
    return found.select("match_id", "player_id", *COUNTS, *[round_even(F.col(c), 6).alias(c) for c in XG])


XA = f"{FE}, xa AS (SELECT s.match_id, p.user_id, round_even(SUM(s.value), 6) AS xa FROM fe s JOIN fe p ON s.match_id = p.match_id AND p.n = s.n - 3 WHERE s.k = 3 AND s.a % 2 = 0 AND p.k <= 1 GROUP BY ALL)"


@query("event_xa", f"WITH {XA} SELECT match_id, user_id AS player_id, xa FROM xa")
def event_xa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.expected_assists(full_events(spark, sf_dir)).withColumn("xa", round_even(F.col("xa"), 6))


SCA = f"""{FE}, o AS (SELECT *, mi // 3 AS possession, row_number() OVER (PARTITION BY match_id ORDER BY n) AS r FROM fe), c AS (SELECT *, CASE WHEN possession = lag(possession) OVER (PARTITION BY match_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM o),
  g AS (SELECT *, SUM(new) OVER (PARTITION BY match_id ORDER BY n) AS run FROM c), j AS (SELECT s.match_id, s.r AS pos, s.a % 5 = 0 AS goal, p.user_id, MAX(p.r) AS last FROM g s JOIN g p ON s.match_id = p.match_id AND s.run = p.run AND s.team = p.team AND p.r < s.r AND s.r - p.r <= 39
    WHERE s.k = 3 AND (p.k <= 1 AND p.a % 3 <> 0 OR p.k = 4 AND p.a % 2 = 0 OR p.k = 13) GROUP BY ALL), t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY match_id, pos ORDER BY last DESC) <= 2)"""


@query("event_shot_creation", f"WITH {SCA} SELECT match_id, user_id AS player_id, CAST(COUNT(*) AS DOUBLE) AS sca, CAST(COUNT(*) FILTER (goal) AS DOUBLE) AS gca FROM t GROUP BY ALL")
def event_shot_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.shot_creation(full_events(spark, sf_dir))


@query(
    "event_dribblers",
    f"""WITH {FE}, r AS (SELECT match_id, n, k, a, user_id, a % 3 <> 1 AS named FROM fe), d AS (SELECT e.*, EXISTS (SELECT 1 FROM fe o WHERE o.match_id = e.match_id AND o.n IN (e.n - 1, e.n - 5) AND o.k = 4) AND named AS dribble,
      EXISTS (SELECT 1 FROM fe o WHERE o.match_id = e.match_id AND o.n IN (e.n - 1, e.n - 5) AND o.k = 3) AND named AS shot FROM r e WHERE k IN (5, 8, 17))
    SELECT match_id, user_id AS player_id, CAST(COUNT(*) FILTER (k = 5 AND a % 2 = 0 AND dribble) AS DOUBLE) AS dribblers_tackled, CAST(COUNT(*) FILTER (k = 5 AND a % 2 = 0 AND dribble OR k = 17) AS DOUBLE) AS dribblers_challenged,
      CAST(COUNT(*) FILTER (k = 8 AND shot) AS DOUBLE) AS shots_blocked FROM d GROUP BY ALL""",
)
def event_dribblers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.dribblers_and_blocks(full_events(spark, sf_dir))


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups from the events: every third user of a match starts and leaves by his number, others come on; some change position on the way."""
    per = full_events(spark, sf_dir).groupBy("match_id", F.col("team.name").alias("team"), F.col("player.id").alias("player_id")).agg(F.count("*").alias("c"))
    u = F.col("player_id")
    clock = lambda m: F.concat(m.cast("string"), F.lit(":30"))
    starts = u % 3 == 0
    first = F.struct(
        _pick(u, "Goalkeeper", "Center Back", "Left Wing").alias("position"), F.when(starts, F.lit(None).cast("string")).otherwise(clock(20 + u % 40)).alias("from"), F.when(u % 4 > 0, clock(60 + u % 20)).alias("to"),
        F.when(starts, "Starting XI").otherwise("Substitution - On (Tactical)").alias("start_reason"), F.when(u % 4 == 1, "Substitution - Off (Tactical)").when(u % 4 == 2, "Tactical Shift").alias("end_reason"),
    )
    second = F.struct(_pick(u + 1, "Goalkeeper", "Center Back", "Left Wing").alias("position"), clock(55 + u % 20).alias("from"), F.lit(None).cast("string").alias("to"), F.lit("Tactical Shift").alias("start_reason"), F.lit(None).cast("string").alias("end_reason"))
    return per.select("match_id", "team", F.lit(96.0).alias("match_end"), "player_id", F.when(u % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("spells"))


LINES = f"""{FE}, l AS (SELECT DISTINCT match_id, team, user_id AS u FROM fe), s AS (SELECT *, CASE WHEN u % 3 = 0 THEN 0.0::DOUBLE ELSE 20.5::DOUBLE + u % 40 END AS s1, CASE WHEN u % 4 > 0 THEN 60.5::DOUBLE + u % 20 ELSE 96.0 END AS e1, 55.5::DOUBLE + u % 20 AS s2,
    u % 2 = 0 AS two, u % 4 = 1 AS leaves FROM l), m AS (SELECT *, GREATEST(0.0::DOUBLE, e1 - s1) * 90.0 / 96.0 AS m1, CASE WHEN two AND NOT leaves THEN GREATEST(0.0::DOUBLE, 96.0 - GREATEST(s2, e1)) * 90.0 / 96.0 ELSE 0 END AS m2a,
    CASE WHEN two THEN GREATEST(0.0::DOUBLE, 96.0 - s2) * 90.0 / 96.0 ELSE 0 END AS m2b, GREATEST(0.0::DOUBLE, e1 - GREATEST(s1, 96.0)) * 90.0 / 96.0 AS m1b FROM s)"""
PLAYED = f"""{LINES}, p AS (SELECT *, CASE WHEN two AND s2 < s1 THEN m2b + m1b ELSE m1 + m2a END AS total FROM m)"""


@query("event_minutes", f"WITH {PLAYED} SELECT match_id, u AS player_id, round_even(LEAST(total, 90.0::DOUBLE), 6) AS minutes, u % 3 = 0 AS started FROM p WHERE total > 0")
def event_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes by spells that never overlap, ended by leaving the pitch."""
    return events.minutes_played(lineups(spark, sf_dir)).select("match_id", "player_id", round_even(F.col("minutes"), 6).alias("minutes"), "started")


FEED_COUNTS = ("passes_completed", "shots", "tackles", "fouls_won")
_FEED = ", ".join(f"CAST(COUNT(*) FILTER ({COUNTS[c]}) AS DOUBLE) AS {c}" for c in FEED_COUNTS)


@query(
    "event_feed",
    f"""WITH {PLAYED}, c AS (SELECT match_id, user_id AS u, {_FEED} FROM fe GROUP BY ALL), w AS (SELECT p.*, c.* EXCLUDE (match_id, u), match_id % 4 AS lg FROM p JOIN c USING (match_id, u) WHERE total > 0)
    SELECT u AS player_id, 'L' || lg AS league, CAST(round_even(SUM(LEAST(total, 90.0::DOUBLE)), 0) AS INT) AS minutes, CAST(COUNT(*) AS BIGINT) AS matches, CAST(COUNT(*) FILTER (u % 3 = 0) AS DOUBLE) AS starts, {', '.join(f'SUM({c}) AS {c}' for c in FEED_COUNTS)} FROM w GROUP BY u, lg""",
)
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and line-ups to player-seasons: the whole way, four competitions of matches."""
    lines = lineups(spark, sf_dir)
    about = lines.select(
        "match_id", "player_id", "team", F.concat(F.lit("L"), (F.col("match_id") % 4).cast("string")).alias("league"), F.lit("2024-25").alias("season"), F.col("player_id").cast("string").alias("player"), F.lit("Nowhere").alias("nationality"),
        F.lit(50.0).alias("possession"),
    )
    out = feeds.event_feed(full_events(spark, sf_dir), lines, about, list(FEED_COUNTS))
    return out.select("player_id", "league", "minutes", "matches", "starts", *FEED_COUNTS)
