"""Match events and line-ups with known results."""

import pytest

from pitchlake.operators import events as E
from pitchlake.sources.readers import EVENT, LINEUP


def made(spark, rows):
    base = {f.name: None for f in EVENT.fields}
    named = lambda n: {"name": n}
    out = []
    for k, r in enumerate(rows):
        t = r.pop("t", k)
        e = base | {"match_id": 1, "id": f"e{k}", "index": k + 1, "period": 1, "minute": t // 60, "second": t % 60, "possession": 1}
        for key in ("type", "team", "possession_team", "play_pattern"):
            if key in r:
                r[key] = named(r[key])
        if "player" in r:
            r["player"] = {"id": r["player"], "name": str(r["player"])}
        out.append(e | r)
    return spark.createDataFrame(out, EVENT)


def one(df, player):
    return df.where(f"player_id = {player}").first()


def test_possession_time(spark):
    rows = [{"type": "Pass", "t": t, "possession_team": p} for t, p in ((0, "A"), (10, "A"), (20, "B"), (30, "B"), (300, "B"))]
    got = {r.team: r.seconds for r in E.possession_time(made(spark, rows)).collect()}
    assert got == {"A": 20.0, "B": 10.0}


def test_pass_then_goal(spark):
    ev = made(
        spark,
        [
            {"type": "Pass", "team": "A", "player": 10, "location": [80.0, 40.0], "pass": {"end_location": [110.0, 40.0], "length": 30.0, "goal_assist": True}},
            {"type": "Shot", "team": "A", "player": 11, "location": [110.0, 40.0], "shot": {"statsbomb_xg": 0.42, "key_pass_id": "e0", "outcome": {"name": "Goal"}}},
        ],
    )
    assert one(E.expected_assists(ev), 10).xa == pytest.approx(0.42)
    sca = one(E.shot_creation(ev), 10)
    assert (sca.sca, sca.gca) == (1.0, 1.0)
    shooter = one(E.counters(ev), 11)
    assert (shooter.goals, shooter.np_goals, shooter.shots, shooter.shots_on_target) == (1.0, 1.0, 1.0, 1.0)
    assert one(E.counters(ev), 10).key_passes == 1.0


def test_penalty(spark):
    ev = made(spark, [{"type": "Shot", "team": "A", "player": 11, "location": [108.0, 40.0], "shot": {"statsbomb_xg": 0.78, "type": {"name": "Penalty"}, "outcome": {"name": "Goal"}}}])
    r = one(E.counters(ev), 11)
    assert (r.goals, r.pens_scored, r.np_goals, r.shots, r.npxg, r.xg) == (1.0, 1.0, 0.0, 0.0, 0.0, 0.78)


def test_passes_under_pressure(spark):
    p = {"type": "Pass", "team": "A", "player": 10, "location": [50.0, 40.0]}
    good, bad = {"end_location": [55.0, 40.0], "length": 5.0}, {"end_location": [55.0, 40.0], "length": 5.0, "outcome": {"name": "Incomplete"}}
    r = one(E.counters(made(spark, [p | {"pass": good}, p | {"pass": good, "under_pressure": True}, p | {"pass": bad, "under_pressure": True}])), 10)
    assert (r.passes_attempted, r.passes_completed, r.passes_under_pressure, r.passes_completed_under_pressure) == (3.0, 2.0, 2.0, 1.0)


def test_set_piece_and_open_play(spark):
    s = {"type": "Shot", "team": "A", "player": 9, "location": [110.0, 40.0]}
    r = one(E.counters(made(spark, [s | {"play_pattern": "From Corner", "shot": {"statsbomb_xg": 0.2}}, s | {"play_pattern": "Regular Play", "shot": {"statsbomb_xg": 0.3}}])), 9)
    assert (r.npxg_set_piece, r.npxg_open_play) == (0.2, 0.3) and r.npxg == pytest.approx(0.5)


def test_pressure_needs_the_ball_within_five_seconds(spark):
    rows = [
        {"type": "Pressure", "t": 0, "team": "A", "player": 1, "possession_team": "B"},
        {"type": "Ball Recovery", "t": 5, "team": "A", "player": 2, "possession_team": "A"},
        {"type": "Pressure", "t": 20, "team": "A", "player": 3, "possession_team": "B"},
        {"type": "Pass", "t": 26, "team": "A", "player": 2, "possession_team": "A"},
    ]
    got = {r.player_id: r.pressures_successful for r in E.successful_pressures(made(spark, rows)).collect()}
    assert got == {1: 1.0}


SPELLS = {
    "whole match": ([("00:00", None, "Starting XI", None)], 95.5, 90.0, True),
    "off at 45, listed again": ([("00:00", "45:00", "Starting XI", "Substitution - Off (Tactical)"), ("47:40", None, None, None)], 90.0, 45.0, True),
    "treated": ([("00:00", "20:00", "Starting XI", None), ("22:00", None, None, None)], 90.0, 88.0, True),
    "overlapping": ([("00:00", "60:00", "Starting XI", None), ("50:00", None, None, None)], 90.0, 90.0, True),
    "substitute": ([("60:00", None, "Substitution - On (Tactical)", None)], 90.0, 30.0, False),
}


@pytest.mark.parametrize("case", SPELLS)
def test_minutes(spark, case):
    spells, end, minutes, started = SPELLS[case]
    rows = [{"match_id": 1, "match_end": end, "player_id": 5, "spells": [{"position": "CM", "from": a, "to": b, "start_reason": c, "end_reason": d} for a, b, c, d in spells]}]
    r = E.minutes_played(spark.createDataFrame(rows, LINEUP)).first()
    assert r.minutes == pytest.approx(minutes) and r.started is started


def test_player_matches_join(spark):
    ev = made(spark, [{"type": "Pass", "team": "A", "player": 5, "location": [50.0, 40.0], "pass": {"end_location": [55.0, 40.0], "length": 5.0}}])
    lineup = spark.createDataFrame([{"match_id": 1, "match_end": 90.0, "player_id": 5, "spells": [{"position": "CM", "from": "00:00", "to": None, "start_reason": "Starting XI", "end_reason": None}]}], LINEUP)
    r = E.player_matches(ev, lineup).first()
    assert (r.minutes, r.passes_attempted, r.xa, r.positions) == (90.0, 1.0, 0.0, {"CM": 90.0})
