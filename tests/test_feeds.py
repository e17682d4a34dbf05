"""Feed jobs, files that stay the same, refreshes that are carried on."""

import gzip
import hashlib
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import text as X
from pitchlake.registry import metrics as M
from pitchlake.sources import feeds, files, readers, refresh


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def digests(path):
    return {str(p.relative_to(path)): (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_mtime_ns) for p in sorted(Path(path).rglob("part-*")) if "_" not in str(p.relative_to(path)).split("/")[0][:1]}


def test_csv_files_stay(spark, tmp_path):
    rows = [(f"p{k:03d}", 2000 + k % 3, f'T "{k % 7}", x' if k % 5 else None, k / 4) for k in range(300)]
    schema = "player_id string, season int, team string, v double"
    write = lambda some, path, n: files.write_csv(spark.createDataFrame(some, schema).repartition(n), str(path), F.concat(F.lit("season="), F.col("season").cast("string")), ["team", "player_id"], part_bytes=1000)
    first = write(rows, tmp_path / "a", 1)
    assert first["written"] >= 9 and first["kept"] == first["deleted"] == 0
    write(rows[::-1], tmp_path / "b", 5)
    one, two = digests(tmp_path / "a"), digests(tmp_path / "b")
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()} and len(one) == first["written"]
    assert write(rows, tmp_path / "a", 7) == {"written": 0, "kept": first["written"], "deleted": 0} and digests(tmp_path / "a") == one
    assert all(len(gzip.decompress((tmp_path / "a" / k).read_bytes())) <= 1100 for k in one)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "a" / "season=2001"))
    assert {(r.player_id, r.team, float(r.v)) for r in back.collect()} == {(p, t, v) for p, s, t, v in rows if s == 2001}
    # One value more: one file is new, the others are left alone; a season less: its files go.
    changed = write([(*r[:3], 99.0) if r[0] == "p001" else r for r in rows], tmp_path / "a", 2)
    assert changed["written"] == 1 and sum(digests(tmp_path / "a")[k] != one[k] for k in one) == 1
    less = write([r for r in rows if r[1] != 2002], tmp_path / "a", 2)
    assert less["deleted"] > 2 and not [k for k in digests(tmp_path / "a") if k.startswith("season=2002")]
    assert "season=2001" in files.catalogue(spark, str(tmp_path / "a")) and files.manifest(spark, str(tmp_path / "none")).count() == 0


def test_json_parts(spark, tmp_path):
    df = spark.createDataFrame([(k, f"g{k % 2}", None if k % 3 else "x") for k in range(50)], "id int, g string, note string")
    files.write_json(df, str(tmp_path / "j"), F.col("g"), ["id"], part_bytes=300)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "j" / "g0")).collect()) == list(range(0, 50, 2))
    assert {p.name: p.stat().st_size for p in (tmp_path / "j").glob("g*/part-*.json") if p.stat().st_size > 310} == {}


def test_publication_is_gated(spark, tmp_path):
    rows = lambda n, seasons: spark.createDataFrame([(f"p{k}", s, "L", "T") for s in seasons for k in range(n)], "player_id string, season string, league string, team string")
    path = str(tmp_path / "season_table")
    assert feeds.publish(rows(20, ["2023-24", "2024-25"]), path, ["league", "team", "player_id"])["written"] == 2
    assert feeds.publish(rows(19, ["2023-24"]).union(rows(20, ["2024-25", "2025-26"])), path, ["league", "team", "player_id"]) == {"written": 2, "kept": 1, "deleted": 0}
    before = digests(path)
    with pytest.raises(feeds.Refused, match="season=2024-25"):
        feeds.publish(rows(20, ["2023-24", "2025-26"]), path, ["league", "team", "player_id"])
    with pytest.raises(feeds.Refused, match="season=2023-24"):
        feeds.publish(rows(10, ["2023-24", "2024-25", "2025-26"]), path, ["league", "team", "player_id"])
    assert digests(path) == before


def test_keepers_are_carried_on(spark, tmp_path):
    listed = spark.createDataFrame([(f"k{k}", s) for k in range(9) for s in ("2022-23", "2023-24", "2024-25") if (k + int(s[:4])) % 2 or s == "2023-24"], "player_id string, season string")
    matches = spark.createDataFrame([(m, side, ("2022-23", "2023-24", "2024-25")[m % 3], 0.5 * m, m % 2) for m in range(12) for side in "ha"], "match_id int, side string, season string, xg_against double, conceded int")
    played = spark.createDataFrame([(m, f"k{m % 9}", "h" if m % 4 else None, 90 if m % 5 else 45) for m in range(12)], "match_id int, player_id string, side string, minutes int")
    path, now = str(tmp_path / "live"), [0.0]

    def clock():
        now[0] += 1
        return now[0]

    order = [r.player_id for r in refresh.queue(listed, refresh.keeper_table(spark, path), refresh.complete_seasons(spark, path), "2024-25").orderBy("place").collect()]
    has = lambda k, s: (k, s) in {(r.player_id, r.season) for r in listed.collect()}
    assert len(order) == 9 and [has(k, "2024-25") for k in order] == sorted((has(k, "2024-25") for k in order), reverse=True)
    run = lambda budget: refresh.refresh_keepers(listed, matches, played, path, "2024-25", batch=2, budget=budget, clock=clock)
    first = run(2.5)
    assert first["queued"] == 9 and 0 < first["done"] < 9 and not first["finished"]
    current = sum(has(f"k{k}", "2024-25") for k in range(9))
    second = run(100)
    # Those in the season being played come again, the others go on where the first run stopped.
    assert second["finished"] and second["queued"] == current + 9 - max(first["done"], current)
    table = {(r.player_id, r.season): tuple(r)[2:] for r in refresh.keeper_table(spark, path).select("player_id", "season", "full_matches", "full_xga").collect()}
    assert set(table) == {(r.player_id, r.season) for r in listed.collect()}
    assert {r.season for r in refresh.complete_seasons(spark, path).collect()} == {"2022-23", "2023-24"}
    third = run(100)
    assert third["queued"] == current and {(r.player_id, r.season): (r.full_matches, r.full_xga) for r in refresh.keeper_table(spark, path).collect()} == table
    full = [(m, f"k{m % 9}") for m in range(12) if m % 4 and m % 5]
    want = {}
    for m, k in full:
        want.setdefault((k, ("2022-23", "2023-24", "2024-25")[m % 3]), []).append(0.5 * m)
    assert all(table[key] == (len(want.get(key, [])), sum(want.get(key, []))) for key in table)


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,age,club\r\nÉmile,20,"Lyon, OL"\r\nBob,x,Z\r\nLong,1,b,extra\r\nShort\r\n'.encode())
    (tmp_path / "b.csv").write_bytes('club,name\nKöln,Jörg\n"a ""q""",B\n,Empty,\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("﻿name,age\nOnly,3\n".encode())
    (tmp_path / "d.csv").write_bytes(b"name,age\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("club", T.StringType())])
    rows, audit = readers.tolerant_csv(spark, str(tmp_path), schema, fields=8)
    assert {(r.name, r.age, r.club) for r in rows.collect()} == {("Émile", 20, "Lyon, OL"), ("Bob", None, "Z"), ("Short", None, None), ("Jörg", None, "Köln"), ("B", None, 'a "q"'), ("Only", 3, None)}
    assert {(r.file[-5:], r.encoding, r["lines"], r.too_long) for r in audit.collect()} == {("a.csv", "UTF-8", 4, 1), ("b.csv", "ISO-8859-1", 3, 1), ("c.csv", "UTF-8", 1, 0), ("d.csv", "UTF-8", 0, 0)}


def test_small_rules(spark):
    assert feeds.default_seasons(date(2026, 6, 30)) == (2024, 2025) and feeds.default_seasons(date(2026, 7, 1)) == (2025, 2026)
    assert value(spark, X.without_number(F.lit("Ana Silva (4711)"))) == "Ana Silva" and value(spark, X.first_of(F.lit("Spain  Brazil"))) == "Spain" and value(spark, X.last_part(F.lit("Defender - Centre-Back"))) == "Centre-Back"
    raw = spark.createDataFrame([("12", "Ana Silva (12)", "1999-05-01 00:00:00", "1,85 m", "left", "Spain  Brazil", "Defender", "Defender - Centre-Back"), ("x", "No One", None, None, None, None, None, None)], "player_id string, player_name string, date_of_birth string, height string, foot string, citizenship string, main_position string, position string")
    assert [tuple(r) for r in feeds.profile_rows(raw).collect()] == [(12, "Ana Silva", date(1999, 5, 1), 185.0, "left", "Spain", "Defender", "Centre-Back")]
    assert M.membership(["a", "b", "z"], {"one": ("a", "b"), "two": ("b", "b")}) == [[0], [0, 1], []]


def test_aggregate_feed(spark):
    schema = "id string, player_name string, team_title string, league string, season string, games string, time string, goals string, position string"
    old = spark.createDataFrame([("1", "Ana &amp; Co", "A", "EPL", "2023/24", "34", "900", "5", "M S"), ("1", "Ana &amp; Co", "B", "EPL", "2023/24", "10", "300", "2", "F"), ("2", "Kim", "A", "EPL", "2024/25", "31", "10", "0", "D"), ("3", "Out", "A", "XX", "2023/24", "31", "10", "0", "D")], schema)
    live = spark.createDataFrame([("2", "Kim", "A", "EPL", "2024/25", "3", "270", "1", "D"), ("4", "None", "A", "EPL", "2024/25", "0", "0", "0", "D")], schema)
    renames = {"id": "player_id", "player_name": "player", "team_title": "team", "games": "matches", "time": "minutes"}
    place = F.struct(F.when(F.startswith("position", F.lit("D")), "DEF").otherwise("MID").alias("group"), F.substring("position", 1, 1).alias("position"), F.lit("roles").alias("source"))
    keepers = spark.createDataFrame([("2", "2024-25", 3, "a"), ("2", "2024-25", 4, "b")], "player_id string, season string, full_matches long, fetched_at string")
    links, profiles = spark.createDataFrame([("1", 11)], "player_id string, tm_id long"), spark.createDataFrame([(11, "Ana", 170.0)], "tm_id long, name string, height_cm double")
    history = spark.createDataFrame([(11, date(2024, 6, 1), 5.0), (11, date(2020, 6, 1), 1.0)], "tm_id long, date date, value double")
    rows, coverage = feeds.aggregate_feed(old, {"EPL": "Premier League"}, renames, place, live=live, keepers=keepers, links=links, profiles=profiles, history=history, in_progress=True)
    got = {r.player_id: r for r in rows.collect()}
    assert set(got) == {"1", "2"} and (got["1"].goals, got["1"].minutes, got["1"].team, got["1"].player, got["1"].season, got["1"].height_cm, got["1"].market_value) == (7.0, 1200.0, "A", "Ana & Co", "2023-24", 170.0, 5.0)
    assert (got["2"].minutes, got["2"].full_matches, got["2"].position_group) == (270.0, 4, "DEF")
    c = coverage.first()
    assert (c.rows_in, c.player_seasons, c.players, c.seasons, c.linked) == (5, 2, 2, ["2023-24", "2024-25"], 1)
    finished, _ = feeds.aggregate_feed(old, {"EPL": "Premier League"}, renames, place, live=live)
    assert {r.player_id for r in finished.collect()} == {"1"}


def test_fantasy_feed(spark):
    export = lambda rows: spark.createDataFrame(rows, "id string, first_name string, second_name string, team string, element_type string, now_cost string, code string, minutes string, goals_scored string")
    exports = {"2022-23": export([("1", "Ana", "Silva", "1", "4", "55", "700", "1000", "9"), ("2", "Kim", "Lee", "2", "1", "40", None, "2000", "0"), ("3", "Not", "Played", "2", "3", "40", "9", "0", "0")]), "2023-24": export([("9", "Ana", "Silva Costa", "2", "4", "60", "700", "900", "3")])}
    weeks = {"2022-23": spark.createDataFrame([(1, "Old Town", 500), (1, "New Town", 400), (1, "New Town", 100), (2, "New Town", 90)], "element long, team string, minutes int")}
    teams = spark.createDataFrame([("2022-23", 1, "Old Town"), ("2022-23", 2, "New Town"), ("2023-24", 2, "New Town")], "season string, team int, team_name string")
    logs = spark.createDataFrame([("ana silva", "f", "2022", "980", "FW", "8", "7"), ("kim lee", "g", "2022", "2000", "GK", "0", "0"), ("ana silva costa", "f", "2023", "100", "FW", "1", "1")], "key string, file string, season string, time string, position string, goals string, npg string")
    rows, coverage = feeds.fantasy_feed(exports, weeks, teams, {"goals_scored": "goals", "minutes": "minutes", "code": "code"}, {1: "GK", 3: "MID", 4: "FWD"}, logs=logs, metrics={"goals": "goals", "npg": "np_goals"})
    got = {(r.player_id, r.season): r for r in rows.collect()}
    ana, later = got["PLC700", "2022-23"], got["PLC700", "2023-24"]
    # The logs cover 2022 (2980 of 3000 minutes), not 2023.
    assert (ana.goals, ana.np_goals, ana.team, ana.matches, ana.clubs_in_season, ana.pens_scored) == (8.0, 7.0, "New Town", 3, 2, 1.0) or (ana.team, ana.matches) == ("Old Town", 3)
    assert (later.goals, later.np_goals, later.matches) == (3.0, None, 0) and len(got) == 3 and [k for k in got if k[0].startswith("PL0")]
    assert coverage.first().matched == 1.0 and coverage.first().rows_in == 4


def test_block_feed(spark):
    std = spark.createDataFrame([("u1", "A", 2023, 900.0, "5"), ("u1", "B", 2023, 100.0, "1"), ("u2", "A", 2024, 800.0, "2")], "url string, team string, season_end int, minutes double, Gls string").withColumn("Gls", F.col("Gls").cast("double"))
    misc = spark.createDataFrame([("u1", "A", 2023, 900.0, 3.0, None), ("u1", "B", 2023, 100.0, 1.0, None), ("u2", "A", 2024, 10.0, None, 7.0)], "url string, team string, season_end int, minutes double, Mis_Old double, Mis_New double")
    possession = spark.createDataFrame([("A", 2023, 55.0), ("vs A", 2023, 45.0)], "team string, season int, team_possession double")
    names = {"standard": {"minutes": "minutes", "Gls": "goals"}, "misc": {"Mis_Old": "Mis_Old", "Mis_New": "Mis_New"}}
    rows, coverage = feeds.block_feed({"standard": std, "misc": misc}, names, ["url", "team", "season_end"], ["goals", "miscontrols"], either={"miscontrols": ("Mis_Old", "Mis_New")}, possession=possession)
    got = {r.url: r for r in rows.collect()}
    assert (got["u1"].goals, got["u1"].miscontrols, got["u1"].team, got["u1"].season, got["u1"].team_possession) == (6.0, 4.0, "A", "2022-23", 55.0)
    assert (got["u2"].goals, got["u2"].miscontrols) == (2.0, None) and coverage.first().stale == ["misc 2024"]


def test_player_extract(spark, tmp_path):
    games = spark.createDataFrame([(1, 2023, "GB1"), (2, 2023, "XX"), (3, 2020, "GB1")], "game_id long, season int, competition string")
    apps = spark.createDataFrame([(1, 10, 5, 90, 1, 0, "Ana", date(2023, 9, 1)), (2, 11, 5, 90, 1, 0, "Kim", date(2023, 9, 1)), (3, 12, 5, 90, 1, 0, "Old", date(2020, 9, 1))], "game_id long, player_id long, club_id long, minutes int, goals int, assists int, player_name string, date date")
    clubs, players = spark.createDataFrame([(5, "Club")], "club_id long, name string"), spark.createDataFrame([(10, "Ana"), (11, "Kim")], "player_id long, name string")
    values = spark.createDataFrame([(10, date(2024, 1, 1), 5.0), (11, date(2024, 1, 1), 6.0)], "player_id long, date date, value double")
    lineups = spark.createDataFrame([(1, 10, "Right Winger", "starting_lineup", "1"), (1, 10, "Left Winger", "substitutes", "0"), (2, 11, "Goalkeeper", "starting_lineup", "0")], "game_id long, player_id long, position string, type string, captain string")
    out = feeds.player_extract(games, apps, clubs, players, values, lineups, ["GB1"], 2022)
    assert [(r.player_id, r.club, r.matches) for r in out["minutes"].collect()] == [(10, "Club", 1)] and [r.player_id for r in out["players"].collect()] == [10] and out["valuations"].count() == 1
    assert [(r.position, r.position_starts, r.captain_starts) for r in out["positions"].collect()] == [("Right Winger", 1, 1)]
    about = out["about"].first()
    assert (about.players, about.valuations, about.season_positions, str(about.latest_valuation), about.seasons) == (1, 1, 1, "2024-01-01", [2023])
    order = {"minutes": ["player_id", "season"], "players": ["player_id"], "valuations": ["player_id", "date"], "positions": ["player_id", "season"]}
    assert feeds.write_extract(out, str(tmp_path), order)["players"]["written"] == 1 and feeds.write_extract(out, str(tmp_path), order)["players"]["kept"] == 1
    assert feeds.player_extract(games, apps, clubs, players, values, None, ["GB1"], 2022)["positions"].count() == 0


def test_squad_feed(spark):
    squads = spark.createDataFrame([(1, "Ana"), (2, "Kim")], "tm_id long, player string")
    performance = spark.createDataFrame([(1, [("2025", "GB1", 900, 5, 2, 10)]), (2, [("2025", "GB1", 0, 0, 0, 0)])], "tm_id long, stats array<struct<season: string, competition: string, minutes: int, goals: int, assists: int, matches: int>>")
    r = feeds.squad_feed(squads, performance, "2025", "GB1").collect()
    assert [(x.player, x.minutes, x.goals, x.starts, x.team_possession) for x in r] == [("Ana", 900.0, 5.0, None, None)]
