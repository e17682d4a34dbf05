"""Operators on small tables with known results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.functions.numbers import clip, jaccard, round_even
from pitchlake.operators import aggregates, cleaning, features, joins, models, ranking, recruit, validate
from pitchlake.platform import Platform
from pitchlake.registry import metrics as M
from pitchlake.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_round_half_to_even(spark):
    assert [value(spark, round_even(F.lit(x), d)) for x, d in ((0.5, 0), (1.5, 0), (2.5, 0), (0.25, 1), (1.005, 2))] == [0.0, 2.0, 2.0, 0.2, 1.0]
    assert value(spark, clip(F.lit(None).cast("double"), 0, 1)) is None


def test_names(spark):
    assert value(spark, X.normalise_name(F.lit("Ødegaard-Šimić  Łukasz ß"))) == "odegaard simic lukasz ss"
    assert value(spark, X.initial_and_surname(F.lit("kylian mbappe"))) == "k mbappe"
    assert value(spark, X.same_person(F.lit("Rodri"), F.lit("Rodri Hernández"))) is True
    assert value(spark, X.same_person(F.lit("Ana Silva"), F.lit("Rui Silva Costa"))) is False
    assert [value(spark, X.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert value(spark, X.clock_minutes(F.lit("74:32"))) == pytest.approx(74 + 32 / 60) and value(spark, X.clock_minutes(F.lit("x"))) is None
    assert value(spark, X.height_cm(F.lit("1,85 m"))) == 185.0
    assert value(spark, X.market_value(F.lit(1_500_000.0))) == "€1.5m"
    assert value(spark, X.season_of_end(F.lit(2000))) == "1999-00"


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), (None, 5.0)], "g string, v double")
    got = {(r.g, r.v): r.p for r in ranking.percentiles(df, "v", ["g"], "p").collect()}
    assert got == {("a", 1.0): 33.3, ("a", 2.0): 83.3, ("a", None): None, (None, 5.0): None}
    flipped = {r.v: r.p for r in ranking.percentiles(df.where("g = 'a'"), "v", ["g"], "p", True).collect()}
    assert flipped[1.0] == 66.7 and flipped[2.0] == 16.7


def test_newcomers_leave_regulars_alone(spark):
    regulars = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    new = spark.createDataFrame([("x", "a", 3.0), ("y", "a", 9.0), ("z", "a", None)], "id string, g string, v double")
    got = {r.id: r.p for r in ranking.place_among(regulars, new, "v", ["g"], "p").collect()}
    assert got == {"x": 70.0, "y": 100.0, "z": None}


def test_as_of(spark):
    history = spark.createDataFrame([(1, date(2023, 2, 1), 10.0), (1, date(2024, 6, 15), 30.0), (1, date(2025, 1, 10), 50.0), (2, date(2019, 1, 1), 5.0)], "tm_id long, d date, v double")
    probes = spark.createDataFrame([(1, date(2024, 7, 1)), (1, date(2023, 7, 1)), (2, date(2024, 7, 1)), (3, date(2024, 7, 1)), (None, date(2024, 7, 1))], "tm_id long, at date")
    got = {(r.tm_id, r["at"].year): r.value for r in joins.as_of(probes, history, "tm_id", "at", "d", "v", "value").collect()}
    assert got == {(1, 2024): 30.0, (1, 2023): 10.0, (2, 2024): None, (3, 2024): None, (None, 2024): None}


def test_transfers(spark):
    rows = [("p", 2024, "A", 382.0, 2.0, 30.0, 4.0), ("p", 2024, "B", 158.0, 1.0, 40.0, None), ("q", 2024, "Z", 90.0, 1.0, 1.0, 1.0), ("q", 2024, "C", 90.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "player_id string, season int, team string, minutes double, goals double, avg_length double, tackles double")
    got = {r.player_id: r for r in aggregates.collapse_transfers(df, ["player_id", "season"], ["goals", "tackles"], ["avg_length"], []).collect()}
    p = got["p"]
    assert (p.minutes, p.goals, p.team, p.clubs_in_season, p.tackles) == (540.0, 3.0, "A", 2, None) and p.avg_length == pytest.approx((382 * 30 + 158 * 40) / 540)
    assert got["q"].team == "C"


def test_eras_and_stale_blocks(spark):
    archive = spark.createDataFrame([(2022, "a", 1.0), (2023, "a", 9.0)], "y int, url string, Att_Vs double")
    release = spark.createDataFrame([(2022, "a", 5.0), (2023, "a", 2.0)], "y int, url string, Att_Challenges double")
    got = {r.y: r.Att_Vs for r in joins.merge_eras(archive, release, {"Att_Vs": "Att_Challenges"}, "y", 2023).collect()}
    assert got == {2022: 1.0, 2023: 2.0}
    reference = spark.createDataFrame([("a", 2024, 50.0), ("a", 2025, 50.0)], "k string, y int, m double")
    block = spark.createDataFrame([("a", 2024, 50.0), ("a", 2025, 11.0)], "k string, y int, m double")
    assert [r.y for r in aggregates.drop_stale_seasons(block, reference, ["k", "y"], "m", "y").collect()] == [2024]


def test_rows_are_dealt_in_parts_of_a_size_and_seasons_dropped_without_a_join_of_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 500).alias("k"), (2023 + F.col("id") % 2).alias("y"), F.lit(10.0).alias("all"))
    dealt = aggregates.dealt(rows, ["k", "y"], 100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000 and aggregates.dealt(rows.limit(0), ["k"]).count() == 0
    assert dealt.select("k", "y", F.spark_partition_id().alias("p")).distinct().groupBy("k", "y").count().where("count > 1").isEmpty()
    both = dealt.withColumn("mine", F.when(F.col("y") == 2024, F.col("all") * 0.9).otherwise(F.col("all")))
    kept = aggregates.drop_stale(both, both, "mine", "all", "y")
    assert {r.y for r in kept.select("y").distinct().collect()} == {2023} and kept.count() == 500
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def test_links(spark):
    ours = spark.createDataFrame(
        [("1", "Jean-Pierre Martin", 2024, "L1", "FC Lyon", 1800.0), ("2", "Luis Suárez", 2024, "ES1", "Real Betis", 900.0), ("3", "Luis Suarez", 2024, "FR1", "Lens", 900.0), ("4", "Alexander Petrovsky", 2024, "RU1", "Dynamo", 3000.0)],
        "player_id string, player string, season int, league string, team string, minutes double",
    )
    theirs = spark.createDataFrame(
        [(11, "J. Martin", 2024, "L1", "Lyon", 1790.0), (12, "Luis Suarez", 2024, "ES1", "Betis", 880.0), (13, "Luis Suarez", 2024, "FR1", "RC Lens", 910.0), (14, "Ivan Petrovsky", 2024, "RU1", "Dynamo", 300.0)],
        "tm_id long, name string, season int, league string, club string, minutes double",
    )
    assert {(r.player_id, r.tm_id) for r in joins.link_players(ours, theirs).collect()} == {("1", 11), ("2", 12), ("3", 13)}


def test_team_share_and_ratio(spark):
    rows = [("star", 900.0, 20.0)] + [(f"p{k}", 900.0, 10.0) for k in range(10)]
    df = spark.createDataFrame(rows, "player_id string, minutes double, shots double").withColumns({"season": F.lit(1), "league": F.lit("L"), "team": F.lit("T")})
    got = features.team_share(df, "shots", "shots", "share").where("player_id = 'star'").first().share
    assert got == pytest.approx(round(100 * (20 / 900) / (120 / 900), 2))
    thin = df.withColumn("minutes", F.lit(300.0))
    assert features.team_share(thin, "shots", "shots", "share").where("share IS NOT NULL").isEmpty()
    eb = spark.createDataFrame([("a", 10.0, 10.0), ("a", 0.0, 0.0), ("a", None, 10.0)], "g string, s double, t double")
    got = sorted((r.r for r in features.shrunk_by_table(eb, {"r": ("s", "t", 20.0)}, ["g"]).collect()), key=lambda x: x or 0)
    assert got == [None, 50.0, 66.67]


def test_cleaning_is_idempotent(spark):
    rows = [("a", "s", "CB", 900.0, 5.0, 6.0, 14.0), ("a", "s", "CB", 800.0, 1.0, 1.0, 20.0), ("b", "s", "CB", 5000.0, 1.0, 1.0, 20.0), ("c", "s", "CB", 90.0, -1.0, 1.0, 20.0), ("d", "s", "GK", 90.0, 1.0, None, 20.0)]
    df = spark.createDataFrame(rows, "player_id string, season string, position_group string, minutes double, shots double, shots_on_target double, age double")
    once, audit = cleaning.clean_players(df, ["shots", "shots_on_target"], ["shots"])
    twice, _ = cleaning.clean_players(once, ["shots", "shots_on_target"], ["shots"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    a = once.where("player_id = 'a'").first()
    assert (a.minutes, a.shots_on_target, a.age) == (900.0, 5.0, None)
    assert [r.n for r in audit.orderBy("step").collect()][:5] == [5, 5, 4, 3, 2]


def test_reliability(spark):
    rows = [(p, s, "CM", 1000.0, float(p) + s, float(hash((p, s, 7)) % 97)) for p in range(200) for s in (1, 2)]
    df = spark.createDataFrame(rows, "player_id int, season int, position_group string, minutes double, stable double, noise double")
    rel = models.reliability(df, ["stable", "noise"])
    got = {r.metric: r.r for r in rel.collect()}
    assert got["stable"] > 0.9 and abs(got["noise"]) < 0.3
    weights = {r.metric: r.weight for r in models.reliability_weights(rel, spark.createDataFrame([("CM", m) for m in ("stable", "noise", "new")], "position_group string, metric string")).collect()}
    assert weights["stable"] > 0.8 and weights["noise"] < weights["new"] < weights["stable"]


def test_similarity(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    got = {r.k: r.distance for r in models.neighbours(df, df.where("k = 'a'"), "k", "v", 3).collect()}
    assert got == {"b": 0.0, "c": 1.0, "z": 1.0}
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    shares = {r.feature: r.share for r in models.explained(pair, "a", "b", ["x", "y"], [1.0, 1.0]).collect()}
    assert shares == {"x": 0.2, "y": 0.8}
    assert value(spark, jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)


def test_clusters(spark):
    rows = [(k, [float(k % 2) * 10 + k / 100, float(k % 2) * 10]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    fit = models.fit_clusters(df, "k", "v", range(2, 4))
    got = fit.assign(df, "v")
    assert fit.k == 2 and validate.purity(got.withColumn("t", F.col("k") % 2), "cluster", "t").first().ari == 1.0
    rows, loadings, shares = models.pca_map(df, "v")
    assert shares[0] > 0.99 and max(loadings[0]) > 0 and rows.count() == 60


def test_price_line(spark):
    rows = [("g", float(k), 10 ** (5 + k / 40)) for k in range(40)] + [("g", 20.0, 1e4), ("h", 1.0, 1e6)]
    df = spark.createDataFrame(rows, "grp string, perf double, price double")
    out = recruit.price_line(df, "perf", "price", "grp")
    cheap = out.where("price = 1e4").first()
    assert cheap.value_residual < 0 and cheap.value_residual_pct > 90
    assert out.where("grp = 'h'").first().value_residual is None


def test_brief_and_gem(spark):
    df = spark.createDataFrame([("a", 18.0, 1800.0, 5.0), ("b", 27.0, 900.0, None), ("c", None, 450.0, 50.0)], "id string, age double, minutes double, price double")
    ids = lambda brief: {r.id for r in df.where(brief.condition()).collect()}
    assert ids(recruit.Brief(age=recruit.AgeRange(16, 40, active=False))) == {"a", "b", "c"}
    assert ids(recruit.Brief(age=recruit.AgeRange(16, 20))) == {"a"}
    assert ids(recruit.Brief(max_price=10)) == {"a", "b"}
    assert ids(recruit.Brief(thresholds=(("price", ">", 1.0),))) == {"a", "c"}
    got = {r.id: (r.u, r.s) for r in df.select("id", recruit.age_upside(F.col("age")).alias("u"), recruit.sample_size(F.col("minutes")).alias("s")).collect()}
    assert got == {"a": (100.0, 100.0), "b": (0.0, 50.0), "c": (None, 25.0)}
    gem = df.select("id", recruit.gem_score({"Age upside": "age", "Sample size": "minutes"}).alias("g")).where("id = 'c'").first().g
    assert gem == 450.0


def test_maps_and_feeds(spark):
    df = spark.createDataFrame([("p", {"CM": 30.0, "DM": 5.0}), ("p", {"CM": 10.0})], "k string, m map<string,double>")
    assert aggregates.merged_map(df, ["k"], "m", "m").first().m == {"CM": 40.0, "DM": 5.0}
    a = spark.createDataFrame([(1, None, "x")], "id long, h double, n string")
    b = spark.createDataFrame([(1, 180.0, "y"), (2, 170.0, "z")], "id long, h double, n string")
    got = {r.id: (r.h, r.n) for r in readers.first_known([a, b], "id").collect()}
    assert got == {1: (180.0, "x"), 2: (170.0, "z")}
    v = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", -1.0)], "tm_id long, date string, value double")
    w = spark.createDataFrame([(1, "2024-01-01", 7.0), (1, "2024-02-01", 8.0)], "tm_id long, date string, value double")
    assert sorted((str(r.date), r.value) for r in readers.valuations(v, w).collect()) == [("2024-01-01", 5.0), ("2024-02-01", 8.0)]
    with pytest.raises(ValueError, match="missing"):
        readers.external_table(a, {})
    assert readers.map_headers(["Unnamed Tkl", "xG"], {"tackles": ["Tkl"], "xg": ["xg"], "saves": ["Saves"]}) == ({"Unnamed Tkl": "tackles", "xG": "xg"}, ["saves"])


def test_registry():
    assert sum(M.GEM_WEIGHTS.values()) == 135 and len(M.RATIOS) == 16
    assert M.normalised({"a": 0, "b": 0}) == {"a": 50.0, "b": 50.0} and M.categories_for("GK") is M.KEEPER


def test_platform(spark):
    rows = [(f"p{k}", 2024, "CM" if k % 2 else "CB", f"T{k % 3}", "L", 1000.0 + k, float(k), float(k % 7), 20.0 + k % 10, 10.0 + k) for k in range(80)]
    df = spark.createDataFrame(rows, "player_id string, season int, position_group string, team string, league string, minutes double, shots double, goals double, age double, value double")
    p = Platform.build(df, ["shots", "goals"], {"Attack": ("shots", "goals")})
    near = p.similar("p10", 2024, 5).collect()
    assert len(near) == 5 and all(r.position_group == "CB" and r.player_id != "p10" for r in near)
    assert p.search(recruit.Brief(groups=("CM",), weights={"cat_attack": 1.0}), 3).count() == 3
    assert p.squad("T1", 2024).count() == 27 and p.peers_of("p10", 2024).count() == 40
    assert p.replacements("p10", 2024, {"cat_attack": 1.0}, 4).count() == 4
    assert p.league_table().first().players == 80 and p.strengths("p79", 2024).count() >= 1
    new = spark.createDataFrame([("n", 2024, "CB", 500.0)], "player_id string, season int, position_group string, shots double")
    assert p.project(new, ["shots"]).first().pct_shots == 100.0


def test_platform_reads_the_tables_once(spark):
    from pitchlake.plans import catalog, library  # noqa: F401

    found = catalog.QUERIES["platform_project"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not [f for f in found.inputFiles() if "lineitem" in f]
