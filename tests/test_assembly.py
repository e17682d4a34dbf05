"""Positions, links, floors, names and reports on small tables with known results."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import assembly as A
from pitchlake.operators import events as E
from pitchlake.operators import blocks, clusters, features, joins, models, moments, naming, positions, ranking, report, validate
from pitchlake.plans import catalog, library  # noqa: F401
from pitchlake.platform import Platform, across_seasons, season_index
from pitchlake.registry import metrics as M
from pitchlake.sources import readers
from pitchlake.sources.readers import EVENT


def test_ranks_in_ranges_are_ranks(spark):
    rows = [(g, None if k % 9 == 0 else float((k * 7919) % 53) ** (3 if g == "a" else 1) - 20.0) for g in ("a", "b", None) for k in range(150)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, v double")
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)

    def share(v, peers):
        return None if v is None else (sum(x < v for x in peers) + 1 + (sum(x == v for x in peers) - 1) / 2) / len(peers)

    of = lambda g: [v for h, v in rows if h == g and v is not None]
    for ranges in (2, 7, 64):
        got = {r.i: r.s for r in ranking.rank_share(df, "v", ["g"], "s", ranges).collect()}
        assert len(got) == len(rows) and all(near(got[i], None if g is None else share(v, of(g))) for i, (g, v) in enumerate(rows))
    every = [v for _, v in rows if v is not None]
    assert all(near(share(rows[r.i][1], every), r.s) for r in ranking.rank_share_of_all(df, "v", "s").collect())
    assert ranking.rank_share_of_all(df.limit(0), "v", "s").count() == 0


def test_places_and_bands(spark):
    rows = [(k, f"g{k % 3}" if k % 10 else None, None if k % 13 == 0 else float((k * 37) % 41)) for k in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(5)
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    want = {}
    for i, g, _ in order:
        want[i] = 1 + sum(want[j] > 0 for j, h, _ in order if j in want and h == g)
    assert {r.i: r.n for r in ranking.numbered(df, ["g"], ["v", "i"], "n").collect()} == want
    assert {r.i: r.n for r in ranking.numbered(df, [], ["v", "i"], "n").collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    bands = {r.i: r.b for r in ranking.quintiles(df, "v", ["i"], "b").collect()}
    assert bands == {r[0]: max(1, -(-5 * k // 199)) for k, r in enumerate(order)}
    assert ranking.quintiles(df.limit(1), "v", ["i"], "b").first().b is None and ranking.quintiles(df.limit(0), "v", ["i"], "b").count() == 0
    regulars, new = df.where("i < 150"), df.where("i >= 150")
    for by, peers in ((["g"], lambda g: [v for i, h, v in rows if i < 150 and h == g and v is not None]), ([], lambda g: [v for i, _, v in rows if i < 150 and v is not None])):
        got = {r.i: r.p for r in ranking.place_among(regulars, new, "v", by, "p").collect()}
        for i, g, v in rows[150:]:
            known = peers(g)
            place = None if v is None or by and g is None else (sum(x < v for x in known) + sum(x == v for x in known) / 2 + 1) / (len(known) + 1) * 100
            assert (got[i] is None) == (place is None) and (place is None or abs(got[i] - place) < 0.051)


def test_folding_in_order(spark):
    df = spark.createDataFrame([("SS",)] * 3 + [("AM",)] * 50 + [("WM",)] * 45 + [("W",)] * 2, "g string")
    got = {r.g: r["count"] for r in ranking.fold_thin_groups(df, "g", {"SS": "AM", "WM": "W"}).groupBy("g").count().collect()}
    assert got == {"AM": 53, "WM": 45, "W": 2}
    chained = ranking.fold_thin_groups(spark.createDataFrame([("a",)] * 3 + [("b",)] * 38 + [("c",)], "g string"), "g", {"a": "b", "b": "c"})
    assert {r.g: r["count"] for r in chained.groupBy("g").count().collect()} == {"b": 41, "c": 1}


def test_intervals_meet_in_cells(spark):
    left = spark.createDataFrame([(1, "m", 5.0), (2, "m", 10.0), (3, "m", 95.0), (4, "n", 5.0)], "id int, k string, at double")
    right = spark.createDataFrame([("m", 0.0, 10.0, "x"), ("m", 4.0, 200.0, "y"), ("m", 50.0, 50.0, "empty")], "k string, s double, e double, who string")
    got = {r.id: r.who for r in joins.within(left, right, ["k"], "at", "s", "e", 7.0, pick=F.struct("s", "who"), row=["id"]).collect()}
    assert got == {1: "x", 2: "y", 3: "y"} and joins.within(left, right, ["k"], "at", "s", "e", 7.0).count() == 4


def test_nearest_in_blocks(spark):
    rows = [(k, k % 2, [float((k * 37) % 101), float((k * 61) % 89)]) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, g int, v array<double>")
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5
    want = {k: sum(sorted(dist(v, w) for j, h, w in rows if h == g and j != k)[:5]) / 5 for k, g, v in rows}
    got = {r.k: r.mean_distance for r in models.uniqueness(df, "k", "v", "g", 5).collect()}
    assert got == pytest.approx(want)
    for metric in ("cosine", "euclid"):
        far = {(a, b): round(dist(v, w) if metric == "euclid" else 1 - sum(x * y for x, y in zip(v, w, strict=True)) / ((sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5 or 1), 6) for a, g, v in rows for b, h, w in rows if g == h and a != b}
        near = lambda a, person: sorted((d, b) for (x, b), d in far.items() if x == a and not (person and b // 3 == a // 3))[:4]  # noqa: B023, E731
        for person in (None, "p"):
            found = blocks.nearest(df.withColumn("p", F.floor(F.col("k") / 3)), "k", "v", 4, metric, "g", person, F.col("k") % 5 == 0, size=13)
            assert {(r.query, r["rank"]): (r.distance, r.k) for r in found.collect()} == {(a, i + 1): n for a in range(0, 90, 5) for i, n in enumerate(near(a, person))}
        ranks = {(r.query, r.k): r["rank"] for r in blocks.own_ranks(df.withColumn("p", F.floor(F.col("k") / 6)), "k", "v", "g", "p", metric, size=13).collect()}
        assert ranks == {(a, b): sorted((d, c) for (x, c), d in far.items() if x == a).index((far[a, b], b)) + 1 for a, b in far if a // 6 == b // 6}
    assert models.uniqueness(df.limit(5), "k", "v", "g", 5).where("mean_distance IS NOT NULL").count() == 0


def test_silhouettes_in_blocks(spark):
    rows = [(k, f"c{k % 3}", [float(k % 3 * 10 + k % 7), float(k % 5)]) for k in range(40)] + [(99, "alone", [50.0, 50.0])]
    df = spark.createDataFrame(rows, "k int, c string, v array<double>")
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5
    want = {}
    for k, c, v in rows:
        by = {d: [dist(v, w) for j, e, w in rows if e == d and j != k] for d in {e for _, e, _ in rows}}
        own, other = (sum(by[c]) / len(by[c]) if by[c] else None), min(sum(x) / len(x) for d, x in by.items() if d != c and x)
        want[k] = 0.0 if own is None else (other - own) / max(own, other)
    assert {r.k: r.silhouette for r in models.exact_silhouette(df, "k", "v", "c", size=9).collect()} == pytest.approx(want)
    assert {r.k for r in models.exact_silhouette(df, "k", "v", "c", F.col("k") < 3, size=9).collect()} == {0, 1, 2}


def test_internationals(spark):
    ours = spark.createDataFrame(
        [
            ("1", "Rodri", "Rodrigo Hernandez Cascante", "2022-23", "Spain"), ("2", "Dayotchanculle Upamecano", None, "2022-23", "France"), ("3", "Son Heung-Min", "Son Heung-Min", "2018-19", "Korea Republic"),
            ("4", "Jose Silva", "Jose Silva", "2022-23", "Brazil"), ("5", "Old Man", "Old Man", "2022-23", "Italy"),
        ],
        "player_id string, player string, full_name string, season string, nationality string",
    )
    profiles = spark.createDataFrame(
        [
            (11, "Rodrigo Hernandez", "Spain", "1996-06-22"), (12, "Dayot Upamecano", "France", "1998-10-27"), (13, "Son Heung-Min", "Korea, South", "1992-07-08"), (14, "Jose Silva", "Brazil", "1995-01-01"),
            (15, "Jose Silva", "Brazil", "1990-01-01"), (16, "Old Man", "Italy", "1940-01-01"),
        ],
        "tm_id long, name string, nationality string, date_of_birth string",
    )
    got = {(r.player_id, r.tm_id, r.how) for r in A.link_internationals(ours, profiles).collect()}
    assert got == {("1", 11, "words"), ("2", 12, "surname"), ("3", 13, "name")}
    linked = ours.join(A.link_internationals(ours, profiles), "player_id", "left").withColumn("minutes", F.lit(300.0))
    r = A.link_coverage(linked).first()
    assert (r.players, r.matched, r.by_words, r.by_surname, r.regulars_matched) == (5, 0.6, 1, 1, 0.6)


def test_links_are_withdrawn(spark):
    df = spark.createDataFrame(
        [("Iliman Ndiaye", "dialy-ndiaye", "FW", "GK", 5.0), ("Iliman Ndiaye", "iliman-ndiaye", "FW", "GK", 5.0), ("Rodri", "someone-else", "MF", "DM", 5.0)],
        "player string, url string, listed string, grp string, value double",
    )
    assert [r.value for r in positions.without_wrong_links(df, F.col("grp"), "listed", "player", "url", ["value"]).collect()] == [None, 5.0, 5.0]
    born = spark.createDataFrame([(1990, 1994, "A B", "C D", 1.0), (1990, 1994, "A B", "A B C", 1.0), (1990, 1991, "A B", "C D", 1.0), (None, 1991, "A B", "C D", 1.0)], "b int, tb int, n string, tn string, v double")
    assert [r.v for r in positions.without_other_people(born, "b", "tb", "n", "tn", ["v"]).collect()] == [None, 1.0, 1.0, 1.0]


def test_exports_and_names(spark):
    master = spark.createDataFrame([("2020-21", 1, "Old"), ("2019-20", 1, "Older")], "season string, team int, team_name string")
    own = spark.createDataFrame([("2020-21", 1, "New"), ("2020-21", 2, "Two")], "season string, team int, team_name string")
    teams = A.team_names(master, own)
    assert {(r.season, r.team): r.team_name for r in teams.collect()} == {("2020-21", 1): "New", ("2020-21", 2): "Two", ("2019-20", 1): "Older"}
    raw = spark.createDataFrame([(" Ana ", "Silva", "3", "1", "7", "55", "12", "x"), ("B", "C", "1", "9", "8", None, None, "y")], "first_name string, second_name string, element_type string, team string, id string, now_cost string, goals_scored string, web_name string")
    got = A.season_export(raw, "2020-21", teams, {"goals_scored": "goals", "lacking": "xg"}, {1: "GK", 3: "MID"}).orderBy("element").collect()
    assert [tuple(r) for r in got] == [("Ana Silva", "2020-21", "MID", "New", 7, 5.5, 12.0, None), ("B C", "2020-21", "GK", "Team 9", 8, None, None, None)]
    bars = A.appearances(spark.createDataFrame([(1, "X", "90", 12, "MID"), (1, "Y", "10", 3, "MID"), (1, "Y", None, 50, "MID")], "element int, team string, minutes string, defensive_contribution int, position string"), {"MID": 12}).first()
    assert (bars.matches, bars.clubs_in_season, bars.team, bars.dc_hits, bars.dc_bar_pct) == (2, 2, "X", 1, 50.0)
    assert A.capabilities(spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b int, c string")) == ["a", "c"]


def test_sources(spark, tmp_path):
    spark.createDataFrame([("1", "a", "s", 900.0, float("nan"))], "player_id string, player string, season string, minutes double, shots double").write.parquet(str(tmp_path / "here"))
    sources = {"gone": readers.Source("gone", str(tmp_path / "gone")), "here": readers.Source("here", str(tmp_path / "here"), "bucket")}
    df, used = readers.load_source(spark, sources, "gone", ["shots", "goals"], "here")
    assert used.key == "here" and df.first().shots is None and "goals" in df.columns
    with pytest.raises(FileNotFoundError):
        readers.load_source(spark, sources, "gone", ["shots"])
    names = spark.createDataFrame([(x,) for x in ("bb", "ba", "a", "ba1", "c", "b")], "player string")
    assert {r.player: r.n for r in readers.numbered(names, "player", "n").collect()} == {"a": 0, "b": 1, "ba": 2, "ba1": 3, "bb": 4, "c": 5}


def test_roles_and_baskets():
    roles = M.Roles({"CB": {"Stopper": {"Defending": 70, "Aerial": 30}}}, {"CB": {"Defending": 60, "Passing": 40}})
    assert roles.weights("CB", "Stopper") == {"Defending": 70, "Aerial": 30} and roles.weights("CB", "no such") == roles.weights("CB") == {"Defending": 60, "Passing": 40}
    assert roles.names("CB") == ["Balanced (position default)", "Stopper"] and set(roles.weights("FW")) == set(M.OUTFIELD)
    assert M.categories_for("GK", "bucket") is M.BUCKET_KEEPER and M.categories_for("DEF") is M.BUCKET and M.categories_for("CB", "bucket") is M.BUCKET
    assert M.percentile_metrics(["shots_per90", "save_rate", "npxg_per90"], ["FW"]) == ["npxg_per90", "shots_per90"]
    shares = {m: 1.0 for m in M.OUTFIELD["Defending"]} | {"tackles_per90": 0.2}
    assert "tackles_per90" not in M.model_features(shares, "CB") and len(M.model_features(shares, "CB")) == 6 and M.model_features({"blocks_per90": 1.0}, "CB") == []


def test_traits(spark):
    concepts = naming.concept_table(spark, {"Passing": ("pass_pct",), "Defending": ("tackles", "blocks"), "Discipline": ("errors_per90",)}, frozenset({"errors_per90"}))
    z = {0: {"tackles": 1.2, "blocks": 0.8, "pass_pct": 0.4, "errors_per90": 0.5}, 1: {"tackles": -1.0, "blocks": -1.0, "pass_pct": 0.0, "errors_per90": 0.0}, 2: {"tackles": 0.1, "blocks": 0.1, "pass_pct": 0.1, "errors_per90": 0.0}, 3: {"tackles": 1.1, "blocks": 1.3, "pass_pct": 0.5, "errors_per90": 0.0}}
    centers = spark.createDataFrame([("CB", k, f, v) for k, c in z.items() for f, v in c.items()], "g string, k int, feature string, z double")
    scores = naming.concept_scores(centers, concepts, ["g", "k"])
    assert {r.concept: r.z for r in scores.where("k = 0").collect()} == {"Passing": 0.4, "Defending": 1.0, "Discipline": -0.5}
    traits = naming.distinct_traits(scores, ["g"], "k")
    got = {r.k: ([(t.concept, t.direction) for t in r.traits], r.place) for r in traits.collect()}
    # 3 has most defending and passing together; 0 is left what 3 and 1 didn't win.
    assert got == {3: ([("Defending", 1), ("Passing", 1)], None), 1: ([("Defending", -1)], None), 0: ([("Discipline", -1)], None), 2: ([], 1)}
    words = spark.createDataFrame([("Defending", 1, "ball-winner"), ("Defending", -1, "bystander")], "concept string, direction int, word string")
    assert {r.k: r.label for r in naming.worded(traits, words, "Back, %s", "Back no. %d").collect()} == {3: "Back, ball-winner, Passing", 1: "Back, bystander", 0: "Back, Discipline", 2: "Back no. 1"}
    best = {(r.k, r.direction, r["rank"]): r.feature for r in naming.outstanding(centers, ["g", "k"], 1, 1).collect()}
    assert best == {(0, 1, 1): "tackles", (1, -1, 1): "blocks", (3, 1, 1): "blocks"}


def test_contrasts(spark):
    rows = [("x", 1.0, 1.1), ("y", 0.0, 0.1), ("z", 2.0, 0.0), ("w", -1.0, 1.0), ("n", None, 1.0)]
    df = spark.createDataFrame([(1, f, a, b, a, b) for f, a, b in rows], "p int, feature string, value_a double, value_b double, z_a double, z_b double")
    found = naming.contrasts(df, ["p"])
    assert [(r.kind, r["rank"], r.feature, r.more) for r in found.orderBy("kind", "rank").collect()] == [("apart", 1, "w", "b"), ("apart", 2, "z", "a"), ("shared", 1, "y", None), ("shared", 2, "x", None)]
    unusual = spark.createDataFrame([(1, f"u{k}", 1.0, 1.0 + k / 10, 1.0, 1.0 + k / 10) for k in range(3)] + [(1, "plain", 0.0, 0.0, 0.0, 0.0)], df.schema)
    assert [r.feature for r in naming.contrasts(unusual, ["p"]).orderBy("rank").collect()] == ["u0", "u1", "u2"]
    texts = {r.feature: r.text for r in naming.told(found, "Ana", "Kim", {"shared": "%1$s alike", "apart": "%2$s over %3$s in %1$s (%4$s, %5$s)"}).collect()}
    assert texts == {"x": "x alike", "y": "y alike", "z": "Ana over Kim in z (2.00, 0.00)", "w": "Kim over Ana in w (1.00, -1.00)"}
    spelt = spark.createDataFrame([("Shots", 1234.5), ("xG", 12.34), ("NPxG", float("nan")), ("Passes", None)], "l string, v double").select(naming.in_sentence(F.col("l")).alias("l"), naming.figure(F.col("v")).alias("v"))
    assert [tuple(r) for r in spelt.collect()] == [("shots", "1,234"), ("xG", "12.3"), ("NPxG", "n/a"), ("passes", "n/a")]
    assert [tuple(r) for r in naming.loadings([[0.1, -0.9, 0.5]], ["a", "b", "c"], spark, 2).orderBy("rank").collect()] == [(1, 1, "b", -0.9), (1, 2, "c", 0.5)]


def test_findings(spark):
    schema = "id int, age double, minutes double, league_tier int, league_strength double, position_group string, np_goals_minus_npxg_per90 double, cat_attack double, cat_passing double"
    rows = [(1, 20.0, 800.0, 2, None, "FW", 0.2, 90.0, 10.0), (2, 20.0, 3000.0, 1, 1.0, "GK", 0.9, 60.0, 60.0), (3, 33.0, 3000.0, 1, 1.0, "CB", -0.05, None, 50.0), (4, None, None, None, None, None, None, None, None)]
    found = report.findings(spark.createDataFrame(rows, schema), {"Attack": "cat_attack", "Passing": "cat_passing"}, ["id"])
    got = {(r.id, r.finding): (dict(r.figures), list(r.concerning)) for r in found.collect()}
    assert got[1, "profile"] == ({"best": 90.0, "worst": 10.0}, ["Attack", "Passing"]) and got[1, "ready_young"] == ({"age": 20.0, "categories": 1.0}, ["Attack"])
    assert got[1, "weaker_league"][0] == {"tier": 2.0, "strength": 0.8} and got[1, "finishing"][0] == {"over_expected": 0.2}
    assert {k for k in got} == {(1, "profile"), (1, "ready_young"), (1, "small_sample"), (1, "weaker_league"), (1, "finishing"), (2, "profile"), (2, "raw_young"), (3, "profile"), (3, "veteran")}
    notes = {(r.id, r.finding): r.note for r in report.noted(found).collect()}
    assert notes[1, "small_sample"].startswith("800 minutes") and all(notes.values())
    assert report.findings(spark.createDataFrame([(1, None)], "id int, cat double"), {"Attack": "cat"}, ["id"]).count() == 0


def test_moments(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (400, 6))
    x[:, 3] = x[:, 0] * 2 + rng.normal(0, 0.01, 400)
    x[rng.random((400, 6)) < 0.2] = np.nan
    x[:, 5] = 7.0
    names = [f"m.{k}" for k in range(6)]
    df = spark.createDataFrame([[None if k % 2 and v != v else float(v) for k, v in enumerate(r)] for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = {(r.a, r.b): (r.n, r.r) for r in moments.correlations(df, names).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, r = got[names[i], names[j]]
            assert n == both.sum() and (r is None if 5 in (i, j) else abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6)
    assert [(r.a, r.b) for r in models.correlated(df, names, 0.85).collect()] == [("m.0", "m.3")]
    assert moments.correlations(df.limit(0), names).where("r IS NOT NULL").count() == 0


def by_hand(x, starts):
    """Lloyd steps, distances and silhouettes one by one."""
    centers = [list(c) for c in starts]
    while True:
        label = [min(range(len(centers)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centers[c], strict=True)), c)) for v in x]
        new = [[sum(x[i][d] for i in range(len(x)) if label[i] == c) / n for d in range(len(x[0]))] if (n := label.count(c)) else centers[c] for c in range(len(centers))]
        if all(abs(a - b) < 1e-8 for p, q in zip(new, centers, strict=True) for a, b in zip(p, q, strict=True)):
            break
        centers = new
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) ** 0.5
    total = 0.0
    for i, v in enumerate(x):
        mean = {c: sum(dist(v, x[j]) for j in range(len(x)) if label[j] == c and j != i) / max(1, label.count(c) - (c == label[i])) for c in set(label)}
        if label.count(label[i]) > 1 and len(mean) > 1:
            own, other = mean[label[i]], min(d for c, d in mean.items() if c != label[i])
            total += (other - own) / max(own, other)
    return sum(dist(v, centers[c]) ** 2 for v, c in zip(x, label, strict=True)), total / len(x), sorted(label.count(c) for c in range(len(centers)))


def test_cluster_choice(spark):
    rng = random.Random(11)
    groups = {"a": [[rng.gauss(c % 3 * 6, 1), rng.gauss(c % 2 * 4, 1)] for c in range(90)], "b": [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(40)]}
    df = spark.createDataFrame([(f"{g}{i}", g, v) for g, x in groups.items() for i, v in enumerate(x)], "k string, g string, v array<double>").repartition(4)
    starts = {g: {(k, s): np.array([x[(7 * s + 5 * c) % len(x)] for c in range(k)]) for k in clusters.candidate_ks(len(x)) for s in range(3)} | {(2, s): np.array([x[s], x[-1 - s]]) for s in range(3)} for g, x in groups.items()}
    got = clusters.select_clusters(df, "k", "v", "g", starts=starts, size=17)
    for g, x in groups.items():
        every = {}
        for k, s in starts[g]:
            found = by_hand(x, starts[g][k, s].tolist())
            if k not in every or round(found[0], 6) < round(every[k][0], 6):
                every[k] = found
        for k, (inertia, silhouette, sizes) in every.items():
            fit = got[g].fits[k]
            assert (fit.inertia, fit.silhouette, sorted(fit.sizes)) == (pytest.approx(inertia), pytest.approx(silhouette, abs=1e-6), sizes)
        assert got[g].k == clusters.chosen({k: e[1] for k, e in every.items()}, {k: e[2][0] for k, e in every.items()}, len(x))
    again = clusters.select_clusters(df.repartition(3), "k", "v", "g")
    assert {g: c.chosen.centers for g, c in again.items()} == {g: c.chosen.centers for g, c in clusters.select_clusters(df, "k", "v", "g").items()} and again["a"].k == 3 and max(again["a"].fits[6].sizes) < 20  # six would be too small
    labels = clusters.assigned(df, "v", "g", again).groupBy("g", "cluster").count().collect()
    assert sorted(r["count"] for r in labels if r.g == "a") == sorted(again["a"].chosen.sizes)


def test_choice_of_numbers():
    assert clusters.candidate_ks(24) == range(2, 3) and clusters.candidate_ks(40) == range(3, 4) and clusters.candidate_ks(1000) == range(3, 10)
    assert clusters.least_size(1000) == 40 and clusters.least_size(60) == 15 and clusters.least_size(12) == 6
    assert clusters.choose_k({3: 0.20, 4: 0.19, 5: 0.14, 6: 0.10}) == 4 and clusters.choose_k({3: -0.2, 4: -0.1}) == 4
    assert clusters.choose_k({3: 0.2, 4: 0.3}, {3: 2, 4: 1}, 5) == 3 and clusters.choose_k({3: 0.2, 4: 0.9}, {3: 9, 4: 1}, 5) == 3
    assert clusters.chosen({2: 0.1, 3: 0.5, 4: 0.6}, {2: 30, 3: 8, 4: 8}, 60) == 2  # three that are too small: two are offered
    assert clusters.chosen({2: 0.9, 3: 0.5, 4: 0.49}, {2: 30, 3: 16, 4: 15}, 60) == 4
    assert clusters.elbow({3: 100.0, 4: 40.0, 5: 30.0, 6: 25.0}) == 4 and clusters.elbow({3: 1.0}) == 3


def test_sheets_and_reports(spark):
    sheet = report.Sheet({"Saves": ("gk_save_pct",), "Attack": ("shots", "goals"), "Style": ("goals", "assists")}, {"GK": ("Saves", "Style")}, frozenset({"gk_save_pct"}), frozenset({"goals"}), {"FW": ("goals", "assists", "shots")}, frozenset({"assists"}))
    assert sheet.for_group("FW", ["goals", "shots", "gk_save_pct", "assists"]) == [("Attack", ["shots", "goals"]), ("Style", ["assists"])]
    assert sheet.for_group("GK", ["goals", "gk_save_pct", "assists"]) == [("Saves", ["gk_save_pct"]), ("Style", ["assists"])]
    assert sheet.headline("FW", ["shots", "goals", "assists"]) == ["goals", "shots"] and sheet.for_role("GK", "FW", ["goals", "assists"])["order"] == ["Style"]
    pct = spark.createDataFrame([(1, "shots", 70.4), (1, "goals", 81.5), (1, "assists", 3.0)], "k int, metric string, pct double")
    assert [tuple(r) for r in report.category_averages(pct, sheet, "FW", ["k"]).collect()] == [(1, "Attack", 76.0, 2)]
    table = report.markdown_table(pct.orderBy("metric"))
    assert table.splitlines()[0] == "| k | metric | pct |" and len(table.splitlines()) == 5
    assert "Nothing to report." in report.validation_report({"Empty": pct.limit(0)}) and "| 1 | goals" in report.validation_report({"Some": pct})


def test_platform_questions(spark):
    rows = [(f"p{k % 60}", 2024 - k // 60, "CM" if k % 2 else "CB", f"T{k % 3}", "L", 1000.0 + k, float(k % 31), float(k % 7), float(k % 5), 20.0 + k % 10, 10.0 + k) for k in range(120)]
    df = spark.createDataFrame(rows, "player_id string, season int, position_group string, team string, league string, minutes double, shots double, goals double, turnover_rate double, age double, value double")
    p = Platform.build(df, ["shots", "goals", "turnover_rate"], {"Attack": ("shots", "goals")})
    low = p.pool.where("turnover_rate = 0").first()
    assert low["pct_turnover_rate"] > 60  # less is better there
    near = p.similar("p10", 2024, 5, "euclid").collect()
    assert len(near) == 5 and near[0].similarity >= near[-1].similarity and all(0 <= r.similarity <= 100 for r in near)
    assert p.pair(("p10", 2024), ("p12", 2024)).first().similarity is not None and p.pair(("p10", 2024), ("p11", 2024)).first().similarity is None
    assert {r.kind for r in p.explain(("p10", 2024), ("p12", 2024)).collect()} <= {"shared", "apart"} and p.explain(("p10", 2024), ("p12", 2024)).count() == 3
    assert p.all_similar(3).count() == 360 and p.own_seasons().where("tested > 0").count() == 2
    assert p.trajectory("p10").count() == 2 and p.has("shots") and not p.has("no such") and p.no_model_reason("CB") is None and "only 0" in p.no_model_reason("FW")
    assert p.percentiles("p10", 2024).count() == 3 and p.matching([("shots", ">=", 90.0)]).count() >= 1 and p.find_label(p.labels().first().label).count() == 1
    names = [r.label for r in p.fit_archetypes({"Finishing": ("shots", "goals"), "Care": ("turnover_rate",)}, ks=range(2, 4)).where("position_group = 'CB'").collect()]
    assert len(set(names)) == len(names) >= 2 and p.with_archetypes().where("archetype IS NULL").isEmpty()
    new = spark.createDataFrame([("n", 2024, "CB", 500.0, 0.0, "L")], "player_id string, season int, position_group string, shots double, turnover_rate double, league string")
    placed = p.with_archetypes(p.project(new)).first()
    assert placed.pct_shots == 100.0 and placed.z_shots > 3 and placed.z_goals is not None and placed.cat_attack == 100.0 and placed.archetype in names
    r = p.replacements("p10", 2024, {"cat_attack": 1.0}, 4).first()
    assert r.fit_delta is not None
    index = season_index({"2024": p})
    found = across_seasons(index, "p10|2024", 3).collect()
    assert len(found) == 3 and found[0].similarity >= found[-1].similarity
    assert p.report("p10", 2024, "Ana").startswith("# Ana\n") and p.team_profile("T1", 2024, "cat_attack").first().team_mean is not None
    watch = spark.createDataFrame([("p10", 2024), ("nobody", 2024)], "player_id string, season int")
    assert p.watched(watch).count() == 1


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_nearest_of_a_block_are_those_of_all_distances(metric):
    """With spans and with all distances alike: ties by place, copies, zero vectors, excluded rows, figures that aren't finite."""
    rng = np.random.default_rng(5)
    y = rng.normal(size=(700, 6)).round(2)
    y[100:104], y[200], y[300:303] = y[99], 0.0, 1e-4 * y[299]
    many = np.concatenate([np.tile(y[:2], (330, 1)), y[:40]])
    broken = y.copy()
    broken[[7, 400], [0, 3]] = [np.nan, np.inf]
    for rows in (y, many, broken, y[:30]):
        x, names = rows[::2], np.arange(len(rows))
        mine, theirs = (pa.table({"key": pa.array(n), "person": pa.array([None if v % 5 == 0 else int(v) // 4 for v in n], pa.int64())}) for n in (names[::2], names))
        excluded = blocks._exclusions(mine, theirs, ["key", "person"])
        i, j, d = blocks.least_of_each(x, rows, metric, 10, excluded)
        with np.errstate(invalid="ignore"):
            every = blocks.distances(x, rows, metric)
        person = np.array([-1 - n if n % 5 == 0 else n // 4 for n in names.tolist()])
        every[(names[::2, None] == names[None, :]) | ((person[::2, None] == person[None, :]) & (names[None, :] % 5 != 0))] = np.inf
        for at in range(len(x)):
            order = [q for q in np.lexsort((names, every[at])) if np.isfinite(every[at][q])][:10]
            assert j[i == at].tolist() == order and d[i == at].tolist() == pytest.approx(every[at][order].tolist(), abs=1e-9)


def test_sensitivity_meets_blocks_once_for_all_changes(spark, monkeypatch):
    met, calls = blocks.met, []
    monkeypatch.setattr(blocks, "met", lambda *a, **b: calls.append(1) or met(*a, **b))
    v = spark.range(12).select(F.col("id").alias("k"), F.lit(0).alias("g"), F.array(F.col("id").cast("double"), F.lit(1.0), F.col("id") % 3 + F.lit(0.0)).alias("v"))
    assert validate.sensitivity(v, v, "k", "v", "g", ["a", "b", "c"], [1.0] * 3, validate.dropped(["a", "b", "c"]), 4).count() == 3
    assert len(calls) == 1


def test_checks_of_models(spark):
    base = spark.createDataFrame([("q", k, f"k{k}") for k in range(1, 6)], "query string, rank int, key string")
    assert tuple(validate.compared(base, base, "key").first()) == (1.0, 1.0)
    turned = spark.createDataFrame([("q", 6 - k, f"k{k}") for k in range(1, 6)], "query string, rank int, key string")
    assert tuple(validate.compared(base, turned, "key").first()) == (1.0, -1.0)
    other = spark.createDataFrame([("q", 1, "k1"), ("q", 2, "z")], "query string, rank int, key string")
    assert tuple(validate.compared(base, other, "key").first()) == (round(1 / 6, 3), None)
    rows = spark.createDataFrame([(k, "g", [float(k % 10), float(k % 3) / 100]) for k in range(200)], "k int, g string, v array<double>")
    top = validate.feature_dominance(rows, "k", "v", "g", ["wide", "narrow"], [1.0, 1.0]).orderBy(F.desc("distance_share")).collect()
    assert top[0].feature == "wide" and top[0].distance_share > 0.8 and top[0].weight_share == 0.5
    assert validate.reference_distance(rows, "k", "v", "g").first().reference > 0 and validate.reference_distance(rows.limit(1), "k", "v", "g").count() == 0
    apart = spark.createDataFrame([(k, "A" if k % 2 else "B", float(k % 2) * 5 + (k * 37 % 11) / 10, float(k * 53 % 17)) for k in range(120)], "k int, position string, x double, y double")
    got = validate.separability(apart, [("A", "B", True), ("A", "C", True)], "position", "k", ["x", "y"]).collect()
    assert len(got) == 1 and got[0].balanced_accuracy > 0.95 and got[0].verdict == "different jobs"
    noise = validate.separability(apart.select("k", "position", F.col("y").alias("x"), "y"), [("A", "B", True)], "position", "k", ["x", "y"]).first()
    assert noise.balanced_accuracy < 0.75
    assert validate.reweighted({"a": ("x",), "b": ("q",)}, ["x", "y"]) == {"a": {"x": 3.0}} and validate.dropped(["x"]) == {"x": {"x": 0.0}}
    v = spark.createDataFrame([(k, "g", [float(k % 7), float(k % 11), float(k % 13)]) for k in range(60)], "k int, g string, v array<double>")
    s = {r.change: r for r in validate.sensitivity(v, v.where("k < 5"), "k", "v", "g", ["a", "b", "c"], [1.0] * 3, {"none": {}, "drop a": {"a": 0.0}}, 8).collect()}
    assert (s["none"].top_k_overlap, s["none"].rank_correlation) == (1.0, 1.0) and s["drop a"].top_k_overlap < 1.0


def test_build_makes_all(spark):
    stats = ["goals", "assists", "shots", "np_goals", "npxg", "xg", "xa", "tackles", "interceptions", "key_passes", "pens_taken"]
    rows = [(f"p{k}", "s", "L", "T", "CB", 900.0, 10.0, 50.0, *[float((k * (i + 2)) % 9) for i in range(len(stats))]) for k in range(12)]
    df = spark.createDataFrame(rows, "player_id string, season string, league string, team string, position_group string, minutes double, matches double, team_possession double, " + ", ".join(f"{s} double" for s in stats))
    out = features.build(df, stats)
    assert {"goals_per90", "npxg_per_shot", "xa_per_key_pass", "shot_conversion_pct", "team_shot_share", "padj_tackles_per90", "tackles_interceptions_per90", "team_defensive_action_share"} <= set(out.columns)
    assert "pens_taken_per90" not in out.columns and "_tackles_interceptions" not in out.columns and out.count() == 12


def _event(k, kind, **more):
    base = {f.name: None for f in EVENT.fields}
    t = more.pop("t", k)
    return base | {"match_id": 1, "id": f"e{k}", "index": k, "period": 1, "minute": t // 60, "second": t % 60, "possession": 1, "type": {"name": kind}} | more


def test_event_context(spark):
    a, b = {"name": "A"}, {"name": "B"}
    ev = spark.createDataFrame(
        [
            _event(1, "Dribble", team=a, player={"id": 1, "name": ""}), _event(2, "Duel", team=b, player={"id": 2, "name": ""}, duel={"type": {"name": "Tackle"}}, location=[30.0, 10.0], related_events=["e1"]),
            _event(3, "Dribbled Past", team=b, player={"id": 2, "name": ""}), _event(4, "Block", team=b, player={"id": 2, "name": ""}, related_events=["e5", "e1"]),
            _event(5, "Shot", team=a, player={"id": 1, "name": ""}, shot={"outcome": {"name": "Goal"}}, t=10), _event(6, "Miscontrol", team=b, player={"id": 3, "name": ""}, t=100),
            _event(7, "Shot", team=a, player={"id": 1, "name": ""}, shot={"outcome": {"name": "Saved"}}, t=105), _event(8, "Dispossessed", team=b, player={"id": 3, "name": ""}, t=200),
            _event(9, "Shot", team=a, player={"id": 1, "name": ""}, shot={"outcome": {"name": "Off T"}}, t=206), _event(10, "Half End", t=5400),
            _event(11, "Pass", team=b, player={"id": 9, "name": ""}, t=300, location=[5.0, 40.0], **{"pass": {"length": 45.0, "end_location": [50.0, 40.0]}}),
            _event(12, "Pass", team=a, player={"id": 1, "name": ""}, t=310, location=[80.0, 5.0], **{"pass": {"length": 35.0, "cross": True, "end_location": [110.0, 40.0], "outcome": {"name": "Incomplete"}}}),
            _event(13, "Carry", team=a, player={"id": 1, "name": ""}, t=320, location=[60.0, 40.0], carry={"end_location": [90.0, 40.0]}),
        ],
        EVENT,
    )
    assert E.match_ends(ev).first().match_end == 90.0
    r = E.dribblers_and_blocks(ev).where("player_id = 2").first()
    assert (r.dribblers_tackled, r.dribblers_challenged, r.shots_blocked) == (1.0, 2.0, 1.0)
    assert {r.player_id: r.errors for r in E.errors(ev).collect()} == {3: 1.0}
    spells = spark.createDataFrame([(1, "B", 9, 0.0, 2.0), (1, "B", 10, 2.0, None)], "match_id long, team string, player_id long, start double, end double")
    got = {r.player_id: (r.gk_shots_on_target_against, r.gk_goals_against, r.gk_crosses_faced) for r in E.keeper_context(ev, spells).collect()}
    assert got == {9: (2.0, 1.0, 0.0), 10: (0.0, 0.0, 1.0)}
    assert [(r.player_id, r.gk_launches_attempted, r.gk_launches_completed) for r in E.keeper_distribution(ev, spells).collect()] == [(9, 1.0, 1.0)]
    counted = {r.player_id: r for r in E.counters(ev).collect()}
    assert counted[1].carries_into_final_third == 1.0 and counted[2].tackles_def_third == 1.0
    lineup = spark.createDataFrame([(1, 90.0, 9, [("Goalkeeper", "Starting XI", None, "00:00", None)], "B")], "match_id long, match_end double, player_id long, spells array<struct<position:string,start_reason:string,end_reason:string,from:string,to:string>>, team string")
    whole = E.player_matches(ev, lineup).first()
    assert (whole.minutes, whole.gk_goals_against, whole.gk_launches_attempted) == (90.0, 1.0, 1.0)


def test_player_seasons_from_matches(spark):
    rows = [(1, "7", "Ana", "ES", "L", "s", "X", 90.0, True, 60.0, {"CM": 80.0, "DM": 10.0}, 2.0), (2, "7", "Ana", "ES", "L", "s", "Y", 30.4, False, 40.0, {"DM": 30.0}, 1.0), (3, "8", "Kim", "KR", "L", "s", "X", 0.0, False, 70.0, {}, 0.0)]
    df = spark.createDataFrame(rows, "match_id long, player_id string, player string, nationality string, league string, season string, team string, minutes double, started boolean, possession double, positions map<string,double>, goals double")
    got = {r.player_id: r for r in E.player_seasons(df, ["goals"]).collect()}
    a = got["7"]
    assert (a.minutes, a.matches, a.starts, a.team, a.clubs_in_season, a.position, a.goals) == (120, 2, 1.0, "X", 2, "CM", 3.0) and a.team_possession == pytest.approx((90 * 60 + 30.4 * 40) / 120.4)
    assert (got["8"].team_possession, got["8"].position) == (50.0, "CM")


def test_equal_vectors_are_met_as_one(spark):
    rows = [(f"r{k}", k % 2, f"p{k // 4}", [float((k * 7) % 3), float(k % 5 // 2)]) for k in range(120)]  # few different vectors, with a zero one
    df = spark.createDataFrame(rows, "k string, g int, p string, v array<double>")
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5
    cos = lambda x, y: 1 - sum(a * b for a, b in zip(x, y, strict=True)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1)
    near = {r.k: r.near for r in blocks.least_distances(df, "k", "v", 9, "euclid", "g", size=4).collect()}
    for k, g, _, v in rows:
        assert near[k] == pytest.approx(sorted(round(dist(v, w), 6) for j, h, _, w in rows if h == g and j != k)[:9])
    for metric, d in (("cosine", cos), ("euclid", dist)):
        want = {}
        for k, g, p, v in rows:
            line = sorted((round(d(v, w), 6) + 0.0, j) for j, h, _, w in rows if h == g and j != k)
            want |= {(k, j): i + 1 for i, (_, j) in enumerate(line) if p == f"p{int(j[1:]) // 4}"}
        ranks, places = blocks.counted_ranks(df, "k", "v", "g", "p", metric, size=4, unit=(3, 5))
        name = {r["at"]: r.key for r in places.collect()}
        assert {(name[r.a], name[r.b]): r["rank"] for r in ranks.collect()} == want
        assert {(r.query, r.k): r["rank"] for r in blocks.own_ranks(df, "k", "v", "g", "p", metric).collect()} == want


def test_rows_of_a_person_meet_by_class(spark, monkeypatch):
    """Copies of a table are as much work for the blocks as the table; ranks are those of all rows, also where many vectors tie."""
    shapes = [[float(a), float(b)] for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2)]
    rows = [(f"r{k:03d}", k % 2, None if k % 13 == 0 else f"p{k // 6}", None if k % 29 == 0 else shapes[(k * 7 + k // 15) % 15]) for k in range(130)]
    table = lambda some: spark.createDataFrame(some, "k string, g int, p string, v array<double>")
    size = lambda x: sum(a * a for a in x)
    cos = lambda x, y: 1 - sum(a * b for a, b in zip(x, y, strict=True)) / ((size(x) * size(y)) ** 0.5 or 1)
    dist = lambda x, y: size([a - b for a, b in zip(x, y, strict=True)]) ** 0.5
    for metric, d in (("cosine", cos), ("euclid", dist)):
        want = {}
        for k, g, p, v in rows:
            line = sorted((round(d(v, w), 6) + 0.0, j, q) for j, h, q, w in rows if v and w and h == g and j != k)
            want |= {(g, k, j): i + 1 for i, (_, j, q) in enumerate(line) if p and q == p}
        for most in (2, 64) if metric == "cosine" else (4,):
            ranks, places = blocks.counted_ranks(table(rows), "k", "v", "g", "p", metric, size=4, unit=(3, 7), wide=5, most=most)
            name = {r["at"]: r.key for r in places.collect()}
            assert {(r.g, name[r.a], name[r.b]): r["rank"] for r in ranks.collect()} == want

    targets, met = [], blocks.met
    monkeypatch.setattr(blocks, "met", lambda asked, *rest: targets.append(asked.agg(F.sum(F.size("targets"))).first()[0]) or met(asked, *rest))
    copies = [(f"{c}{k}", g, p and f"{c}{p}", v) for c in range(3) for k, g, p, v in rows]
    blocks.counted_ranks(table(rows), "k", "v", "g", "p")
    blocks.counted_ranks(table(copies), "k", "v", "g", "p")
    assert targets[0] == targets[1]


def test_medians_of_whole_numbers(spark):
    rows = [("a", n * n % 23) for n in range(40)] + [("b", n) for n in (0, 5)] + [("c", 7)] + [("d", n) for n in (1, 1, 2, 900)]
    got = {r.g: r.m for r in ranking.medians(spark.createDataFrame(rows, "g string, n int"), "g", "n", "m", width=3).collect()}
    assert got == {g: statistics.median(n for h, n in rows if h == g) for g in "abcd"}


def test_mean_distances_are_not_rounded_before(spark):
    df = spark.createDataFrame([(k, 0, [k * 0.0000004]) for k in range(3)], "k int, g int, v array<double>")
    got = {r.k: r.mean_distance for r in models.mean_distances(df, "k", "v", "g", digits=None).collect()}
    assert got == pytest.approx({0: 6e-7, 1: 4e-7, 2: 6e-7})


def test_first_after(spark):
    left = spark.createDataFrame([(1, "m", 5), (2, "m", 10), (3, "m", 99), (4, "n", 5), (5, None, 5)], "id int, k string, at int")
    right = spark.createDataFrame([("m", 5, "a"), ("m", 10, "c"), ("m", 10, "b"), ("m", 40, "d"), (None, 7, "e")], "k string, s int, who string")
    got = {r.id: (r._start, r.who) for r in joins.first_after(left, right, ["k"], "at", "s", ["who"]).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: (10, "b"), 2: (40, "d"), 3: (None, None), 4: (None, None)}


def test_pairs_by_set(spark):
    rows = [(k, "abc"[k % 3], [*"xyz"[: k % 4]]) for k in range(40)] + [(99, None, ["x"])]
    df = spark.createDataFrame(rows, "id int, g string, w array<string>")
    seen = []

    def within(sets):
        seen.append(sets.count())
        a, b = sets.select("g", F.col("set").alias("x"), F.col("w").alias("wa")), sets.select("g", F.col("set").alias("y"), F.col("w").alias("wb"))
        return a.join(b, "g").where(F.size(F.array_except("wa", "wb")) == 0).select("x", "y")

    got = sorted((r.a, r.b, r.same) for r in joins.pairs_by_set(df, "id", ["g", "w"], within, size=2).collect())
    assert got == sorted((a, b, v == w) for a, g, v in rows for b, h, w in rows if g == h and g and set(v) <= set(w)) and seen == [12]


def _events(spark, folder, rows):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stamp = lambda s: datetime(2024, 1, 1, 23, 50, tzinfo=timezone.utc) + timedelta(seconds=s)
    spark.createDataFrame([(k, stamp(s), u, t, 1.0, "{}") for k, (s, u, t) in enumerate(rows)], schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return {r[0] for r in duckdb.sql(catalog.ORACLES["within_window"].replace("FROM events", f"FROM '{folder}/events.parquet/*.parquet'")).fetchall()}


def test_windows_end_with_the_day(spark, tmp_path):
    rows = [(590, 1, "error"), (620, 2, "purchase"), (10, 1, "error"), (20, 1, "purchase"), (20, 1, "purchase"), (310, 3, "purchase"), (11, 3, "error"), (330, 3, "error"), (700, 4, "error"), (1000, 5, "purchase"), (700, 4, "purchase"), (701, 4, "purchase"), (1001, 6, "purchase")]
    want = _events(spark, tmp_path, rows)
    assert {r.event_id for r in catalog.QUERIES["within_window"](spark, str(tmp_path)).collect()} == want == {2, 6, 8}


def test_parts_alike_are_met_once(spark, tmp_path):
    names = ["big ring", "ring big", "big bolt", "old bolt", "old ring", "red"]
    rows = [(k, names[k * 7 % 6], "AB"[k % 2], "XY"[k // 2 % 2], k % 3, 1.0) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("jaccard_topk", "token_subset_join", "token_overlap_join"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = duckdb.sql(catalog.ORACLES[name].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'"))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_nearest_minutes(spark):
    ours = spark.createDataFrame([("a", 1, "x", 100.0), ("b", 1, "x", 10.0), ("c", 1, "x", None), ("d", 1, "y", 5.0), ("e", 2, "x", 7.0)], "player_id string, season int, k string, mins double")
    theirs = spark.createDataFrame([(9, 1, "x", 90.0), (8, 1, "x", 90.0), (7, 1, "x", 110.0), (6, 1, "x", 111.0), (5, 1, "x", None), (3, 1, "y", 5.0), (4, 1, "y", 5.0)], "tm_id int, season int, k string, tm_mins double")
    got = sorted((r.player_id, r.tm_id, r.gap) for r in joins.nearest_minutes(ours, theirs, ["season", "k"]).collect() if r.gap is not None)
    assert got == [("a", 7, 10.0), ("a", 8, 10.0), ("b", 8, 80.0), ("d", 3, 0.0), ("d", 3, 0.0)]
    blank = {(r.player_id, r.tm_id) for r in joins.nearest_minutes(ours, theirs, ["season", "k"]).where("gap IS NULL").collect()}
    assert blank == {("a", 5), ("b", 5), ("c", 5)}


def test_keepers_of_one_spell(spark):
    """Many keepers of one spell are met as the first of them."""
    events = spark.createDataFrame([(1, "e1", "Shot", "A", 30, 0)], "match_id int, id string, t string, team string, minute int, second int").selectExpr(
        "match_id", "id", "named_struct('name', t) AS type", "named_struct('name', team) AS team", "minute", "second", "named_struct('outcome', named_struct('name', 'Goal')) AS shot", "named_struct('cross', false, 'end_location', array(0.0D, 0.0D)) AS pass"
    )
    spells = spark.createDataFrame([(1, "B", k, 0.0, 90.0) for k in range(5, 50)] + [(1, "A", 1, 0.0, 90.0), (1, "B", 2, 40.0, 90.0)], "match_id int, team string, player_id int, start double, end double")
    got = E.keeper_context(events, spells).collect()
    assert [(r.player_id, r.gk_goals_against) for r in got] == [(5, 1.0)]
