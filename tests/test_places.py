import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from locarium import settings as S
from locarium.operators import answers, areas, briefs, evaluation, features, hosts, network, retrieval, scoring, validation
from locarium.sources import export

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def test_points_inside_odd_shapes(spark):
    shapes = {1: ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)), 2: ring((0, 0), (4, 0), (2, 9)), 3: ring((1, 1), (5, 1))}
    df = spark.createDataFrame(list(shapes.items()), f"id int, ring {RING}")
    p = hosts.point_inside(F.col("ring"))
    got = {r["id"]: (r["x"], r["y"]) for r in df.select("id", p["x"].alias("x"), p["y"].alias("y")).collect()}
    assert got[1][0] in (1.0, 9.0) and 2 < got[1][1] < 10 and got[2] == (2.0, 4.5) and got[3] == (1.0, 1.0)


def test_outside_share_against_a_fine_grid(spark):
    parts = spark.createDataFrame([(1, ring((0, 0), (50, 0), (50, 100), (0, 100))), (2, ring((50, 0), (100, 0), (100, 60), (50, 60)))], f"part int, ring {RING}")
    points = [(1, 50.0, 40.0), (2, 2.0, 3.0), (3, 50.0, 60.0), (4, 300.0, 0.0), (5, 95.0, 55.0)]
    got = {r["k"]: r["share"] for r in areas.outside_share(spark.createDataFrame(points, "k int, x double, y double"), "k", parts, "part", 10).collect()}
    g = (np.arange(-400, 400) + 0.5) / 40
    dx, dy = (v[np.hypot(*np.meshgrid(g, g)) <= 10] for v in np.meshgrid(g, g))
    for k, x, y in points:
        a, b = x + dx, y + dy
        inside = ((a >= 0) & (a <= 50) & (b >= 0) & (b <= 100)) | ((a > 50) & (a <= 100) & (b >= 0) & (b <= 60))
        assert abs(got[k] - (1 - inside.mean())) < 2e-3
    assert got[1] == 0 and got[4] == 1


def test_overlap_needs_more_than_half_and_every_whole(spark):
    a = spark.createDataFrame([(1, ring((0, 0), (10, 0), (10, 10), (0, 10)))], f"id int, ring {RING}")
    halves = spark.createDataFrame([(1, ring((0, 0), (5, 0), (5, 10), (0, 10))), (2, ring((5, 0), (10, 0), (10, 10), (5, 10)))], f"w int, ring {RING}")
    with pytest.raises(ValueError, match="no more than"):
        areas.assign_by_overlap(a, "id", halves, "w", 10)
    far = spark.createDataFrame([(1, ring((0, 0), (8, 0), (8, 10), (0, 10))), (2, ring((50, 0), (60, 0), (60, 10)))], f"w int, ring {RING}")
    with pytest.raises(ValueError, match="has no area"):
        areas.assign_by_overlap(a, "id", far, "w", 10)


def test_outlines_stay_near(spark):
    turn = np.linspace(0, 2 * np.pi, 200)
    xy = np.stack((np.cos(turn), np.sin(turn)), axis=1) * 1000
    less = areas.simplify(xy, 25)
    assert len(less) < 40 and all(np.min(np.hypot(*(p - xy).T)) < 1e-9 for p in less)


def test_claims_beside_the_disclaimer(spark):
    d = answers.GRID_DISCLAIMER
    texts = [f"The grid is near. {d}", "The grid is near.", d.replace("Actual", "The"), "It is higher.", "The landowner is willing.", "The permit was granted.", "Permits have been approved."]
    st = spark.createDataFrame([(i, "FACT", t, ["r1" if i == 3 else "r0"], []) for i, t in enumerate(texts)] + [(9, "FACT", "It is higher.", ["r0"], [])], "statement_id int, kind string, text string, evidence_ids array<string>, quotes array<string>")
    rec = spark.createDataFrame([("r0", "CALCULATED", "x", False, "equal"), ("r1", "CALCULATED", "x", False, "b_greater")], "id string, type string, display string, knowledge boolean, relation string")
    got = {r["statement_id"]: set(r["rules"]) for r in answers.check(st, rec).collect()}
    assert got[0] == set() and got[1] == {"grid_disclaimer_missing"} and got[2] == {"grid_disclaimer_missing", "feasibility_claim"}
    assert got[3] == set() and got[9] == {"comparison_relation_mismatch"} and got[4] == {"owner_willing_claim"} and got[5] == set() and got[6] == {"approval_claim", "permit_approved_claim"}


def test_ranks_and_percentiles_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    values = [(i, None if i % 9 == 0 else float(rng.integers(0, 40)), float(rng.integers(0, 3))) for i in range(500)]
    df = spark.createDataFrame(values, "id long, a double, b double").repartition(7)
    got = {r["id"]: r for r in scoring.mid_rank(df, ["a", "b"]).collect()}
    for c, k in (("a", 1), ("b", 2)):
        have = np.array([v[k] for v in values if v[k] is not None])
        for v in values:
            want = None if v[k] is None else 100 * ((have < v[k]).sum() + (have == v[k]).sum() / 2) / len(have)
            assert (got[v[0]][f"pct_{c}"] is None) == (want is None) and (want is None or abs(got[v[0]][f"pct_{c}"] - want) < 1e-9)
    order = sorted(values, key=lambda v: (-v[2], v[0]))
    ranks = {r["id"]: r["rank"] for r in scoring.ranked(df, "b", "id").collect()}
    assert [ranks[v[0]] for v in order] == list(range(1, 501))
    assert scoring.mid_rank(df.limit(0), ["a"]).count() == 0 and scoring.ranked(df.limit(0), "b", "id").count() == 0


def test_resampling_repeats_itself(spark):
    df = spark.createDataFrame([(i, i % 7 == 0, float(i), float(-i)) for i in range(90)], "candidate_id long, hit boolean, a double, b double")
    first, again = (sorted(map(tuple, evaluation.bootstrap(x, ("a", "b"), (5, 10), runs=50).collect())) for x in (df, df.repartition(5)))
    assert first == again and {r[0] for r in first} == {"a", "b", "difference"}
    (row,) = evaluation.random_baseline(df, (10,), runs=300).collect()
    assert abs(row["mean"] - 13 / 90) < 0.02 and row["low"] <= row["mean"] <= row["high"]


def test_manifest_and_gold_errors(spark):
    docs = spark.createDataFrame([(1, "﻿# A\r\n## One\rx\n## Two\n## Two\n")], "doc_id int, text string")
    text = docs.select("doc_id", retrieval.normalised(F.col("text")).alias("text"))
    assert text.first()["text"] == "# A\n## One\nx\n## Two\n## Two\n"
    units = retrieval.sections(text)
    assert [r["title"] for r in retrieval.select_units(units, include=("One",), preamble=False).collect()] == ["One"]
    for names in (("Two",), ("Three",)):
        with pytest.raises(ValueError, match="headings"):
            retrieval.select_units(units, exclude=names)


def test_bounds_and_promotion(spark):
    f = spark.createDataFrame([(1, 2.0, 1.0, -1.0), (2, 1.0, 2.0, float("inf")), (4, None, None, None)], "candidate_id long, a double, b double, c double")
    got = {r["rule"]: r["breaches"] for r in validation.feature_bounds(f, spark.createDataFrame([(1,), (2,), (3,)], "candidate_id long"), (("a", "b"),), ("c",), ("a",), ("b",)).collect()}
    assert got == {"a exceeds b": 1, "c negative or infinite": 2, "a exceeds 1": 1, "b present": 2, "ids differ": 2}
    rings = spark.createDataFrame([("Polygon", [[[[0.0, 0.0]]]]), ("MultiPolygon", [[[[0.0, 0.0]]], [[[1.0, 1.0]]]])], "kind string, g array<array<array<array<double>>>>")
    assert [len(r["g"]) for r in rings.select(validation.promoted(F.col("g"), F.col("kind")).alias("g")).collect()] == [1, 2]


def test_brief_only_for_the_network(spark):
    sites = spark.createDataFrame([(1, 1)], "candidate_id long, rank int")
    with pytest.raises(ValueError, match="not a site"):
        briefs.brief(sites, sites.where("candidate_id = 2"), 1, S.WORLD, {})


def test_reconciled_selections(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "method string, candidate_id int")
    b = spark.createDataFrame([("x", 2), ("x", 1), ("y", 2), ("z", 5)], "method string, candidate_id int")
    got = {r["method"]: (r["missing"], r["added"], r["same"]) for r in network.reconcile(a, b).collect()}
    assert got == {"x": (0, 0, True), "y": (1, 1, False), "z": (1, 0, False)}


def test_export_is_compact_sorted_and_bounded(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "b"), (1, 0.5, "a")], "id int, v double, s string")
    out = tmp_path / "out"
    export.export_document({"sites": (df, "id")}, {"version": 1}, out, "data", 1000)
    text = (out / "data.json").read_text()
    assert json.loads(text) == {"meta": {"version": 1}, "sites": [{"id": 1, "s": "a", "v": 0.5}, {"id": 2, "s": "b", "v": None}]} and " " not in text
    assert (out / "data.js").read_text() == f"window.data={text};\n"
    with pytest.raises(ValueError, match="bytes"):
        export.export_document({"sites": (df, "id")}, {}, out, "data", 20)


def test_known_chargers_by_source(spark):
    stations = spark.createDataFrame([(2, "private", 0.0, 0.0), (3, None, 0.0, 0.0), (4, "yes", 900.0, 0.0), (10, "no", 1.0, 1.0), (3, None, 0.0, 0.0), (None, "yes", 0.0, 0.0), (5, "yes", None, None)], "id long, access string, x double, y double")
    places = spark.createDataFrame([("f1", {"amenity": "fuel", "socket:type2": "1"}, 1800.0, 0.0), ("f2", {"amenity": "fuel"}, 0.0, 0.0), ("f3", {"socket:ccs": "1"}, 0.0, 0.0), ("f4", None, 0.0, 0.0)], "id string, tags map<string,string>, x double, y double")
    manual = spark.createDataFrame([("3", 9000.0, 9000.0), ("m/1", 2700.0, 0.0)], "id string, x double, y double")
    records, figures = features.known_chargers(stations, places, manual, ("amenity=fuel",), 900.0)
    # a chain over three sources is one site; equal ids of two sources aren't
    assert sorted((r["source"], r["record_id"], r["site_id"]) for r in records.collect()) == [
        ("charging_stations", "3", "0/3"), ("charging_stations", "4", "0/3"), ("charging_stations", "5", "0/5"), ("fuel_with_sockets", "f1", "0/3"), ("manual", "3", "2/3"), ("manual", "m/1", "0/3"),
    ]
    assert {r["source"]: tuple(r)[1:] for r in figures.collect()} == {"charging_stations": (5, 2, 2, 1, "ok"), "fuel_with_sockets": (1, 0, 0, 1, "ok"), "manual": (2, 0, 1, 1, "ok")}
    none, without = features.known_chargers(stations.limit(0), places, None, ("amenity=fuel",), 900.0, sockets_count=False)
    assert none.count() == 0
    assert {r["source"]: tuple(r)[1:] for r in without.collect()} == {"charging_stations": (0, 0, 0, 0, "ok"), "fuel_with_sockets": (1, 1, 0, 0, "ok"), "manual": (0, 0, 0, 0, "missing")}


def test_dense_chargers_chain_without_their_pairs(spark, monkeypatch):
    """Chains of a dense town, of a thin line and of gaps about the radius, against all pairs; the town's pairs aren't formed."""
    import random

    from locarium.operators import features, spatial

    rng = random.Random(7)
    xy = [(rng.randrange(300), rng.randrange(300)) for _ in range(900)] + [(400 + 100 * i, 0) for i in range(5)] + [(3000 + 101 * i, 0) for i in range(4)] + [(6000 + rng.randrange(900), rng.randrange(900)) for _ in range(60)]
    rows = [(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(rng.sample(xy, len(xy)))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            if (a[2] - rows[j][2]) ** 2 + (a[3] - rows[j][3]) ** 2 <= 100**2:
                u, v = sorted((find(i), find(j)))
                root[v] = u
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(find(r[0]), r[0])
    seen, join = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda a, b, radius: seen.append(a.count()) or join(a, b, radius))
    df = spark.createDataFrame([*rows, (5000, 0, None, None)], "charger_id long, source_rank int, x double, y double")
    got = {r["charger_id"]: r["site_id"] for r in features.merge_chargers(df, 100).collect()}
    assert got.pop(5000) == 5000
    assert got == {r[0]: first[find(r[0])] for r in rows}
    assert all(n < 200 for n in seen)


def test_resampling_of_the_best_alone_loses_nothing(spark):
    n, runs, ks = 90, 20, (5, 10)
    rows = [(i, i % 7 == 0, float(i * 37 % 90), float(-i)) for i in range(n)]
    df = spark.createDataFrame(rows, "candidate_id long, hit boolean, a double, b double")
    md5 = lambda *v: hashlib.md5(":".join(map(str, v)).encode()).hexdigest()
    share = lambda hits, k: sum(hits[:k]) / k
    found = {m: {k: [] for k in ks} for m in ("random", "a", "b")}
    for run in range(runs):
        order = [h for _, h in sorted((md5(7, run, i), h) for i, h, _, _ in rows)]
        drawn = [(p, rows[int(md5(7, run, p)[:8], 16) % n]) for p in range(1, n + 1)]
        best = {m: [r[1] for _, r in sorted(drawn, key=lambda d, c=c: (-d[1][c], d[1][0], d[0]))] for m, c in (("a", 2), ("b", 3))}
        for m, hits in {"random": order, **best}.items():
            for k in ks:
                found[m][k].append(share(hits, k))
    low = lambda v: round(float(np.quantile(v, 0.025)), 9)
    for near in (None, 1, 12):  # too few in every run, in some, in none
        base = {r["k"]: r["low"] for r in evaluation.random_baseline(df, ks, 7, runs, near).collect()}
        assert base == {k: low(v) for k, v in found["random"].items()}
        got = {(r["method"], r["k"]): r["low"] for r in evaluation.bootstrap(df, ("a", "b"), ks, 7, runs, near).collect()}
        assert all(got[m, k] == low(found[m][k]) for m in "ab" for k in ks)
