import pytest
from pyspark.sql import functions as F

from locarium import settings as S
from locarium.operators import evaluation, features, ordered, scoring, spatial


def test_mid_rank(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, None)], "id int, v double")
    got = {r["id"]: r["pct_v"] for r in scoring.mid_rank(df, ["v"]).collect()}
    assert got[4] is None and [round(100 - got[i], 9) for i in (1, 2, 3)] == [round(x, 9) for x in (500 / 6, 50, 100 / 6)]
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert [r["pct_v"] for r in scoring.mid_rank(same, ["v"]).collect()] == [50, 50]


def test_grid_evidence_unknown_distances(spark):
    df = spark.createDataFrame([(1, 5000.0, None), (2, 5001.0, None), (3, None, None)], "id int, dist_substation_m double, dist_line_m double")
    assert {r["id"]: r["m"] for r in df.select("id", scoring.grid_evidence_missing(5000).alias("m")).collect()} == {1: False, 2: True, 3: True}


def test_quotas(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, n long")
    assert {r["g"]: r["quota"] for r in ordered.allocate_quotas(df, "g", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        ordered.allocate_quotas(df, "g", 11)


def test_precision_divides_by_k(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, True)], "rank long, hit boolean")
    got = {r["k"]: (r["hits"], r["precision"], r["recall"]) for r in evaluation.at_k(df, (1, 10)).collect()}
    assert got == {1: (1, 1.0, 0.5), 10: (2, 0.2, 1.0)}
    none = df.withColumn("hit", F.lit(False))
    assert [r["recall"] for r in evaluation.at_k(none, (2,)).collect()] == [None]


def test_features_are_gathered_without_a_join_for_each(spark, monkeypatch):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    far = lambda d: table([(1, 7, d), (3, None, None)], "candidate_id long, id long, dist double")
    monkeypatch.setattr(spatial, "sum_within", lambda *a: table([(1, 5, 6, 7), (2, 0, 0, 0)], "candidate_id long, pop_1km long, pop_5km long, pop_10km long"))
    monkeypatch.setattr(features, "poi_counts", lambda *a: table([(1, 2, 3), (2, 4, 5)], "candidate_id long, poi_1km long, poi_3km long"))
    monkeypatch.setattr(spatial, "count_within", lambda *a: table([(2, 8, 9)], "candidate_id long, chargers_10km long, chargers_25km long"))
    monkeypatch.setattr(spatial, "nearest", lambda *a: far(1.5))
    monkeypatch.setattr(spatial, "nearest_segment", lambda *a, keep=(): table([(1, 7, 2.5, "trunk"), (2, 7, -0.5, None)], "candidate_id long, id long, dist double, road_class string"))
    monkeypatch.setattr(features, "completeness", lambda *a: table([(4, 9, 0.5)], "district_id long, features long, grid_completeness_ratio double"))
    layers = {"candidates": table([(1, 4, 0.0, 0.0), (2, 5, 1.0, 1.0)], "candidate_id long, district_id long, x double, y double")}
    layers |= {n: table([], "power string, place string, road_class string, access string") for n in ("pixels", "pois", "chargers", "power", "places", "roads", "districts")}
    out = features.build(layers, S.WORLD)
    got = {r["candidate_id"]: r.asDict() for r in out.collect()}
    names = ("district_id", "pop_5km", "poi_3km", "chargers_25km", "dist_charger_m", "dist_town_m", "dist_road_m", "road_class", "dist_trunk_m", "grid_completeness_ratio")
    assert [got[1][n] for n in names] == [4, 6, 3, None, 1.5, 1.5, 2.5, "trunk", 2.5, 0.5] and len(got) == 2
    assert [got[2][n] for n in names] == [5, 0, 5, 9, None, None, -0.5, None, -0.5, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


def test_stability_is_compiled(spark):
    names = [f"pct_{f}" for g in S.COMPONENTS.values() for f in g]
    rows = [(i, 5 * (i % 3), 0, 100.0 * i, 4000.0, 9000.0 * (i % 3), 500.0, *[float((i * (k + 3) * 37) % 101) for k in range(len(names))]) for i in range(40)]
    df = spark.createDataFrame(rows, "candidate_id long, host_bonus long, road_bonus long, dist_substation_m double, dist_line_m double, dist_centre_m double, dist_town_m double, " + ", ".join(f"{n} double" for n in names))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    got = {r["variant"]: r["overlap"] for r in evaluation.stability(df, S.WORLD, 10).collect()}
    spark.conf.unset("spark.sql.codegen.fallback")
    top = {}
    for variant, comps, profiles in [("base", S.COMPONENTS, S.PROFILES), *evaluation.variants()]:
        score = {}
        for r in (dict(zip(df.columns, row, strict=True)) for row in rows):
            bonus = {"host_commercial": r["host_bonus"], "access": r["road_bonus"]}
            part = {n: min(100.0, sum(w * r[f"pct_{f}"] for f, w in g.items()) + bonus.get(n, 0)) for n, g in comps.items()}
            if r["dist_substation_m"] > 1500 and r["dist_line_m"] > 1500:
                part["grid_evidence"] = 0.0
            weights = profiles["urban" if r["dist_centre_m"] <= 10000 or r["dist_town_m"] <= 3000 else "corridor"]
            score[r["candidate_id"]] = sum(w * part[c] for c, w in weights.items())
        top[variant] = set(sorted(score, key=lambda c: (-round(score[c], 9), c))[:10])
    assert got == {v: len(t & top["base"]) / 10 for v, t in top.items() if v != "base"}
