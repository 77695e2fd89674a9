import numpy as np
from pyspark.sql import functions as F

from locarium.functions import geo
from locarium.operators import arrangement, features, spatial


def points(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, x double, y double")


def test_radius_is_inclusive_or_strict(spark):
    a, b = points(spark, [(1, 0.0, 0.0)]), points(spark, [(7, 300.0, 0.0), (8, 300.1, 0.0), (9, -200.0, 200.0)], "other")
    assert sorted(r["other"] for r in spatial.pairs_within(a, b, 300).collect()) == [7, 9]
    assert [r["other"] for r in spatial.pairs_within(a, b, 300, inclusive=False).collect()] == [9]


def test_count_keeps_zero_rows_and_sums_grow(spark):
    a = points(spark, [(1, 0.0, 0.0), (2, 9e5, 9e5)])
    src = points(spark, [(1, 500.0, 0.0), (2, 3000.0, 0.0), (3, 7000.0, 0.0)], "s").withColumn("people", F.col("s") * 10)
    got = {r["id"]: (r["n"], r["m"]) for r in spatial.count_within(a, src, "id", {"n": 1000, "m": 5000}).collect()}
    assert got == {1: (1, 2), 2: (0, 0)}
    got = {r["id"]: (r["p"], r["q"]) for r in spatial.sum_within(a, src, "id", "people", {"p": 1000, "q": 7000}).collect()}
    assert got == {1: (10, 60), 2: (0, 0)}


def test_nearest_breaks_ties_by_id_and_gives_null_without_sources(spark):
    a, b = points(spark, [(1, 0.0, 0.0), (2, 50000.0, 0.0)]), points(spark, [(5, 100.0, 0.0), (4, -100.0, 0.0)], "s")
    got = {r["id"]: (r["s"], r["dist"]) for r in spatial.nearest(a, b, "id", "s", 64).collect()}
    assert got == {1: (4, 100.0), 2: (5, 49900.0)}
    assert [r["s"] for r in spatial.nearest(a, b.limit(0), "id", "s", 64).collect()] == [None, None]
    assert {r["id"]: r["s"] for r in spatial.nearest(a, b, "id", "s", 64, most=100).collect()} == {1: 4, 2: None}


def test_nearest_segment_and_polygons(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0, "a"), (2, 0.0, 500.0, 0.0, 500.0, "b")], "s long, x1 double, y1 double, x2 double, y2 double, kind string")
    a = points(spark, [(1, 400.0, 30.0), (2, 10.0, 490.0), (3, 1000.0, 0.0)])
    got = {r["id"]: (r["kind"], round(r["dist"], 3)) for r in spatial.nearest_segment(a, seg, "id", "s", 10, keep=("kind",)).collect()}
    assert got == {1: ("a", 30.0), 2: ("b", 14.142), 3: ("a", 0.0)}
    ring = "array(named_struct('x',0.0D,'y',0.0D),named_struct('x',10.0D,'y',0.0D),named_struct('x',10.0D,'y',10.0D),named_struct('x',0.0D,'y',10.0D),named_struct('x',0.0D,'y',0.0D))"
    poly = spark.range(2).selectExpr("id as p", f"{ring} as ring")
    b = points(spark, [(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 11.0, 5.0)])
    assert {r["id"]: r["p"] for r in spatial.polygon_of_point(b, poly, "id", "p", 10).collect()} == {1: 0, 2: 0, 3: None}
    assert poly.select(geo.ring_area(F.col("ring"))).first()[0] == 100


def test_projection_control_point(spark):
    x, y = geo.project(F.lit(30.06), F.lit(-1.95))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    # the central meridian and the equator are exact; a point off both stays within the zone
    zero = spark.range(1).select(*geo.project(F.lit(27.0), F.lit(0.0))).first()
    assert zero[0] == 500_000 and abs(zero[1] - 10_000_000) < 1e-6
    lon, lat = geo.unproject(F.lit(row["x"]), F.lit(row["y"]))
    back = spark.range(1).select(lon, lat).first()
    assert abs(back[0] - 30.06) < 1e-9 and abs(back[1] + 1.95) < 1e-9


def test_disc_sums_form_no_pairs_and_hold_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    grid = lambda n: [(i, float(x), float(y), int(v)) for i, (x, y, v) in enumerate(rng.integers([0, 0, -50], [400, 400, 50], (n, 3)))]
    p, s = grid(150), [*grid(900), (900, 10.0, 10.0, 2**62), (901, 10.0, 10.0, -(2**62)), (902, 500.0, 500.0, 7), (903, None, 1.0, 7), (904, float("nan"), 1.0, 7), (905, 20.0, 20.0, None)]
    p += [(200, 500.0, 400.0, 0), (201, 430.0, 440.0, 0), (202, None, 1.0, 0), (203, -5000.0, 1.0, 0)]
    points, src = spark.createDataFrame(p, "id long, x double, y double, v long"), spark.createDataFrame(s, "s long, x double, y double, v long")
    monkeypatch.setattr(spatial, "pairs_within", None)
    monkeypatch.setattr(spatial, "GROUP", 40)
    near = lambda a, r: [b for b in s if b[1] is not None and a[1] is not None and np.hypot(a[1] - b[1], a[2] - b[2]) <= r]
    got = {r["id"]: (r["a"], r["b"]) for r in spatial.sum_within(points, src, "id", "v", {"a": 30, "b": 100}).collect()}
    assert got == {a[0]: tuple(sum(b[3] or 0 for b in near(a, r)) for r in (30, 100)) for a in p}
    got = {r["id"]: (r["a"], r["b"]) for r in spatial.count_within(points, src, "id", {"a": 100, "b": 5}).collect()}
    assert got == {a[0]: tuple(len(near(a, r)) for r in (100, 5)) for a in p}
    got = {r["id"]: r["a"] for r in spatial.count_within(points, src, "id", {"a": 100}, inclusive=False).collect()}
    assert got[200] == sum(np.hypot(500 - b[1], 400 - b[2]) < 100 for b in s if b[1] is not None) < len(near(p[150], 100))


def test_nearest_starts_small_among_dense_sources(spark, monkeypatch):
    rng = np.random.default_rng(5)
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 100, (1500, 2)))] + [(9000, 4000.0, 0.0)]
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 300, (60, 2)))] + [(100, 9000.0, 0.0), (101, None, 0.0)]
    radii, join = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda left, right, radius: radii.append(radius) or join(left, right, radius))
    got = {r["id"]: (r["dist"], r["s"]) for r in spatial.nearest(points(spark, a), points(spark, b, "s"), "id", "s", 2000).collect()}
    assert got.pop(101) == (None, None)
    assert got == {p[0]: min((float(np.sqrt((p[1] - s[1]) ** 2 + (p[2] - s[2]) ** 2)), s[0]) for s in b) for p in a if p[1] is not None}
    assert radii[0] < 20


def test_poi_counts_form_no_pairs_and_leave_out_the_own_host(spark, monkeypatch):
    monkeypatch.setattr(spatial, "pairs_within", None)
    pois = spark.createDataFrame([(1, "food", 0.0, 0.0), (1, "food", 0.0, 5.0), (2, None, 50.0, 0.0), (3, "food", 0.0, 80.0), (None, "food", 10.0, 0.0), (4, "fuel", 500.0, 0.0)], "poi_id long, kind string, x double, y double")
    cand = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 4, 0.0, 0.0), (4, 3, 900.0, 900.0)], "candidate_id long, host_poi_id long, x double, y double")
    got = {r[0]: tuple(r)[1:] for r in features.poi_counts(cand, pois, (20, 100), ("food",)).collect()}
    assert got == {1: (1, 3, 1, 2), 2: (2, 4, 2, 3), 3: (3, 5, 3, 4), 4: (0, 0, 0, 0)}


def _broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_joined_without_a_broadcast(spark):
    """A side that is repeated over cells isn't sent to the driver where Spark takes it to be small; a really small one may be."""
    far = lambda n: spark.range(20_000).select(F.col("id").alias(n), (F.col("id") * 3.0).alias("x"), F.lit(1.0).alias("y"))
    pairs = spatial.pairs_within(far("a"), far("b"), 5)
    assert not _broadcasts(pairs) and pairs.count() == 20_000 + 2 * 19_999
    few = spatial.pairs_within(far("a"), far("b").where("b < 9").limit(9), 5)
    assert few.count() == 9 + 2 * 8 + 1


def test_contacts_are_joined_without_a_broadcast(spark):
    lines = lambda n, *c: spark.range(5_000).select(F.col("id").alias(n), *[(F.col("id") * 7.0 + i).alias(name) for i, name in enumerate(c)])
    met = arrangement.contacts(lines("seg", "x1", "y1", "x2", "y2"), lines("other", "u1", "v1", "u2", "v2"), 10)
    assert not _broadcasts(met) and met.count() >= 5_000
