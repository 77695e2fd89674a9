import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from locarium.operators import areas, arrangement, hosts

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def turned(points, angle=0.3, at=(7.0, -3.0)):
    c, s = np.cos(angle), np.sin(angle)
    return [(float(c * x - s * y + at[0]), float(s * x + c * y + at[1])) for x, y in points]


def as_array(r):
    return np.array([(p["x"], p["y"]) for p in r])


def el(x, y, w, h, a, b):
    """An L: a box with its upper right corner taken out."""
    return [(x, y), (x + w, y), (x + w, y + b), (x + a, y + b), (x + a, y + h), (x, y + h)]


def cells(points, n):
    """The unit cells inside a rectilinear ring on integers."""
    p = np.array([*points, points[0]], float)
    m = np.arange(n) + 0.5
    x, y = np.meshgrid(m, m, indexing="ij")
    inside = np.zeros((n, n), bool)
    for (a, b), (c, d) in itertools.pairwise(p):
        if (b > d) or (b < d):
            inside ^= ((b > y) != (d > y)) & (x < a)
    return inside


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(4)
    out = {}
    for i in range(26):
        x, y, w, h = rng.integers(0, 14), rng.integers(0, 14), rng.integers(2, 7), rng.integers(2, 7)
        out[i] = el(x, y, w, h, rng.integers(1, w), rng.integers(1, h))
    out[26] = out[3]
    return out


@pytest.mark.parametrize("angle", [0.0, 0.3])
def test_overlap_and_union_of_any_outlines(spark, shapes, angle):
    rows = [(i, i % 3, ring(*turned(p, angle, (0, 0))), False) for i, p in shapes.items()]
    hole = turned([(2, 2), (4, 2), (4, 4), (2, 4)], angle, (0, 0))
    rows += [(50, 3, ring(*turned([(0, 0), (6, 0), (6, 6), (0, 6)], angle, (0, 0))), False), (50, 3, ring(*hole), True)]
    df = spark.createDataFrame(rows, f"id int, k int, ring {RING}, hole boolean")
    inside = {i: cells(p, 22) for i, p in shapes.items()}
    inside[50] = cells([(0, 0), (6, 0), (6, 6), (0, 6)], 22) & ~cells([(2, 2), (4, 2), (4, 4), (2, 4)], 22)
    got = {(r["id"], r["id2"]): r["shared"] for r in arrangement.overlap_areas(df, "id", df.withColumnRenamed("id", "id2"), "id2", 3.0, 1e-7).collect()}
    for i, j in itertools.product(inside, inside):
        assert abs(got.get((i, j), 0) - (inside[i] & inside[j]).sum()) < 1e-4, (i, j)
    parts = {r["k"]: r for r in areas.dissolve(df, "id", "k", cell=3.0).collect()}
    lined = {r["k"]: r["polygons"] for r in arrangement.dissolved(df, "id", "k", cell=3.0).collect()}
    for k in range(4):
        whole = np.logical_or.reduce([inside[i] for i in inside if (i == 50) == (k == 3) and (k == 3 or i % 3 == k)])
        padded = np.pad(whole, 1)
        assert abs(parts[k]["area"] - whole.sum()) < 1e-4
        assert abs(parts[k]["boundary"] - sum(np.abs(np.diff(padded.astype(int), axis=a)).sum() for a in (0, 1))) < 1e-4
        rings = [as_array(r) for p in lined[k] for r in p]
        assert abs(sum(arrangement.signed_area(r) for r in rings) - whole.sum()) < 1e-4
        assert all(arrangement.signed_area(as_array(p[0])) > 0 and all(arrangement.signed_area(as_array(r)) < 0 for r in p[1:]) for p in lined[k])
        assert all(len(set(map(tuple, r[:-1]))) == len(r) - 1 for r in rings)


def test_contacts_by_kind(spark):
    lines = [(0, 0, 0, 10, 0), (1, 5, -5, 5, 5), (2, 10, 0, 20, 5), (3, 3, 0, 3, 8), (4, 4, 0, 14, 0), (5, 0, 1, 10, 1.5), (6, 100, 100, 100, 100)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, *v in lines], "seg int, x1 double, y1 double, x2 double, y2 double")
    b = df.withColumnsRenamed({"seg": "other", "x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})
    got = {(r["seg"], r["other"]): r["kind"] for r in arrangement.contacts(df, b, 2.5, where=F.col("seg") < F.col("other")).collect()}
    assert got == {(0, 1): "cross", (0, 2): "meet", (0, 3): "touch", (0, 4): "overlap", (1, 4): "cross", (1, 5): "cross", (2, 4): "touch", (3, 5): "cross"}


@pytest.mark.parametrize("cell", [1.0, 40.0])
def test_noding_against_all_pairs(spark, cell):
    rng = np.random.default_rng(9)
    lines = [(i, *map(float, rng.integers(0, 30, 4))) for i in range(40)]
    df = spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    pieces = [(r["id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in arrangement.noded(df, cell).collect()]
    length = lambda v: np.hypot(v[2] - v[0], v[3] - v[1])
    for i, *v in lines:
        assert abs(sum(length(p[1:]) for p in pieces if p[0] == i) - length(v)) < 1e-4
    some = {tuple(sorted([p[1:3], p[3:5]])) for p in pieces}
    for (a, b), (c, d) in itertools.combinations(some, 2):
        r, s, o = np.subtract(b, a), np.subtract(d, c), np.subtract(c, a)
        det = r[0] * s[1] - r[1] * s[0]
        if abs(det) > 1e-9:
            t, u = (o[0] * s[1] - o[1] * s[0]) / det, (o[0] * r[1] - o[1] * r[0]) / det
            assert not (1e-5 < t < 1 - 1e-5 and 1e-5 < u < 1 - 1e-5)
        else:
            along = [float(np.dot(np.subtract(p, a), r) / np.dot(r, r)) for p in (c, d)]
            off = abs(o[0] * r[1] - o[1] * r[0]) / np.hypot(*r)
            assert off > 1e-6 or max(along) < 1e-5 or min(along) > 1 - 1e-5


def test_corridors_cross_touch_and_stop_at_the_border(spark):
    rows = [(0, 0, 40, 0, "trunk"), (20, -20, 20, 20, "trunk"), (10, 0, 10, 8, "primary"), (5, 0, 15, 0, "trunk"), (0, 90, 9, 90, "trunk"), (30, 3, 30, -3, "path"), (7, 7, 7, 7, "trunk")]
    roads = spark.createDataFrame([(*map(float, v), c) for *v, c in rows], "x1 double, y1 double, x2 double, y2 double, road_class string")
    got = {}
    for r in hosts.corridor_points(roads, ("trunk", "primary"), 4, 7).orderBy("from", "nth").collect():
        got.setdefault((tuple(r["from"]), tuple(r["to"])), []).append((r["x"], r["y"]))
    assert set(got) == {((0, 0), (10, 0)), ((10, 0), (20, 0)), ((20, 0), (40, 0)), ((20, -20), (20, 0)), ((20, 0), (20, 20)), ((10, 0), (10, 8)), ((0, 90), (9, 90))}
    assert got[(0, 0), (10, 0)] == [(2, 0), (6, 0), (10, 0)] and got[(10, 0), (10, 8)] == [(10, 2), (10, 6)]
    land = spark.createDataFrame([(1, ring((-1, -5), (30, -5), (30, 5), (25, 5), (25, 10), (-1, 10))), (2, ring((25, 5), (30, 5), (30, 10), (25, 10)))], f"country_id int, ring {RING}")
    ends = {(tuple(r["from"]), tuple(r["to"])) for r in hosts.corridor_points(roads, ("trunk", "primary"), 2, 7, land).collect()}
    assert ends == {((0, 0), (10, 0)), ((10, 0), (20, 0)), ((20, 0), (30, 0)), ((20, -5), (20, 0)), ((20, 0), (20, 10)), ((10, 0), (10, 8))}


def test_chains_end_at_junctions_and_close_on_themselves(spark):
    rows = [(0, 0, 10, 0), (20, 0, 10, 0), (20, 0, 20, 30), (20, 0, 30, 0), (100, 0, 110, 0), (110, 0, 110, 10), (110, 10, 100, 0), (0, 50, 3, 50)]
    roads = spark.createDataFrame([(*map(float, xy), "trunk") for xy in rows], "x1 double, y1 double, x2 double, y2 double, road_class string")
    got = {}
    for r in hosts.corridor_points(roads, ("trunk",), 8, 25).orderBy("from", "to", "nth").collect():
        got.setdefault((tuple(r["from"]), tuple(r["to"])), []).append((round(r["x"], 6), round(r["y"], 6)))
    assert got[(0, 0), (20, 0)] == [(4, 0), (12, 0), (20, 0)] and got[(20, 0), (20, 30)] == [(20, 4), (20, 12), (20, 20), (20, 28)] and got[(20, 0), (30, 0)] == [(24, 0)]
    loop = got[(100, 0), (100, 0)]
    assert len(loop) == int((20 + 200**0.5 - 4) // 8) + 1 and loop[0] == (104, 0) and len(got) == 4
    assert hosts.corridor_points(roads.limit(0), ("trunk",), 8, 25).count() == 0


BROKEN = {
    1: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((2, 2), (2, 4), (4, 4), (4, 2))]], set()),
    2: ([[ring((0, 0), (4, 4), (4, 0), (0, 4))]], {"crossing"}),
    3: ([[ring((0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4))]], {"overlap", "self touch"}),
    4: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((20, 2), (20, 4), (24, 4))]], {"hole outside"}),
    5: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (1, 8), (8, 8), (8, 1)), ring((2, 2), (2, 4), (4, 4))]], {"hole in hole"}),
    6: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((0, 3), (3, 3), (3, 6))]], set()),
    7: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((0, 3), (9, 4), (4, 6))]], {"touching twice"}),
    8: ([[ring((0, 0), (9, 0), (9, 9), (0, 9))], [ring((1, 1), (3, 1), (3, 3))]], {"part in part"}),
    9: ([[ring((0, 0), (9, 0), (9, 9), (0, 9))], [ring((9, 2), (12, 2), (12, 6), (9, 6))]], {"overlap"}),
    10: ([[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]], {"not closed"}),
    11: ([[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]]], {"too few points"}),
    12: ([[ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2))]], {"self touch"}),
    13: ([[ring((0, 0), (4, 0), (4, 0), (4, 4), (0, 4))]], set()),
    14: ([[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (1, 8), (8, 8), (8, 1))], [ring((2, 2), (7, 2), (7, 7), (2, 7))]], set()),
}


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(k, p, n, r) for k, (parts, _) in BROKEN.items() for p, rings in enumerate(parts) for n, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"id int, part int, nr int, ring {RING}").repartition(3)


@pytest.mark.parametrize("cell", [2.0, 50.0])
def test_ring_problems(broken, cell):
    got = {}
    for r in arrangement.ring_problems(broken, "id", cell).collect():
        got.setdefault(r["id"], set()).add(r["problem"])
    assert got == {k: v for k, (_, v) in BROKEN.items() if v}


def test_checks_list_the_smallest_keys(spark, broken):
    more = [(100 + i, 0, 0, ring((50, 50), (60, 50), (60, 60))) for i in range(9)] + [(200, 0, 0, None), (201, 0, 0, []), (202, 0, 0, ring((float("nan"), 1), (2, 2), (3, 1)))]
    df = broken.unionByName(spark.createDataFrame(more, broken.schema))
    got = {r["problem"]: (r["n"], r["examples"]) for r in arrangement.check_areas(df, "id", 5.0, (-1, -1, 30, 30), world=(-9, -9, 59, 59)).collect()}
    assert got["not within the box"] == (9, [100, 101, 102, 103, 104]) and got["outside the world"] == (9, [100, 101, 102, 103, 104])
    assert got["missing"] == (1, [200]) and got["empty"] == (1, [201]) and got["not finite"] == (1, [202]) and got["overlap"] == (2, [3, 9])
    assert "not intersects the box" not in {r["problem"] for r in arrangement.check_areas(df, "id", 5.0, (-1, -1, 55, 55), "intersects").collect()}
    with pytest.raises(ValueError, match="mode"):
        arrangement.check_areas(df, "id", 5.0, (0, 0, 1, 1), "near")


def test_repair_by_the_even_odd_rule(broken):
    rows = {r["id"]: r for r in arrangement.repaired(broken, "id", 5.0).collect()}
    assert set(rows) == set(BROKEN) and {k for k, r in rows.items() if r["repaired"]} == {k for k, (_, v) in BROKEN.items() if v}
    size = lambda k: round(sum(arrangement.signed_area(as_array(r)) for p in rows[k]["polygons"] for r in p), 6)
    assert size(2) == 8 and len(rows[2]["polygons"]) == 2 and size(3) == 16 and size(5) == 81 - 49 + 2 and rows[11]["polygons"] is None
    assert size(4) == 81 + 4 and size(7) == 81 - 0.5 * abs(np.linalg.det([[9, 1], [4, 3]])) and len(rows[7]["polygons"]) > 1 and size(10) == 1
    assert size(9) == 81 + 12 and len(rows[9]["polygons"]) == 1 and size(12) == 8 and rows[1]["polygons"] == [[[tuple(p.values()) for p in r] for r in part] for part in BROKEN[1][0]]


def test_circles_against_a_fine_grid(spark, shapes):
    df = spark.createDataFrame([(i, ring(*turned(p))) for i, p in shapes.items()], f"id int, ring {RING}")
    whole = np.logical_or.reduce([cells(p, 22) for p in shapes.values()])
    rng = np.random.default_rng(2)
    points = [(i, *turned([xy])[0]) for i, xy in enumerate([*rng.uniform(-2, 22, (12, 2)).tolist(), (5.0, 5.0), (90.0, 90.0), shapes[0][0], shapes[4][2]])]
    got = {r["k"]: r["held"] for r in arrangement.circle_area(spark.createDataFrame(points, "k int, x double, y double"), "k", df, "id", 2.5, 1e-7).collect()}
    g = (np.arange(-500, 500) + 0.5) / 200
    dx, dy = (v[np.hypot(*np.meshgrid(g, g)) <= 2.5] for v in np.meshgrid(g, g))
    c, s = np.cos(-0.3), np.sin(-0.3)
    for k, x, y in points:
        u, v = x + dx - 7, y + dy + 3
        u, v = np.floor(c * u - s * v).astype(int), np.floor(s * u + c * v).astype(int)
        ok = (u >= 0) & (v >= 0) & (u < 22) & (v < 22)
        held = whole[u.clip(0, 21), v.clip(0, 21)] & ok
        assert abs(got[k] - held.mean() * np.pi * 6.25) < 0.06, k


def test_features_meet_areas_by_ends_inside_or_outlines(spark):
    df = spark.createDataFrame([(1, ring((0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10))), (2, ring((10, 0), (20, 0), (20, 10), (10, 10)))], f"area int, ring {RING}")
    lines = [(1, 1, 1, 2, 2), (2, -5, 2, 25, 2), (3, 5, 6, 5, 9), (4, 3, 8, 7, 8), (5, 10, 3, 10, 3), (6, -1, -1, 11, -1), (7, -1, 10, 0, 10), (8, 15, 5, 15, 5)]
    segs = spark.createDataFrame([(i, *map(float, v)) for i, *v in lines], "f int, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in arrangement.areas_of_segments(segs, "f", df, "area", 3.0).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (4, 1), (5, 1), (5, 2), (7, 1), (8, 2)}


def test_outlines_stay_joined_and_never_cross(spark):
    # three areas around wavy borders, one of which would cut through a narrow island if simplified alone
    t = np.linspace(0, 100, 201)
    wave = np.stack((t, 50 + 6 * np.sin(t / 3)), axis=1)
    left, right = [(x, y) for x, y in wave if x <= 50], [(x, y) for x, y in wave if x >= 50]
    lower = [(0.0, 0.0), (100.0, 0.0), *[tuple(p) for p in wave[::-1]]]
    mid = wave[wave[:, 0] == 50][0]
    a = [*map(tuple, left), (50.0, 100.0), (0.0, 100.0)]
    b = [*map(tuple, right), (100.0, 100.0), (50.0, 100.0)]
    crest = wave[np.argmax(wave[:40, 1])]
    isle = [(crest[0] - 0.6, crest[1] + 0.5), (crest[0] + 0.6, crest[1] + 0.5), (crest[0], crest[1] + 1.5)]
    rows = [(1, ring(*lower), False), (2, ring(*a), False), (2, ring(*isle), True), (3, ring(*b), False), (4, ring(*isle), False)]
    df = spark.createDataFrame(rows, f"id int, ring {RING}, hole boolean")
    got = {r["id"]: r for r in areas.outlines(df, "id", 20.0, 10.0).collect()}
    edges = {}
    for k, r in got.items():
        for p in r["polygons"]:
            for q in p:
                xy = as_array(q)
                for s, e in zip(xy[:-1], xy[1:], strict=True):
                    edges.setdefault(tuple(sorted([tuple(s), tuple(e)])), set()).add(k)
    total = sum(arrangement.signed_area(as_array(q)) for r in got.values() for p in r["polygons"] for q in p)
    assert abs(total - 100 * 100) < 1e-3 and len(edges) < 200  # no gaps, no overlaps, and far fewer corners
    outer = {e for e, k in edges.items() if len(k) == 1}
    assert all(p[0] in (0, 100) or p[1] in (0, 100) for e in outer for p in e)
    assert any(np.hypot(*np.subtract(mid, p)) < 1e-5 for e in edges for p in e)
    for (p, q), (u, v) in itertools.combinations(edges, 2):
        r, s, o = np.subtract(q, p), np.subtract(v, u), np.subtract(u, p)
        det = r[0] * s[1] - r[1] * s[0]
        if abs(det) > 1e-9:
            x, y = (o[0] * s[1] - o[1] * s[0]) / det, (o[0] * r[1] - o[1] * r[0]) / det
            assert not (1e-6 < x < 1 - 1e-6 and 1e-6 < y < 1 - 1e-6)
    assert got[4]["label"] is not None and arrangement._holds(as_array(got[1]["polygons"][0][0]), np.array(tuple(got[1]["label"])))


def test_contacts_of_long_segments_and_of_far_boxes(spark):
    rng = np.random.default_rng(3)
    lines = [(i, *map(float, rng.integers(-20, 20, 4))) for i in range(30)] + [(30, -20.0, -20.0, 20.0, 20.0), (31, -10.0, -10.0, 15.0, 15.0)]
    df = spark.createDataFrame(lines, "seg int, x1 double, y1 double, x2 double, y2 double")
    b = df.withColumnsRenamed({"seg": "other", "x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})
    found = []
    for cell in (1.5, 100.0):
        rows = arrangement.contacts(df, b, cell, where=F.col("seg") < F.col("other")).collect()
        assert len(rows) == len({(r["seg"], r["other"]) for r in rows})  # once, in however many cells they meet
        found.append({(r["seg"], r["other"], r["kind"], tuple(map(tuple, r["points"]))) for r in rows})
    assert found[0] == found[1] and (30, 31, "overlap", ((-10.0, -10.0), (15.0, 15.0))) in found[0]


def test_points_inside_step_by_step(spark):
    shapes = {1: ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)), 2: ring((0, 0), (4, 0), (2, 9)), 3: ring((1, 1), (5, 1))}
    df = spark.createDataFrame(list(shapes.items()), f"id int, ring {RING}")
    rows = arrangement.with_point_inside(df, "ring", "p").withColumn("q", arrangement.point_inside(F.col("ring"))).collect()
    assert len(rows) == 3 and all(r["p"] == r["q"] for r in rows) and set(rows[0].asDict()) == {"id", "ring", "p", "q"}


def test_chains_go_on_from_batch_to_batch(spark):
    corners = [(float(10 * i), float(i % 3)) for i in range(12)]
    rows = [(*a, *b, "trunk") for a, b in itertools.pairwise(corners)] + [(0.0, 50.0, 90.0, 50.0, "trunk"), (0.0, 60.0, 1.0, 60.0, "trunk")]
    roads = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, road_class string")
    found, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for size in ("2", before):
        spark.conf.set(name, size)
        found.append(sorted(map(tuple, hosts.corridor_points(roads, ("trunk",), 8, 25).select("from.x", "from.y", "to.x", "nth", "x", "y").collect())))
    spark.conf.set(name, before)
    assert found[0] == found[1] and {r[:3] for r in found[0]} == {(0.0, 0.0, 110.0), (0.0, 50.0, 90.0)}


@pytest.mark.parametrize("most", [64, 5])
def test_overlap_of_pairs_cuts_nothing(spark, shapes, monkeypatch, most):
    monkeypatch.setattr(arrangement, "EDGES", most)
    monkeypatch.setattr(arrangement, "GROUP", 5)
    if most == 64:
        monkeypatch.setattr(arrangement, "noded", None)
    star = lambda x, y, n=9: [(x + r * float(np.cos(t)), y + r * float(np.sin(t))) for t, r in zip(np.arange(2 * n) * np.pi / n, [4.0, 1.5] * n, strict=True)]
    shapes = {i: p for i, p in shapes.items() if i < 8} | {30: [(0, 0), (9, 0), (9, 9), (0, 9)], 31: [(9, 0), (12, 0), (12, 9), (9, 9)]}
    some = {40: star(6, 6), 41: star(8.5, 7.25, 7), 42: [(1, 1), (14, 3), (5, 12)]}
    rows = [(i, ring(*p), False) for i, p in (shapes | some).items()] + [(30, ring((2, 2), (4, 2), (4, 4), (2, 4)), True)]
    df = spark.createDataFrame(rows, f"id int, ring {RING}, hole boolean")
    got = {(r["id"], r["id2"]): r["shared"] for r in arrangement.overlap_areas(df, "id", df.withColumnRenamed("id", "id2"), "id2", 3.0, 1e-7, less=True).collect()}
    assert all(i < j for i, j in got) and (30, 31) not in got
    inside = {i: cells(p, 22) for i, p in shapes.items()}
    inside[30] &= ~cells([(2, 2), (4, 2), (4, 4), (2, 4)], 22)
    for i, j in itertools.combinations(inside, 2):
        assert abs(got.get((i, j), 0) - (inside[i] & inside[j]).sum()) < 1e-4, (i, j)
    m = (np.arange(400) + 0.5) / 20
    x, y = np.meshgrid(m, m, indexing="ij")

    def fine_cells(points):
        out = np.zeros(x.shape, bool)
        for (a, b), (c, d) in itertools.pairwise([*points, points[0]]):
            if b != d:
                out ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
        return out

    fine = {i: fine_cells(p) for i, p in (shapes | some).items()}
    fine[30] &= ~fine_cells([(2, 2), (4, 2), (4, 4), (2, 4)])
    for i, j in itertools.product(fine, some):
        if i < j:
            assert abs(got.get((i, j), 0) - (fine[i] & fine[j]).sum() / 400) < 0.3, (i, j)


@pytest.mark.parametrize("angle", [0.0, 0.3])
def test_edges_inside_others_are_not_cut(spark, angle, monkeypatch):
    rng = np.random.default_rng(6)
    shapes = {}
    for i in range(150):
        x, y, w, h = rng.integers(0, 14), rng.integers(0, 14), rng.integers(3, 8), rng.integers(3, 8)
        shapes[i] = el(x, y, w, h, rng.integers(1, w), rng.integers(1, h))
    rows = [(i, i % 2, ring(*turned(p, angle, (0, 0)))) for i, p in shapes.items()]
    df = spark.createDataFrame(rows, f"id int, k int, ring {RING}")
    cut, noded = [], arrangement.noded
    monkeypatch.setattr(arrangement, "noded", lambda s, *a: cut.append(s.count()) or noded(s, *a))
    parts = {r["k"]: r for r in areas.dissolve(df, "id", "k", cell=4.0).collect()}
    assert cut[0] < 700  # of 900
    for k in range(2):
        whole = np.logical_or.reduce([cells(p, 24) for i, p in shapes.items() if i % 2 == k])
        assert abs(parts[k]["area"] - whole.sum()) < 1e-3 and parts[k]["n"] == 75
        assert abs(parts[k]["boundary"] - sum(np.abs(np.diff(np.pad(whole, 1).astype(int), axis=a)).sum() for a in (0, 1))) < 1e-3
