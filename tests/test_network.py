import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locarium.operators import network, ordered
from locarium.operators.features import merge_chargers
from locarium.operators.graph import connected_components


def trap(spark):
    cover = spark.createDataFrame([(0, n) for n in (0, 1, 2)] + [(1, n) for n in (3, 4, 5)] + [(2, n) for n in (1, 2, 3, 4)], "candidate_id long, node_id long")
    weights = spark.createDataFrame([(n, 1 / 6, 1) for n in range(6)], "node_id long, weight double, people long")
    sites = spark.createDataFrame([(i, 0.0, i, i) for i in range(3)], "candidate_id long, score double, district_id int, province_id int")
    none = spark.createDataFrame([], "a long, b long")
    return cover, weights, none, sites


def test_exact_beats_greedy_on_the_trap(spark):
    cover, weights, none, sites = trap(spark)
    got, value, status = network.solve_exact(cover, weights, none, sites, 2)
    assert (got, round(value, 9), status) == ([0, 1], 1.0, "Optimal")
    rows = network.greedy(cover, weights, none, sites, 2).orderBy("nth").collect()
    assert rows[0]["candidate_id"] == 2 and abs(sum(r["gain"] for r in rows) - 5 / 6) < 1e-9


def test_marginal_coverage(spark):
    cover, weights, _, sites = trap(spark)
    got = {r["candidate_id"]: round(r["marginal"], 6) for r in network.marginal_coverage(cover, weights, sites.where("candidate_id < 2")).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.0}


def test_exact_search_against_all_choices():
    rng = random.Random(5)
    for _ in range(20):
        n_sites, n_nodes, n = 9, 14, 3
        sets = [([s for s in range(n_sites) if rng.random() < 0.3] or [0], rng.random()) for _ in range(n_nodes)]
        scores = {s: rng.random() for s in range(n_sites)}
        clashes = {(0, 1), (2, 5)}
        total = sum(scores.values())
        best = max(sum(w for ss, w in sets if set(ss) & set(c)) + 0.01 * sum(scores[s] / total for s in c) for c in itertools.combinations(range(n_sites), n) if not any(a in c and b in c for a, b in clashes))
        assert abs(network.exact(sets, scores, clashes, n, 0.01)[1] - best) < 1e-9


def test_components_of_chains_and_chargers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43
    ch = spark.createDataFrame([(1, 200.0, 1), (2, 220.0, 0), (3, 260.0, 2), (4, 900.0, 0)], "charger_id long, x double, source_rank int").withColumn("y", F.lit(0.0))
    assert {r["charger_id"]: r["site_id"] for r in merge_chargers(ch, 50).collect()} == {1: 2, 2: 2, 3: 2, 4: 4}


def test_ordered_selections_against_sequential_passes(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 1000, 120).astype(float), rng.integers(0, 1000, 120).astype(float)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i]), i + 1) for i in range(120)], "id long, x double, y double, rank long")
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    kept, into = [], {}
    for i in range(120):
        near = [k for k in kept if d[i, k] <= 90]
        if near:
            into[i] = near[0]
        else:
            kept.append(i)
    got = {r["id"]: r for r in ordered.priority_dedup(df, "id", F.col("id"), 90).collect()}
    assert [i for i in range(120) if got[i]["kept"]] == kept and {i: got[i]["merged_into"] for i in into} == into
    assert all(got[k]["merged_count"] == sum(v == k for v in into.values()) for k in kept)
    taken = []
    for i in range(120):
        if all(d[i, k] >= 150 for k in taken):
            taken.append(i)
    assert [r["id"] for r in ordered.spaced_top(df, "id", 150, 8).orderBy("nth").collect()] == taken[:8]


def test_spacing_takes_the_largest_radius_that_fits():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.random(12), rng.random(12)
        d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
        for quota in (0, 1, 4, 11, 12):
            got, radius = ordered.spacing_select(x, y, quota)
            assert len(got) == quota and (quota == 0) == (radius is None)
            if 1 < quota < 12:
                assert all(d[a, b] > radius for a, b in itertools.combinations(got, 2))
                wider = [r for r in np.unique(d) if r > radius]
                assert all(len(ordered.greedy_spacing(d, float(r), quota)) < quota for r in wider)


def test_radius_study(spark):
    """Against plain greedy passes over all sites, at each radius and with weights that follow it."""
    rng = np.random.default_rng(7)
    s = [(i, float(rng.integers(0, 60)), float(rng.integers(0, 60)), i % 3, i % 5, float(rng.random()), i + 1) for i in range(25)]
    nodes = [(i, int(rng.integers(1, 90)), float(rng.integers(0, 60)), float(rng.integers(0, 60))) for i in range(40)]
    ch = [(i, float(rng.integers(0, 60)), float(rng.integers(0, 60))) for i in range(3)]
    sites = spark.createDataFrame(s, "candidate_id long, x double, y double, province_id long, district_id long, score double, rank long")
    rows, checks = network.radius_study(sites, spark.createDataFrame(nodes, "node_id long, people long, x double, y double"), spark.createDataFrame(ch, "charger_id long, x double, y double"), [10.0, 15.0], 15.0, 3, [20.0], 12.0, 0.5, 0.01)
    at = lambda t: np.array([r[-2:] for r in t])
    p, q, c = np.array([r[1:3] for r in s]), at(nodes), at(ch)
    d = lambda a, b: np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    people = np.array([n[1] for n in nodes])
    bonus = 0.01 * np.array([r[5] for r in s]) / sum(r[5] for r in s)

    def weights(radius):
        raw = people * np.where((d(q, c) <= radius).any(1), 0.5, 1.0)
        return raw / raw.sum()

    def solve(radius, w):
        cover, seen, out = d(p, q) <= radius, np.zeros(40, bool), []
        for _ in range(3):
            gain = [-1 if any(d(p[[i]], p[[k]])[0, 0] < 12 for k in out) or i in out else round(float(w[cover[i] & ~seen].sum() + bonus[i]), 12) for i in range(25)]
            out.append(int(np.argmax(gain)))
            seen |= cover[out[-1]]
        return out

    share = lambda chosen, radius: people[(d(p, q)[chosen] <= radius).any(0)].sum() / people.sum()
    got = {(r["method"], r["radius"]): r["people_share"] for r in rows.collect()}
    spaced = []
    for i in range(25):
        if len(spaced) < 3 and all(d(p[[i]], p[[k]])[0, 0] >= 20 for k in spaced):
            spaced.append(i)
    for radius in (10.0, 15.0):
        for method, chosen in (("greedy", solve(radius, weights(15))), ("top", [0, 1, 2]), ("spaced 20", spaced)):
            assert got.pop((method, radius)) == pytest.approx(share(chosen, radius), abs=1e-8)
    assert not got
    here, moved = solve(10, weights(15)), solve(10, weights(10))
    (check,) = checks.collect()
    assert tuple(check) == (10.0, len(set(here) & set(moved)), pytest.approx(share(here, 10), abs=1e-8), pytest.approx(share(moved, 10), abs=1e-8))


@pytest.mark.parametrize("exactly", [False, True])
def test_sensitivity_solves_each_variant(spark, exactly):
    """Against plain passes (greedy) or all choices (exact) of small instances; demand and coverage follow the radius."""
    rng = np.random.default_rng(11)
    s = [(i, float(rng.integers(0, 60)), float(rng.integers(0, 60)), i % 3, i % 5, float(rng.random())) for i in range(14)]
    nodes = [(i, int(rng.integers(1, 90)), float(rng.integers(0, 60)), float(rng.integers(0, 60))) for i in range(30)]
    ch = [(i, float(rng.integers(0, 60)), float(rng.integers(0, 60))) for i in range(3)]
    sites = spark.createDataFrame(s, "candidate_id long, x double, y double, province_id long, district_id long, score double")
    base, varied = {"score_weight": 0.01, "radius": 15.0, "factor": 0.5}, {"score_weight": [0.0, 0.01, 3.0], "radius": [10.0, 15.0], "factor": [0.1]}
    solve, summary = network.solved_anew(sites, spark.createDataFrame(nodes, "node_id long, people long, x double, y double"), spark.createDataFrame(ch, "charger_id long, x double, y double"), 15.0, 3, 12.0, exactly)
    got = {(r["parameter"], r["value"]): r for r in network.sensitivity(base, varied, solve, summary).collect()}
    with pytest.raises(ValueError, match="above"):
        solve(0.01, 16.0, 0.5)
    at = lambda t: np.array([r[-2:] for r in t])
    p, q, c = np.array([r[1:3] for r in s]), at(nodes), at(ch)
    d = lambda a, b: np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    people, clash = np.array([n[1] for n in nodes]), d(p, p) < 12
    score = np.array([r[5] for r in s])

    def best(score_weight, radius, factor):
        raw = people * np.where((d(q, c) <= radius).any(1), factor, 1.0)
        w, cover, bonus = raw / raw.sum(), d(p, q) <= radius, score_weight * score / score.sum()
        value = lambda t: float(w[cover[list(t)].any(0)].sum() + bonus[list(t)].sum())
        if exactly:
            chosen = max((t for t in itertools.combinations(range(14), 3) if not any(clash[a, b] for a, b in itertools.combinations(t, 2))), key=value)
        else:
            chosen = []
            for _ in range(3):
                free = [i for i in range(14) if i not in chosen and not clash[i, chosen].any()]
                chosen.append(max(free, key=lambda i: (round(value([*chosen, i]), 12), -i)))
        seen = cover[list(chosen)].any(0)
        return set(chosen), w[seen].sum(), people[seen].sum() / people.sum()

    first = best(**base)[0]
    want = [(k, v) for k, values in varied.items() for v in values if v != base[k]]
    assert set(got) == set(want)
    for k, v in want:
        chosen, demand, share = best(**(base | {k: v}))
        r = got[k, v]
        assert (r["demand"], r["people_share"]) == (pytest.approx(demand, abs=1e-8), pytest.approx(share, abs=1e-8))
        assert r["overlap"] == len(chosen & first) and r["provinces"] == len({i % 3 for i in chosen})


def test_priority_dedup_makes_no_table_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ordered, "pairs_within", None)
    rng = np.random.default_rng(8)
    p = [(i, float(x), float(y), int(o)) for i, ((x, y), o) in enumerate(zip(rng.integers(-40, 40, (300, 2)), rng.permutation(300), strict=True))]
    p += [(300, None, 1.0, 400), (301, float("nan"), 1.0, 401), (302, 300.0, 300.0, 402), (303, 310.0, 300.0, 403), (304, 320.0, 300.0, 404), (305, 320.0, 300.0, 405)]
    df = spark.createDataFrame(p, "id long, x double, y double, o long")
    for radius in (10, 0):
        kept, into = [], {}
        for i, x, y, _ in sorted(p, key=lambda r: r[3]):
            near = [k for k in kept if x is not None and p[k][1] is not None and np.hypot(x - p[k][1], y - p[k][2]) <= radius]
            if near:
                into[i] = near[0]
            else:
                kept.append(i)
        got = {r["id"]: r for r in ordered.priority_dedup(df, "id", F.col("o"), radius).collect()}
        assert len(got) == len(p) and {i for i in got if got[i]["kept"]} == set(kept) and {i: r["merged_into"] for i, r in got.items() if not r["kept"]} == into
        assert {i: got[i]["merged_count"] for i in got} == {i: sum(v == i for v in into.values()) if i in kept else None for i in got}


def test_greedy_by_spacing_forms_no_pairs_of_sites(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = [(i, float(rng.integers(0, 50)), float(rng.integers(0, 50)), float(rng.random())) for i in range(40)] + [(40, None, None, 0.9), (41, 3.0, None, 0.8)]
    sites = spark.createDataFrame(p, "candidate_id long, x double, y double, score double")
    nodes = spark.createDataFrame([(i, 1 / 30, float(rng.integers(0, 50)), float(rng.integers(0, 50))) for i in range(30)], "node_id long, weight double, x double, y double")
    cover = network.coverage(sites, nodes, 9)
    want = network.greedy(cover, nodes, network.conflicts(sites, 12), sites, 5, 0.3).orderBy("nth").collect()
    monkeypatch.setattr(network, "conflicts", None)
    assert network.greedy(cover, nodes, 12, sites, 5, 0.3).orderBy("nth").collect() == want
    about = sites.where("candidate_id < 40").withColumns({"province_id": F.lit(1), "district_id": F.lit(1), "rank": F.col("candidate_id")})
    people = nodes.withColumn("people", F.lit(3))
    chargers = spark.createDataFrame([(1, 5.0, 5.0)], "charger_id long, x double, y double")
    rows, checks = network.radius_study(about, people, chargers, [6.0, 9.0], 9.0, 2, [10.0], 12.0, 0.5)
    assert rows.count() == 6 and checks.count() == 1
    solve, _ = network.solved_anew(about, people, chargers, 9.0, 2, 12.0)
    assert solve(0.1, 9.0, 0.5).count() == 2


def test_exact_search_gets_the_pairs_of_its_sites_alone(spark, monkeypatch):
    cover, weights, _, sites = trap(spark)
    clashes = spark.createDataFrame([(0, 1), (0, 7), (6, 1), (8, 9)], "a long, b long")
    seen, search = [], network.exact
    monkeypatch.setattr(network, "exact", lambda sets, scores, pairs, *more: seen.append(pairs) or search(sets, scores, pairs, *more))
    assert network.solve_exact(cover, weights, clashes, sites, 2)[0] == [0, 2] and seen == [{(0, 1)}]


@pytest.mark.parametrize("block", [1, 7, 500])
def test_spaced_points_pair_with_those_taken_alone(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    p = [(int(i), float(x), float(y), r) for r, (i, (x, y)) in enumerate(zip(rng.permutation(200), rng.integers(0, 60, (200, 2)), strict=True))]
    p += [(900, None, 1.0, -1), (901, float("nan"), 1.0, 50)]
    taken = []
    for r in sorted(p, key=lambda r: (r[3], r[0])):
        if all(r[1] is None or q[1] is None or not np.hypot(r[1] - q[1], r[2] - q[2]) < 15 for q in taken):
            taken.append(r)
    monkeypatch.setattr(ordered, "BLOCK", block)
    sizes, join = [], ordered.pairs_within
    monkeypatch.setattr(ordered, "pairs_within", lambda a, b, *more, **named: sizes.append(b.count()) or join(a, b, *more, **named))
    df = spark.createDataFrame(p, "id long, x double, y double, rank long")
    for n in (4, 300):
        assert [(r["id"], r["nth"]) for r in ordered.spaced_top(df, "id", 15, n).orderBy("nth").collect()] == [(r[0], i) for i, r in enumerate(taken[:n], 1)]
    assert all(s <= len(taken) for s in sizes)


def test_nearest_sites_without_all_pairs(spark, monkeypatch):
    """A dense town, ten sites at one place, lone ones and one without a place, against all pairs; few pairs are formed."""
    rng = np.random.default_rng(9)
    xy = [(float(x), float(y)) for x, y in rng.integers(0, 100, (400, 2))] + [(40.0, 40.0)] * 10 + [(200.0 + 60 * i, 0.0) for i in range(4)] + [(900.0, 900.0), (350.0, 50.0), (400.0, 50.0)]
    ids = [int(i) for i in rng.permutation(len(xy))]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in zip(ids, xy, strict=True)] + [(9999, None, None)], "candidate_id long, x double, y double")
    pairs, join = [], network.pairs_within
    monkeypatch.setattr(network, "pairs_within", lambda a, b, *more: pairs.append(join(a, b, *more).count()) or join(a, b, *more))
    got = {}
    for r in network.nearby(df, 100, 3).collect():
        got.setdefault(r["candidate_id"], {})[r["nth"]] = (r["other_id"], r["dist"], r["total"])
    every = 0
    for i, (x, y) in zip(ids, xy, strict=True):
        near = sorted((float(np.sqrt((x - u) ** 2 + (y - v) ** 2)), j) for j, (u, v) in zip(ids, xy, strict=True) if j != i and np.sqrt((x - u) ** 2 + (y - v) ** 2) <= 100)
        every += len(near)
        want = {n: (j, round(d, 6), len(near)) for n, (d, j) in enumerate(near[:3], 1)}
        assert got.pop(i, {}) == want
    assert not got and sum(pairs) < every / 4


def test_spacing_makes_no_table_of_distances():
    import tracemalloc

    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5000, (2, 3000)).astype(float)
    tracemalloc.start()
    got, radius = ordered.spacing_select(x, y, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 6 and peak < 30e6  # 72 MB for all distances
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    all_ = np.unique(d)
    assert radius in all_ and ordered.greedy_spacing(d, radius, 6) == got
    assert all(len(ordered.greedy_spacing(d, r, 6)) < 6 for r in all_[all_ > radius][:200])


def test_spacing_against_every_radius():
    rng = np.random.default_rng(12)
    for n, high in [(int(rng.integers(2, 40)), int(rng.choice([3, 10, 1000]))) for _ in range(150)]:
        x, y = rng.integers(0, high, (2, n)).astype(float)
        quota = int(rng.integers(1, n))
        d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
        want = next(((g, float(r)) for r in [*np.unique(d[np.triu_indices(n, 1)])[::-1], 0.0] if len(g := ordered.greedy_spacing(d, r, quota)) == quota), (list(range(quota)), 0.0))
        assert ordered.spacing_select(x, y, quota) == want
