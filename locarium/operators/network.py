"""Coverage networks: demand, coverage relation, greedy and exact maximum coverage."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locarium.operators.ordered import spaced_top
from locarium.operators.scoring import mid_rank
from locarium.operators.spatial import _sparse, disc_sums, distance, pairs_within
from locarium.storage import stored


def demand_nodes(pixels: DataFrame, cell: float) -> DataFrame:
    """``node_id, people, x, y``: people of square cells with any, at the cell's centre."""
    cx, cy = (F.floor(F.col(c) / cell).cast("long") for c in "xy")
    grouped = pixels.where("people > 0").groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.sum("people").alias("people"))
    return grouped.select((F.col("cx") * 1_000_000 + F.col("cy")).alias("node_id"), "people", ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"))


def demand_weights(nodes: DataFrame, chargers: DataFrame, radius: float, factor: float) -> DataFrame:
    """Add ``weight``: people, times ``factor`` with a charger within ``radius``, as a share of all. One near charger or many count alike."""
    near = pairs_within(nodes.select("node_id", "x", "y"), chargers.select("x", "y"), radius).select("node_id").distinct().withColumn("near", F.lit(True))
    raw = nodes.join(near, "node_id", "left").withColumn("raw", F.col("people") * F.when(F.col("near"), F.lit(float(factor))).otherwise(F.lit(1.0)))
    raw = stored(raw.drop("near"))
    total = raw.agg(F.sum("raw")).first()[0]
    if not total:
        raise ValueError("no demand")
    return raw.withColumn("weight", F.col("raw") / F.lit(total)).drop("raw")


def coverage(sites: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """``candidate_id, node_id`` of every site and node at most ``radius`` apart."""
    return pairs_within(nodes.select("node_id", "x", "y"), sites.select("candidate_id", "x", "y"), radius).select("candidate_id", "node_id")


def eligible(scores: DataFrame, percentile: float, need: int) -> DataFrame:
    """Sites with a host whose score stands at ``percentile`` or above by mid-rank; fewer than ``need`` is an error."""
    out = stored(mid_rank(scores, ["score"]).where((F.col("pct_score") >= percentile) & (F.col("host_type") != "none")).drop("pct_score"))
    if out.count() < need:
        raise ValueError(f"fewer than {need} eligible sites")
    return out


def conflicts(sites: DataFrame, spacing: float) -> DataFrame:
    """``a, b``: pairs of sites, a < b, nearer than ``spacing``; exactly at it is no conflict."""
    a, b = (sites.select(F.col("candidate_id").alias(n), "x", "y") for n in "ab")
    return pairs_within(a, b, spacing, inclusive=False).where("a < b").select("a", "b")


def greedy(cover: DataFrame, weights: DataFrame, clashes: DataFrame | float, sites: DataFrame, n: int, score_weight: float = 0.0) -> DataFrame:
    """``candidate_id, nth, gain``: n rounds, each adds the free site that gains most, the smallest id of equals.

    Gain is the weight of nodes not yet covered and ``score_weight`` times the
    score's share. Sites in conflict with a chosen one are out: ``clashes`` has
    the pairs, or is the spacing of :func:`conflicts`, whose pairs grow with the
    square of the sites and then aren't formed. Running out of
    sites is an error. Each round is one aggregate over the coverage relation.
    """
    total = sites.agg(F.sum("score")).first()[0] or 1.0
    gains = stored(cover.join(weights.select("node_id", "weight"), "node_id").select("candidate_id", "node_id", "weight"))
    near = not isinstance(clashes, DataFrame)
    free = stored(sites.select("candidate_id", *(("x", "y") if near else ()), (F.lit(score_weight) * F.col("score") / F.lit(total)).alias("bonus")))
    spark = cover.sparkSession
    chosen: list[tuple[int, int, float]] = []
    both = None if near else stored(clashes.select("a", "b").unionByName(clashes.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    for nth in range(1, n + 1):
        best = free.join(gains.groupBy("candidate_id").agg(F.sum("weight").alias("w")), "candidate_id", "left")
        row = best.select(*free.columns, F.round(F.coalesce("w", F.lit(0.0)) + F.col("bonus"), 12).alias("gain")).orderBy(F.desc("gain"), "candidate_id").first()
        if row is None:
            raise ValueError(f"no site left for place {nth} of {n}")
        site = row["candidate_id"]
        chosen.append((site, nth, row["gain"]))
        if near:
            apart = distance(F.col("x"), F.col("y"), F.lit(row["x"]), F.lit(row["y"]))
            free = free.where((F.col("candidate_id") != site) & ~F.coalesce(apart < clashes, F.lit(False)))
        else:
            out = both.where(F.col("a") == site).select(F.col("b").alias("candidate_id")).unionByName(spark.createDataFrame([(site,)], "candidate_id long"))
            free = free.join(out, "candidate_id", "left_anti")
        gains = gains.join(gains.where(F.col("candidate_id") == site).select("node_id"), "node_id", "left_anti")
        if nth % 3 == 0 and nth < n:
            free, gains = stored(free), stored(gains)
    return spark.createDataFrame(chosen, "candidate_id long, nth int, gain double")


def collapse(cover: DataFrame, weights: DataFrame) -> DataFrame:
    """``sites, weight``: nodes that the same sites cover, as one; what an exact solver needs to see."""
    sets = cover.groupBy("node_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("sites"))
    return sets.join(weights.select("node_id", "weight"), "node_id").groupBy("sites").agg(F.sum("weight").alias("weight"))


#: Sites and distinct cover sets up to which the exact search is tried.
EXACT_SITES, EXACT_SETS = 2_000, 200_000


def exact(sets: list[tuple[list[int], float]], scores: dict[int, float], clashes: set[tuple[int, int]], n: int, score_weight: float = 0.0, seconds: float = 300.0) -> tuple[list[int], float, str]:
    """Best ``n`` sites by branch and bound; ``(sites, objective, status)``.

    The bound of a partial choice is its gain and the largest gains of single
    sites left, as covering weights never help each other. ``status`` is
    Optimal only if the whole tree was searched in time, else TimeLimit.
    Infeasible instances are an error. The instance is what Spark has
    collapsed; larger ones than EXACT_SITES and EXACT_SETS are refused.
    """
    ids = sorted(scores)
    if len(ids) > EXACT_SITES or len(sets) > EXACT_SETS:
        raise ValueError("too large for the exact search; use the greedy one")
    place = {s: i for i, s in enumerate(ids)}
    member = np.zeros((len(ids), len(sets)), bool)
    for k, (sites, _) in enumerate(sets):
        member[[place[s] for s in sites if s in place], k] = True
    weight = np.array([w for _, w in sets])
    total = sum(scores.values()) or 1.0
    bonus = np.array([score_weight * scores[s] / total for s in ids])
    clash = np.zeros((len(ids), len(ids)), bool)
    for a, b in clashes:
        if a in place and b in place:
            clash[place[a], place[b]] = clash[place[b], place[a]] = True
    best: tuple[float, list[int]] = (-1.0, [])
    until, late = time.monotonic() + seconds, False

    def search(chosen: list[int], free: np.ndarray, open_: np.ndarray, value: float) -> None:
        nonlocal best, late
        if len(chosen) == n:
            if value > best[0] + 1e-12:
                best = (value, sorted(ids[i] for i in chosen))
            return
        if late or time.monotonic() > until:
            late = True
            return
        left = np.flatnonzero(free)
        need = n - len(chosen)
        if len(left) < need:
            return
        gain = member[left] @ (weight * open_) + bonus[left]
        order = np.lexsort((left, -gain))
        if value + min(gain[order[:need]].sum(), (weight * open_).sum() + np.sort(bonus[left])[-need:].sum()) <= best[0] + 1e-12:
            return
        free = free.copy()
        for k, i in enumerate(order):
            if value + gain[order[k : k + need]].sum() <= best[0] + 1e-12 or len(order) - k < need:
                return
            site = left[i]
            free[site] = False
            search([*chosen, int(site)], free & ~clash[site], open_ & ~member[site], value + float(gain[i]))

    search([], np.ones(len(ids), bool), np.ones(len(sets), bool), 0.0)
    if not best[1]:
        raise ValueError("no feasible choice" if not late else "no choice found in time")
    return best[1], best[0], "TimeLimit" if late else "Optimal"


def solve_exact(cover: DataFrame, weights: DataFrame, clashes: DataFrame, sites: DataFrame, n: int, score_weight: float = 0.0, seconds: float = 300.0) -> tuple[list[int], float, str]:
    """Collapse the instance in Spark and search it; its size is checked before anything is collected."""
    sets = stored(collapse(cover.join(sites.select("candidate_id"), "candidate_id", "left_semi"), weights))
    if sets.count() > EXACT_SETS or sites.count() > EXACT_SITES:
        raise ValueError("too large for the exact search; use the greedy one")
    for end in "ab":  # no pairs but those of these sites
        clashes = clashes.join(sites.select(F.col("candidate_id").alias(end)), end, "left_semi")
    pairs = {(r["a"], r["b"]) for r in clashes.select("a", "b").collect()}
    return exact([(list(r["sites"]), r["weight"]) for r in sets.orderBy("sites").collect()], {r["candidate_id"]: r["score"] for r in sites.select("candidate_id", "score").collect()}, pairs, n, score_weight, seconds)


def summarise(selected: DataFrame, cover: DataFrame, weights: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: sites, demand covered, people and their share, provinces, districts, mean score of a selection."""
    seen = cover.join(selected.select("candidate_id"), "candidate_id", "left_semi").select("node_id").distinct()
    got = weights.join(seen, "node_id").agg(F.coalesce(F.round(F.sum("weight"), 9), F.lit(0.0)).alias("demand"), F.coalesce(F.sum("people"), F.lit(0).cast("long")).alias("people"))
    of = sites.join(selected.select("candidate_id"), "candidate_id", "left_semi").agg(F.count("*").alias("sites"), F.count_distinct("province_id").alias("provinces"), F.count_distinct("district_id").alias("districts"), F.round(F.avg("score"), 6).alias("mean_score"))
    everyone = weights.agg(F.sum("people").alias("all"))
    # three tables of one row each
    return got.join(of, F.lit(True)).join(everyone, F.lit(True)).select("sites", "demand", "people", F.round(F.col("people") / F.col("all"), 9).alias("people_share"), "provinces", "districts", "mean_score")


def marginal_coverage(cover: DataFrame, weights: DataFrame, selected: DataFrame) -> DataFrame:
    """``candidate_id, selected, marginal``: of a selected site the weight that it alone covers, of another what it would add."""
    chosen = selected.select("candidate_id").withColumn("selected", F.lit(True))
    marked = cover.join(chosen, "candidate_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    times = marked.groupBy("node_id").agg(F.count_if("selected").alias("times"))
    rows = marked.join(times, "node_id").join(weights.select("node_id", "weight"), "node_id")
    counts = (F.col("selected") & (F.col("times") == 1)) | (~F.col("selected") & (F.col("times") == 0))
    return rows.groupBy("candidate_id", "selected").agg(F.round(F.sum(F.when(counts, F.col("weight")).otherwise(0.0)), 9).alias("marginal"))


def contribution(selected: DataFrame, spacing: float, radius: float) -> DataFrame:
    """Of each selected site its nearest other, how many others are nearer than ``spacing`` and within ``radius``."""
    a = selected.select("candidate_id", "x", "y")
    b = selected.select(F.col("candidate_id").alias("other_id"), "x", "y")
    pairs = pairs_within(a, b, radius).where("candidate_id <> other_id")
    near = pairs.groupBy("candidate_id").agg(F.min(F.struct("dist", "other_id")).alias("m"), F.count_if(F.col("dist") < spacing).alias("too_near"), F.count("*").alias("within"))
    out = selected.select("candidate_id").join(near, "candidate_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("candidate_id", F.col("m.other_id").alias("nearest_id"), F.round("m.dist", 6).alias("nearest_m"), F.coalesce("too_near", zero).alias("too_near"), F.coalesce("within", zero).alias("within"))


def nearby(sites: DataFrame, radius: float, cap: int = 10) -> DataFrame:
    """``candidate_id, other_id, dist, nth, total``: the ``cap`` nearest others by distance, then id; ``total`` counts all within ``radius``.

    Totals are counted without pairs. The nearest are looked for within a reach
    that the sites' density gives and that doubles, up to ``radius``, for sites
    that have more others than were found.
    """
    own = stored(sites.select("candidate_id", "x", "y").where("x is not null and y is not null"))
    within = disc_sums(own, own.select("x", "y", F.lit(1).alias("one")), "candidate_id", ["one"], [radius])
    left = stored(own.join(within.select("candidate_id", (F.col("s0") - 1).alias("total")).where("total > 0"), "candidate_id"))
    # of those at one place only the first ids can be among a site's nearest
    here = Window.partitionBy("x", "y").orderBy("candidate_id")
    others = stored(own.withColumn("n", F.row_number().over(here)).where(F.col("n") <= cap + 1).select(F.col("candidate_id").alias("other_id"), "x", "y"))
    reach = min(float(radius), _sparse(others, radius) * max(1.0, ((cap + 1) / 2) ** 0.5))
    first, need = Window.partitionBy("candidate_id").orderBy("dist", "other_id"), F.least(F.lit(cap), F.col("total"))
    found = None
    while True:
        pairs = pairs_within(left, others, reach).where("candidate_id <> other_id")
        got = stored(pairs.withColumn("nth", F.row_number().over(first).cast("long")).where(F.col("nth") <= cap))
        if reach < radius:
            done = got.groupBy("candidate_id", "total").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("candidate_id")
            left, got = stored(left.join(done, "candidate_id", "left_anti")), got.join(done, "candidate_id", "left_semi")
        found = got if found is None else found.unionByName(got)
        if reach >= radius or left.isEmpty():
            break
        reach = min(float(radius), 2 * reach)
    return found.select("candidate_id", "other_id", F.round("dist", 6).alias("dist"), "nth", "total")


def sites_by_area(points: DataFrame, key: str, areas: DataFrame, area_key: str, names: DataFrame, cell: float) -> DataFrame:
    """``name, n``: how many points lie in areas of each name; the first name of several, 'outside' of none."""
    from locarium.operators.spatial import polygons_of_point

    held = polygons_of_point(points, areas, key, area_key, cell).join(names, area_key).groupBy(key).agg(F.min("name").alias("name"))
    return points.select(key).join(held, key, "left").groupBy(F.coalesce("name", F.lit("outside")).alias("name")).agg(F.count("*").alias("n"))


def radius_robustness(sites: DataFrame, weights: DataFrame, radii: list[float], selections: dict[str, DataFrame]) -> DataFrame:
    """``method, radius, sites, demand, people_share, provinces, districts`` of each selection at each radius.

    Only the coverage radius varies: the weights stay those given. One
    coverage relation at the largest radius serves all.
    """
    far = pairs_within(weights.select("node_id", "x", "y"), sites.select("candidate_id", "x", "y"), max(radii)).select("candidate_id", "node_id", "dist")
    chosen = None
    for method, s in selections.items():
        one = s.select(F.lit(method).alias("method"), "candidate_id")
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = stored(chosen)
    grid = F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius")
    pairs = chosen.join(far, "candidate_id").groupBy("method", "node_id").agg(F.min("dist").alias("dist")).select("method", "node_id", "dist", grid).where("dist <= radius")
    covered = pairs.join(weights.select("node_id", "weight", "people"), "node_id").groupBy("method", "radius").agg(F.sum("weight").alias("demand"), F.sum("people").alias("people"))
    everyone = weights.agg(F.sum("people").alias("all"))
    about = chosen.join(sites.select("candidate_id", "province_id", "district_id"), "candidate_id").groupBy("method").agg(F.count("*").alias("sites"), F.count_distinct("province_id").alias("provinces"), F.count_distinct("district_id").alias("districts"))
    rows = about.select("*", grid).join(covered, ["method", "radius"], "left").join(everyone, F.lit(True))
    zero = F.lit(0.0)
    return rows.select("method", "radius", "sites", F.round(F.coalesce("demand", zero), 9).alias("demand"), F.round(F.coalesce(F.col("people") / F.col("all"), zero), 9).alias("people_share"), "provinces", "districts")


def radius_study(sites: DataFrame, nodes: DataFrame, chargers: DataFrame, radii: list[float], base: float, n: int, spacings: list[float], spacing: float, factor: float, score_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Every method at every radius, solved anew, and a check of what the weights' radius does.

    The methods are 'greedy' (solved at each radius under ``spacing``), 'top'
    (the best-ranked ``n``) and 'spaced <metres>' for each of ``spacings``.
    Weights stay those of the ``base`` radius, so that only coverage varies;
    the rows are those of :func:`radius_robustness`. The check has a row for
    each other radius: how many sites greedy ``shared`` with greedy under
    weights that follow the radius, and the people's share that either covers.
    """
    held = stored(demand_weights(nodes, chargers, base, factor))
    fixed = {"top": stored(sites.select("candidate_id", "rank").orderBy("rank", "candidate_id").limit(n))}
    fixed |= {f"spaced {s:g}": stored(spaced_top(sites, "candidate_id", s, n)) for s in spacings}
    rows, checks = None, None
    for radius in radii:
        here = stored(greedy(stored(coverage(sites, held, radius)), held, spacing, sites, n, score_weight))
        part = stored(radius_robustness(sites, held, [radius], {"greedy": here, **fixed}))
        rows = part if rows is None else rows.unionByName(part)
        if radius == base:
            continue
        follow = stored(demand_weights(nodes, chargers, radius, factor))
        moved = stored(greedy(stored(coverage(sites, follow, radius)), follow, spacing, sites, n, score_weight))
        shared = moved.join(here, "candidate_id", "left_semi").agg(F.count("*").alias("shared"))
        then = radius_robustness(sites, follow, [radius], {"greedy": moved}).select(F.col("people_share").alias("share_follows"))
        now = part.where("method = 'greedy'").select("radius", F.col("people_share").alias("share_fixed"))
        # three tables of one row each
        check = now.join(then, F.lit(True)).join(shared, F.lit(True)).select("radius", "shared", "share_fixed", "share_follows")
        checks = check if checks is None else checks.unionByName(check)
    if checks is None:
        checks = sites.sparkSession.createDataFrame([], "radius double, shared long, share_fixed double, share_follows double")
    return rows, checks


def sensitivity(base: dict[str, float], varied: dict[str, list[float]], solve, summary) -> DataFrame:
    """``parameter, value, demand, people_share, provinces, overlap``: one parameter at a time off ``base``, its default left out.

    ``solve(**parameters)`` gives the selection (``candidate_id``) and
    ``summary(selection, **parameters)`` its one row of figures. So many
    selections as there are variants, each a Spark job of its own.
    """
    first = stored(solve(**base).select("candidate_id"))
    out = None
    for name, values in varied.items():
        for value in values:
            if value == base[name]:
                continue
            params = base | {name: value}
            chosen = stored(solve(**params).select("candidate_id"))
            same = chosen.join(first, "candidate_id", "left_semi").agg(F.count("*").alias("overlap"))
            row = summary(chosen, **params).select("demand", "people_share", "provinces").join(same, F.lit(True))
            row = row.select(F.lit(name).alias("parameter"), F.lit(float(value)).alias("value"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def solved_anew(sites: DataFrame, nodes: DataFrame, chargers: DataFrame, widest: float, n: int, spacing: float, exactly: bool = False):
    """``solve, summary`` for :func:`sensitivity` over ``score_weight``, ``radius`` and ``factor``: each variant a network of its own.

    Demand and coverage both follow the radius, as when the network is built.
    Distances up to the ``widest`` radius are found once and weights once for
    each radius and factor. ``solve`` is the
    greedy network, or the exact one, which refuses instances over its size.
    """
    sites = stored(sites)
    far = stored(pairs_within(nodes.select("node_id", "x", "y"), sites.select("candidate_id", "x", "y"), widest).select("candidate_id", "node_id", "dist"))
    made: dict[tuple[float, float], DataFrame] = {}

    def parts(radius: float, factor: float) -> tuple[DataFrame, DataFrame]:
        if radius > widest:
            raise ValueError(f"radius {radius:g} above {widest:g}")
        if (radius, factor) not in made:
            made[radius, factor] = stored(demand_weights(nodes, chargers, radius, factor))
        return far.where(F.col("dist") <= radius).select("candidate_id", "node_id"), made[radius, factor]

    def solve(score_weight: float, radius: float, factor: float) -> DataFrame:
        cover, weights = parts(radius, factor)
        if not exactly:
            return greedy(cover, weights, spacing, sites, n, score_weight)
        chosen, _, _ = solve_exact(cover, weights, conflicts(sites, spacing), sites, n, score_weight)
        return sites.sparkSession.createDataFrame([(c,) for c in chosen], "candidate_id long")

    def summary(chosen: DataFrame, score_weight: float, radius: float, factor: float) -> DataFrame:
        return summarise(chosen, *parts(radius, factor), sites)

    return solve, summary


def reconcile(here: DataFrame, stored_before: DataFrame) -> DataFrame:
    """``method, missing, added, same``: whether selections ``(method, candidate_id)`` are those stored before."""
    a = here.select("method", "candidate_id", F.lit(1).alias("now"))
    b = stored_before.select("method", "candidate_id", F.lit(1).alias("then"))
    both = a.join(b, ["method", "candidate_id"], "full").groupBy("method").agg(F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("then").isNull()).alias("added"))
    return both.withColumn("same", (F.col("missing") == 0) & (F.col("added") == 0))


def consistency(selections: DataFrame, flags: DataFrame, n: int) -> DataFrame:
    """``method, size, size_ok, unflagged, unlisted, consistent``: stored selections against the flags of a layer, ids both ways.

    Both have ``method, candidate_id``. No row is lost: a method of one side alone is inconsistent.
    """
    size = selections.groupBy("method").agg(F.count("*").alias("size"))
    both = reconcile(selections, flags).select("method", F.col("added").alias("unflagged"), F.col("missing").alias("unlisted"))
    out = both.join(size, "method", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    ok = F.col("size") == n
    return out.select("method", "size", ok.alias("size_ok"), "unflagged", "unlisted", (ok & (F.col("unflagged") == 0) & (F.col("unlisted") == 0)).alias("consistent"))


def network_records(summary: DataFrame, method: str) -> DataFrame:
    """``id, metric, value``: every figure of a selection's one-row summary as a record."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in summary.columns])).alias("r")
    return summary.select(rows).select(F.concat(F.lit(f"network/{method}/"), "r.metric").alias("id"), "r.metric", "r.value")
