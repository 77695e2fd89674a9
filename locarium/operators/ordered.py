"""Selections that depend on an order: priority deduplication, quotas, spacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium.operators.spatial import distance, pairs_within
from locarium.settings import HOST_PRIORITY
from locarium.storage import stored


def host_order() -> Column:
    """Sort key of candidates: host priority, origin, id."""
    place = F.coalesce(*[F.when(F.col("host_type") == h, F.lit(i)) for i, h in enumerate(HOST_PRIORITY)], F.lit(len(HOST_PRIORITY)))
    return F.struct(place.alias("p"), F.when(F.col("origin") == "host", 0).otherwise(1).alias("o"), F.col("candidate_id").alias("id"))


def priority_dedup(points: DataFrame, key: str, order: Column, radius: float) -> DataFrame:
    """``key, kept, merged_into, merged_count``: greedy in ``order``, a kept point removes all later ones within ``radius`` (inclusive).

    Not transitive. Computed in rounds: a point is kept once all earlier
    neighbours are removed, and removed once an earlier neighbour is kept;
    the result is that of the sequential pass. All points of a cell whose
    diagonal is the radius are neighbours, so that only the first open one of
    each can be kept next: a round compares these, and later the kept ones,
    with the points about them, and no table of neighbours is made. ``merged_into`` is the first
    kept neighbour, ``merged_count`` the removed points that name this one.
    ``order`` must be a total order.
    """
    placed = points.select(F.col(key).alias("id"), order.alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    bare = "x is null or y is null or isnan(x) or isnan(y) or abs(x) = double('infinity') or abs(y) = double('infinity')"
    table = stored(placed.withColumn("alone", F.expr(bare)))
    # a hair less than the radius over the root of two: two points of a cell are surely within the radius
    side = radius / 2**0.5 * (1 - 1e-9) if radius > 0 else 1.0
    cell = {f"c{c}": F.floor(F.col(c) / side).cast("long") for c in "xy"} if radius > 0 else {"cx": F.col("x"), "cy": F.col("y")}
    open_ = stored(table.where("not alone").select("id", "ord", "x", "y").withColumns(cell))
    steps = F.array(*[F.lit(i) for i in ((-2, -1, 0, 1, 2) if radius > 0 else (0,))])

    def near(few: DataFrame, many: DataFrame) -> DataFrame:
        """Pairs within the radius of ``few(a_id, a_ord, ax, ay, cx, cy)`` and points."""
        about = few.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
        return many.join(about, ["cx", "cy"]).where(distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) <= radius)

    named = [F.col("id").alias("a_id"), F.col("ord").alias("a_ord"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy"]
    every, taken = open_, None
    while not open_.isEmpty():
        first = stored(open_.groupBy("cx", "cy").agg(F.min(F.struct("ord", "id", "x", "y")).alias("f")).select("f.*", "cx", "cy").select(*named))
        blocked = near(first, open_).where("ord < a_ord").select("a_id").distinct()
        keep = stored(first.join(blocked, "a_id", "left_anti"))
        taken = keep if taken is None else stored(taken.unionByName(keep))
        gone = near(keep, open_).select("id").distinct()
        open_ = stored(open_.join(gone, "id", "left_anti"))
    alone = table.where("alone").select("id", F.lit(None).cast(table.schema["id"].dataType).alias("a_id"))
    if taken is None:
        joined = alone
    else:
        # a kept point is its own first one: none before it is kept within the radius
        into = near(taken, every).groupBy("id").agg(F.min(F.struct("a_ord", "a_id")).alias("m")).select("id", F.col("m.a_id").alias("a_id"))
        joined = into.unionByName(alone)
    kept = F.coalesce(F.col("a_id") == F.col("id"), F.lit(True))
    joined = stored(joined.select("id", kept.alias("kept"), F.when(~kept, F.col("a_id")).alias("merged_into")))
    counts = joined.where("merged_into is not null").groupBy(F.col("merged_into").alias("id")).agg(F.count("*").alias("merged_count"))
    return joined.join(counts, "id", "left").select(F.col("id").alias(key), "kept", "merged_into", F.when(F.col("kept"), F.coalesce("merged_count", F.lit(0).cast("long"))).alias("merged_count"))


def allocate_quotas(counts: DataFrame, group: str, size: int) -> DataFrame:
    """``group, n, quota``: ``size`` seats in proportion to ``n`` by largest remainder, ties by group; integers only.

    More seats than rows is an error.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    if size > total:
        raise ValueError(f"{size} seats for {total} rows")
    exact = F.lit(size).cast("long") * F.col("n")
    base = counts.withColumn("__low", F.floor(exact / F.lit(total)).cast("long")).withColumn("__rest", F.pmod(exact, F.lit(total).cast("long")))
    given = base.agg(F.sum("__low")).first()[0] or 0
    nth = F.row_number().over(Window.orderBy(F.col("__rest").desc(), group))
    return base.withColumn("quota", F.col("__low") + F.when(nth <= size - given, 1).otherwise(0)).select(group, "n", "quota")


def greedy_spacing(distances: np.ndarray, radius: float, most: int) -> list[int]:
    """Places, in the given order, farther than ``radius`` from all places kept; at most ``most``."""
    kept: list[int] = []
    free = np.ones(len(distances), bool)
    while len(kept) < most and free.any():
        i = int(free.argmax())
        kept.append(i)
        free &= distances[i] > radius
        free[i] = False
    return kept


def spacing_select(x: np.ndarray, y: np.ndarray, quota: int) -> tuple[list[int], float | None]:
    """The first ``quota`` places under the largest radius that still leaves so many; ``(places, radius)``.

    The number left doesn't fall steadily with the radius, so every distance
    between two places counts, from the largest down, and 0 at last; but those
    down to the largest distance at which a place was passed over for another
    leave the same places and are skipped. No table of distances is made. A
    quota of all places takes all at radius 0; a quota of 0 takes none.
    """
    if quota <= 0:
        return [], None
    if quota >= len(x):
        return list(range(len(x))), 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        least = np.nan  # places as far apart as this are taken: none at first
        while True:
            got, apart = [0], np.full(len(x), np.nan)
            while len(got) < quota:
                i = got[-1]
                d = np.sqrt((x[i + 1 :] - x[i]) ** 2 + (y[i + 1 :] - y[i]) ** 2)
                apart[i] = np.nan
                apart[i + 1 :] = d if i == 0 else np.minimum(apart[i + 1 :], d)
                free = apart[i + 1 :] >= least
                if not free.any():
                    break
                got.append(i + 1 + int(free.argmax()))
            if len(got) == quota:
                return got, _distance_below(x, y, least)
            passed = apart[apart > 0]
            if not len(passed):
                return list(range(quota)), 0.0
            least = passed.max()


def _distance_below(x: np.ndarray, y: np.ndarray, limit: float, each: int = 16) -> float:
    """The largest distance of two places that is below ``limit`` (NaN: the largest of all), 0 without any.

    Places are put into boxes of some ``each``; only boxes so far apart that
    they may have a larger one than that found already are compared.
    """
    some = np.isfinite(x) & np.isfinite(y)
    odd = not some.all()
    below = lambda d: d[~(d >= limit) & ~np.isnan(d)]
    best = 0.0
    if odd:  # places that aren't anywhere are compared with all
        for i in np.flatnonzero(~some):
            best = max(best, below(np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2)).max(initial=0.0))
        x, y = x[some], y[some]
    if len(x) < 2:
        return float(best)
    k = max(1, round((len(x) / each) ** 0.5))
    order = np.argsort(x, kind="stable")
    strip = np.empty(len(x), np.int64)
    strip[order] = np.arange(len(x)) * k // len(x)
    order = np.lexsort((y, strip))
    x, y = x[order], y[order]
    begin = np.arange(0, len(x), max(1, len(x) // (k * k)))
    end = np.append(begin[1:], len(x))
    lx, hx, ly, hy = (f.reduceat(v, begin) for v in (x, y) for f in (np.minimum, np.maximum))
    for i in range(len(begin)):
        dx, dy = np.maximum(0, np.maximum(lx[i:] - hx[i], lx[i] - hx[i:])), np.maximum(0, np.maximum(ly[i:] - hy[i], ly[i] - hy[i:]))
        fx, fy = np.maximum(hx[i:] - lx[i], hx[i] - lx[i:]), np.maximum(hy[i:] - ly[i], hy[i] - ly[i:])
        # a hair of slack, as these distances are rounded too
        may = (fx * fx + fy * fy) * (1 + 1e-12) > best * best
        may &= ~((dx * dx + dy * dy) * (1 - 1e-12) >= limit * limit)
        own = slice(begin[i], end[i])
        js = i + np.flatnonzero(may)
        for a in range(0, len(js), 4096):
            b, e = begin[js[a : a + 4096]], end[js[a : a + 4096]]
            at = np.repeat(b - np.concatenate(([0], np.cumsum(e - b)[:-1])), e - b) + np.arange(int((e - b).sum()))
            d = np.sqrt((x[at] - x[own, None]) ** 2 + (y[at] - y[own, None]) ** 2)
            best = max(best, below(d).max(initial=0.0))
    return float(best)


def apply_budget(points: DataFrame, key: str, group: str, order: list[Column], size: int) -> DataFrame:
    """``key, group, selected, radius``: ``size`` points, by quota of each group, spread as far as each quota allows.

    A group is a district, whose candidates a task can hold.
    """
    quotas = allocate_quotas(points.groupBy(group).agg(F.count("*").alias("n")), group, size)
    rows = points.withColumn("__nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(key, group, "x", "y", "__nth").join(quotas.select(group, "quota"), group)
    kind, of = (points.schema[c].dataType.simpleString() for c in (key, group))

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("__nth", ignore_index=True)
        got, radius = spacing_select(df["x"].to_numpy(), df["y"].to_numpy(), int(df["quota"].iat[0]))
        return pd.DataFrame({key: df[key], group: df[group], "selected": df.index.isin(got), "radius": radius})

    return rows.groupBy(group).applyInPandas(choose, f"{key} {kind}, {group} {of}, selected boolean, radius double")


#: Points that :func:`spaced_top` goes through at once.
BLOCK = 10_000


def spaced_top(ranked: DataFrame, key: str, radius: float, n: int) -> DataFrame:
    """``key, nth``: down the ranking (``rank``, then ``key``), each point at least ``radius`` from all taken; maybe fewer than ``n``.

    Exactly at the distance is accepted. A round goes through the ``BLOCK``
    best-ranked open points and then drops all that are too near to those
    taken; no pairs of points are formed but those of points and taken ones.
    """
    open_ = stored(ranked.select(F.col(key).alias("id"), "rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    spark, kind = ranked.sparkSession, open_.schema["id"].dataType.simpleString()
    taken: list = []
    while len(taken) < n and (block := open_.orderBy("rank", "id").limit(BLOCK).collect()):
        x, y = (np.array([r[c] for r in block], float) for c in "xy")
        new, free = [], np.ones(len(block), bool)
        while len(taken) + len(new) < n and free.any():
            i = int(free.argmax())
            new.append(block[i])
            with np.errstate(invalid="ignore"):
                free &= ~(np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2) < radius)
            free[i] = False
        taken += [r["id"] for r in new]
        if len(taken) < n:
            # every point of the block is among the new ones or too near to one of them
            about = spark.createDataFrame([(r["id"], r["x"], r["y"]) for r in new], f"new {kind}, x double, y double")
            gone = about.select(F.col("new").alias("id"))
            if radius > 0:
                gone = gone.unionByName(pairs_within(open_, about, radius, inclusive=False).select("id"))
            open_ = stored(open_.join(gone.distinct(), "id", "left_anti"))
    return spark.createDataFrame([(t, i) for i, t in enumerate(taken, 1)], f"{key} {kind}, nth long")
