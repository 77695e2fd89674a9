"""Distance joins, nearest sources, zonal sums and point-in-polygon by a grid.

Points carry ``x, y`` in metres. A square cell of the radius' size bounds the
candidates of a distance join to the 3 x 3 cells around a point, so the join
is an equi-join on cells that Spark shuffles or broadcasts by size; AQE splits
dense cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locarium.storage import stored


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def _cells(df: DataFrame, size: float, around: bool) -> DataFrame:
    """``__cx, __cy`` of each point; with ``around`` a row for each of the nine cells about it."""
    if not around:
        return df.withColumns({"__cx": _cell(F.col("x"), size), "__cy": _cell(F.col("y"), size)})
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (
        df.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step))
        .withColumns({"__cx": _cell(F.col("x"), size) + F.col("__dx"), "__cy": _cell(F.col("y"), size) + F.col("__dy")})
        .drop("__dx", "__dy")
    )


#: Bytes up to which, as Spark estimates them, a table that is repeated over cells may be broadcast.
SMALL = 50_000


def unbroadcast(repeated: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``repeated``, made of ``right`` by repeating rows over cells, to be shuffled in a join with ``left`` unless one of the two is small.

    Spark's estimate sees neither the repetition nor how much more than their
    size files hold, and a broadcast goes through the driver.
    """
    least = min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right))
    return repeated if least <= SMALL else repeated.hint("merge")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """Every pair of a left and a right point at most ``radius`` apart, with ``dist``.

    Both sides' columns come along; they must differ but for ``x`` and ``y``,
    which are dropped. Points at exactly the radius count if ``inclusive``.
    Points without coordinates pair with nothing. A self-join gives each point
    with itself and each pair both ways. The smaller table should be on the
    right: its points are the ones that are repeated over nine cells.
    """
    a = _cells(left, radius, False).withColumnsRenamed({"x": "__ax", "y": "__ay"})
    b = _cells(right, radius, True).withColumnsRenamed({"x": "__bx", "y": "__by"})
    d = distance(F.col("__ax"), F.col("__ay"), F.col("__bx"), F.col("__by"))
    pairs = a.join(unbroadcast(b, left, right), ["__cx", "__cy"]).withColumn("dist", d)
    near = F.col("dist") <= radius if inclusive else F.col("dist") < radius
    return pairs.where(near).drop("__cx", "__cy", "__ax", "__ay", "__bx", "__by")


#: Rows of one side that meet in one group of :func:`disc_sums`, about.
GROUP = 250_000


def _strip_sums(sx: np.ndarray, sy: np.ndarray, sv: list[np.ndarray], px: np.ndarray, py: np.ndarray, radii: list[float], inclusive: bool) -> list[np.ndarray]:
    """For each radius and value the sums over the sources within it of every point, radius by radius.

    Sources lie in strips, sorted by ``x``. In a strip, those surely within
    come from running sums; only those near the circle's line are measured.
    """
    n, many = len(sx), len(px)
    k = max(1, int((n / 20) ** 0.5))
    low, high = sy.min(), sy.max()
    strip = np.minimum(((sy - low) * (k / (high - low))).astype(np.int64), k - 1) if high > low else np.zeros(n, np.int64)
    order = np.lexsort((sx, strip))
    sx, sy, strip = sx[order], sy[order], strip[order]
    sv = [v[order] if np.abs(v.astype(float)).sum() < 2**62 else v[order].astype(object) for v in sv]  # whole numbers of any size
    ahead = [np.concatenate((np.zeros(1, v.dtype), np.cumsum(v))) for v in sv]
    begins = np.searchsorted(strip, np.arange(k + 1))
    slack = 1e-7 * (max(radii) + max(np.abs(a).max() for a in (sx, sy, px, py)))
    out = [np.zeros(many, v.dtype) for _ in radii for v in sv]

    def measured(r: float, at: int, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        some = b > a
        who, a, size = who[some], a[some], (b - a)[some]
        done = 0
        while done < len(who):
            upto = max(done + 1, done + int(np.searchsorted(np.cumsum(size[done:]), 1_000_000)))
            w, f, s = who[done:upto], a[done:upto], size[done:upto]
            starts = np.cumsum(s) - s
            i = np.arange(int(s.sum())) - np.repeat(starts, s) + np.repeat(f, s)
            dx, dy = np.repeat(px[w], s) - sx[i], np.repeat(py[w], s) - sy[i]
            dist = np.sqrt(dx * dx + dy * dy)
            hit = dist <= r if inclusive else dist < r
            for j, v in enumerate(sv):
                out[at + j][w] += np.add.reduceat(v[i] * hit, starts)
            done = upto

    for s in range(k):
        begin, end = int(begins[s]), int(begins[s + 1])
        if begin == end:
            continue
        xs = sx[begin:end]
        bottom, top = sy[begin:end].min(), sy[begin:end].max()
        near = np.maximum(0.0, np.maximum(bottom - py, py - top))
        far = np.maximum(np.abs(bottom - py), np.abs(top - py))
        for q, r in enumerate(radii):
            who = np.flatnonzero(near <= r + slack)
            x = px[who]
            outer = np.sqrt(np.maximum(0.0, r * r - near[who] ** 2)) + slack
            left, right = begin + np.searchsorted(xs, x - outer, "left"), begin + np.searchsorted(xs, x + outer, "right")
            inner = np.sqrt(np.maximum(0.0, r * r - far[who] ** 2)) - slack
            sure = (inner > 0) & (far[who] < r - slack)
            inner_left = np.where(sure, begin + np.searchsorted(xs, x - inner, "left"), right)
            inner_right = np.where(sure, np.maximum(inner_left, begin + np.searchsorted(xs, x + inner, "right")), right)
            for j, v in enumerate(ahead):
                out[q * len(sv) + j][who] += v[inner_right] - v[inner_left]
            measured(r, q * len(sv), who, left, inner_left)
            measured(r, q * len(sv), who, inner_right, right)
    return out


def disc_sums(points: DataFrame, sources: DataFrame, key: str, values: list[str], radii: list[float], inclusive: bool = True) -> DataFrame:
    """``key`` and ``s0, s1, ...``: sums of whole numbers over the sources within each radius of a point, radius by radius; points without any are absent.

    Sources lie in square blocks of the largest radius' size and a point meets
    the nine blocks about it; no pair of the two becomes a row. Blocks of very
    many rows are dealt into several groups, so that a group is bounded.
    """
    side, names = float(max(radii)), [f"s{i}" for i in range(len(radii) * len(values))]
    placed = lambda df: df.where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    block = {"__cx": _cell(F.col("x"), side), "__cy": _cell(F.col("y"), side)}
    src = placed(sources.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)]))
    src = stored(src.groupBy("x", "y").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(values))]).withColumns(block))
    own = placed(points.select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).withColumns(block)
    at = ["__cx", "__cy"]
    around = _cells(own.groupBy(*at).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y")).drop(*at), side, True)
    points_in = around.groupBy(*at).agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("pn"))
    dealt = stored(src.groupBy(*at).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("sn")).join(points_in, at))  # blocks that both sides have
    part = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    s = src.join(dealt, at).withColumn("__s", part(("x", "y"), "sn")).withColumn("__p", every("pn"))
    p = _cells(own.drop(*at), side, True).join(dealt, at).withColumn("__p", part(("k",), "pn")).withColumn("__s", every("sn"))
    group = [*at, "__s", "__p"]

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[np.ndarray] = [np.zeros(0, np.int64) for _ in names]
        some = np.zeros(len(right), bool)
        if len(left) and len(right):
            lx, ly, rx, ry = (t.column(c).to_numpy() for t in (left, right) for c in "xy")
            held = [left.column(f"v{i}") for i in range(len(values))]
            got = _strip_sums(lx, ly, [pc.fill_null(h, 0).to_numpy() for h in held], rx, ry, radii, inclusive)
            for g in got:
                some |= (g != 0).astype(bool)
        keys = right.column("k").filter(pa.array(some))
        return pa.table([keys, *[pa.array(g[some] if len(g) else g, pa.int64()) for g in got]], names=["k", *names])

    kind = points.schema[key].dataType.simpleString()
    sides = [t.groupBy(*group) for t in (s.select(*group, "x", "y", *[f"v{i}" for i in range(len(values))]), p.select(*group, "k", "x", "y"))]
    found = sides[0].cogroup(sides[1]).applyInArrow(sums, f"k {kind}, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy(F.col("k").alias(key)).agg(*[F.sum(n).alias(n) for n in names])


def count_within(points: DataFrame, sources: DataFrame, key: str, radii: dict[str, float], inclusive: bool = True) -> DataFrame:
    """``key`` and, for each named radius, the number of sources within it; 0 where there is none."""
    counts = disc_sums(points, sources.select("x", "y", F.lit(1).alias("one")), key, ["one"], list(radii.values()), inclusive)
    out = points.select(key).join(counts, key, "left")
    return out.select(key, *[F.coalesce(f"s{i}", F.lit(0).cast("long")).alias(name) for i, name in enumerate(radii)])


def sum_within(points: DataFrame, pixels: DataFrame, key: str, value: str, radii: dict[str, float]) -> DataFrame:
    """``key`` and, for each named radius, the sum of ``value`` over the pixels within it (inclusive); 0 without any.

    Sums grow with the radius when values are not negative. A pixel without a
    value is absent. Whole numbers are summed by :func:`disc_sums`; others
    pair by pair, as differences of running sums would cost them digits.
    """
    kind = pixels.schema[value].dataType
    held = pixels.where(F.col(value).isNotNull()).select("x", "y", value)
    if isinstance(kind, T.IntegralType):
        sums = disc_sums(points, held, key, [value], list(radii.values())).withColumnsRenamed({f"s{i}": name for i, name in enumerate(radii)})
    else:
        pairs = pairs_within(held, points.select(key, "x", "y"), max(radii.values()))
        sums = pairs.groupBy(key).agg(*[F.sum(F.when(F.col("dist") <= r, F.col(value)).otherwise(F.lit(0).cast(kind))).alias(name) for name, r in radii.items()])
    out = points.select(key).join(sums, key, "left")
    return out.select(key, *[F.coalesce(name, F.lit(0).cast(sums.schema[name].dataType)).alias(name) for name in radii])


def nearest(points: DataFrame, sources: DataFrame, key: str, source_key: str, start: float, most: float | None = None) -> DataFrame:
    """``key, source_key, dist``: the nearest source of each point, the smallest id of equally near ones.

    Rings grow: points without a source within the radius try again with twice
    the radius. The first radius is ``start``, or smaller for dense sources, so
    that a point meets a few of them however many there are. Beyond ``most`` (inclusive), or
    without any source, both columns are null.
    """
    src = sources.select(F.col(source_key), "x", "y").where("x is not null and y is not null")
    src = stored(src.groupBy("x", "y").agg(F.min(source_key).alias(source_key)))  # the others at a place never win
    kinds = {source_key: sources.schema[source_key].dataType}
    pairs = lambda left, radius: pairs_within(left, src, radius)
    return _rings(points, src, pairs, key, ("dist", source_key), kinds, _sparse(src, start), most).select(key, source_key, "dist")


def _sparse(sources: DataFrame, start: float) -> float:
    """``start``, or less where sources are so dense that a cell of that size, as one of them sees it, holds more than four."""
    radius = float(start)
    for _ in range(8):
        n = sources.groupBy(_cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy")).agg(F.count("*").alias("n"))
        seen = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if seen <= 4:
            break
        radius *= max(1 / 64, (2 / seen) ** 0.5)
    return radius


def _rings(points: DataFrame, sources: DataFrame, pairs: Callable[[DataFrame, float], DataFrame], key: str, columns: tuple[str, ...], kinds: dict[str, T.DataType], start: float, most: float | None) -> DataFrame:
    """The least of ``columns`` for each point over ``pairs``, by rings that double until every point has one or ``most`` is reached."""
    left = points.select(key, "x", "y").where("x is not null and y is not null")
    found: DataFrame | None = None
    if not sources.isEmpty():
        radius = min(start, most) if most is not None else start
        while True:
            best = pairs(left, radius).groupBy(key).agg(F.min(F.struct(*columns)).alias("best"))
            both = stored(left.join(best, key, "left"))
            got = both.where("best is not null").select(key, "best.*")
            found = got if found is None else found.unionByName(got)
            left = both.where("best is null").select(key, "x", "y")
            if (most is not None and radius >= most) or left.isEmpty():
                break
            radius = radius * 2 if most is None else min(radius * 2, most)
    if found is None:
        return points.select(key, *[F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in columns])
    return points.select(key).join(found, key, "left")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment of length 0 is a point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    return distance(px, py, ax + t * dx, ay + t * dy)


def segments_within(points: DataFrame, segments: DataFrame, key: str, segment_key: str, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, dist, segment_key`` and ``keep`` of every segment (``x1, y1, x2, y2``) within ``radius`` of a point (inclusive).

    A segment is cut into pieces of at most the radius' length; each piece
    stands in the cells that its box, widened by the radius, touches.
    """
    cuts = F.greatest(F.lit(1), F.ceil(distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / radius).cast("int"))
    pieces = segments.withColumn("__n", cuts).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("__n"))
    lo_x, hi_x = (f(at("x1", "x2", F.col("__i")), at("x1", "x2", F.col("__i") + 1)) for f in (F.least, F.greatest))
    lo_y, hi_y = (f(at("y1", "y2", F.col("__i")), at("y1", "y2", F.col("__i") + 1)) for f in (F.least, F.greatest))
    boxed = pieces.withColumn("__cx", F.explode(F.sequence(_cell(lo_x - radius, radius), _cell(hi_x + radius, radius)))).withColumn("__cy", F.explode(F.sequence(_cell(lo_y - radius, radius), _cell(hi_y + radius, radius))))
    boxed = boxed.select(segment_key, "x1", "y1", "x2", "y2", *keep, "__cx", "__cy").distinct()
    d = segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    near = _cells(points.select(key, "x", "y"), radius, False).join(boxed, ["__cx", "__cy"]).withColumn("dist", d)
    return near.where(F.col("dist") <= radius).select(key, "dist", segment_key, *keep)


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, segment_key: str, start: float, most: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nearest segment of each point, the smallest id of equally near ones, and its columns ``keep``; rings grow as in :func:`nearest`."""
    kinds = {f.name: f.dataType for f in segments.schema}
    pairs = lambda left, radius: segments_within(left, segments, key, segment_key, radius, keep)
    return _rings(points, segments, pairs, key, ("dist", segment_key, *keep), kinds, start, most)


def _inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast over a closed ring ``array<struct<x, y>>``; the boundary counts as inside."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.exists(edges, on) | (F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1)


def polygons_of_point(points: DataFrame, polygons: DataFrame, key: str, polygon_key: str, cell: float) -> DataFrame:
    """``key, polygon_key``: every polygon that holds a point; ``polygons.ring`` is a closed ring, its boundary is inside."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = polygons.withColumn("__cx", F.explode(F.sequence(_cell(F.array_min(xs), cell), _cell(F.array_max(xs), cell)))).withColumn("__cy", F.explode(F.sequence(_cell(F.array_min(ys), cell), _cell(F.array_max(ys), cell))))
    held = _cells(points.select(key, "x", "y"), cell, False).join(boxed.select(polygon_key, "ring", "__cx", "__cy"), ["__cx", "__cy"]).where(_inside(F.col("ring"), F.col("x"), F.col("y")))
    return held.select(key, polygon_key)


def polygon_of_point(points: DataFrame, polygons: DataFrame, key: str, polygon_key: str, cell: float) -> DataFrame:
    """``key, polygon_key``: the polygon that holds a point, the smallest id of several, null if none."""
    held = polygons_of_point(points, polygons, key, polygon_key, cell)
    return points.select(key).join(held.groupBy(key).agg(F.min(polygon_key).alias(polygon_key)), key, "left")


def inside_any(points: DataFrame, polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """``key, inside``: whether any polygon holds the point."""
    numbered = polygons.select("ring").withColumn("__id", F.lit(1))
    return polygon_of_point(points, numbered, key, "__id", cell).select(key, F.col("__id").isNotNull().alias("inside"))
