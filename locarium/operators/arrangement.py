"""Planar arrangements: where segments meet, and what follows from cutting them there.

Segments stand in the grid cells that they pass, so that contacts are found by
an equi-join on cells; AQE splits dense ones. Coordinates lie on a fine grid
(``snap``), on which equal points are equal values. Areas are tables of closed
rings ``ring array<struct<x, y>>``, several to a key, with ``hole`` true for
holes; without that column no ring is one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium.functions.geo import ring_area
from locarium.operators.graph import connected_components
from locarium.operators.spatial import _inside, pairs_within, segment_distance, unbroadcast
from locarium.storage import stored

#: Spacing of the grid, in metres. Points that are a few steps apart become one.
SNAP = 1e-6
_XY = ("x1", "y1", "x2", "y2")


def _snapped(c: Column, snap: float) -> Column:
    """On the grid; minus zero is zero."""
    return F.round(c / snap) * F.lit(float(snap)) + 0.0


def edges(areas: DataFrame, *keys: str) -> DataFrame:
    """``keys, x1, y1, x2, y2`` of every ring, directed so that the area lies on the left; points of length 0 are left out."""
    hole = F.col("hole") if "hole" in areas.columns else F.lit(False)
    step = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    turn = F.aggregate("step", F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    flat = areas.where(F.size("ring") > 1).withColumn("step", step).select(*keys, ((turn < 0) != hole).alias("back"), F.explode("step").alias("e"))
    way = lambda a, b: F.when(F.col("back"), F.col(f"e.{b}")).otherwise(F.col(f"e.{a}"))
    out = flat.select(*keys, way("x1", "x2").alias("x1"), way("y1", "y2").alias("y1"), way("x2", "x1").alias("x2"), way("y2", "y1").alias("y2"))
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _boxed(segments: DataFrame, cell: float, mark: str = "") -> DataFrame:
    """A row with ``cx, cy`` for each cell of the boxes of a segment's pieces of at most a cell's length.

    The box and its first cell come along as ``lx, hx, ly, hy, fx, fy``, with ``mark`` behind their names.
    """
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / cell).cast("int"))
    cut = segments.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    for c in "xy":
        at = lambda i: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (i / F.col("__n"))  # noqa: E731, B023
        a, b = at(F.col("__i")), at(F.col("__i") + 1)
        # a hair wider than the piece, so that a point on a cell's border is in both cells
        cut = cut.withColumns({f"l{c}{mark}": F.least(a, b) - cell * 1e-9, f"h{c}{mark}": F.greatest(a, b) + cell * 1e-9})
        cut = cut.withColumn(f"f{c}{mark}", F.floor(F.col(f"l{c}{mark}") / cell).cast("long"))
    for c in "xy":
        cut = cut.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"f{c}{mark}"), F.floor(F.col(f"h{c}{mark}") / cell).cast("long"))))
    return cut.drop("__n", "__i")


def in_cells(segments: DataFrame, cell: float) -> DataFrame:
    """A row with ``cx, cy`` for each cell that a segment may pass: the boxes of its pieces of at most a cell's length."""
    return _boxed(segments, cell).select(*segments.columns, "cx", "cy").distinct()


def _meeting(off: float):
    """For two segments ``ends``, whose bits say which ends lie on the other (both of the second, then both of the first), and ``t`` along the first where they only cross."""

    def apart(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = np.where(size == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / size)))
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        return np.sqrt(ex * ex + ey * ey)

    def meeting(*columns: pd.Series) -> pd.DataFrame:
        x1, y1, x2, y2, u1, v1, u2, v2 = (c.to_numpy(float) for c in columns)
        with np.errstate(all="ignore"):
            far = [apart(u1, v1, x1, y1, x2, y2), apart(u2, v2, x1, y1, x2, y2), apart(x1, y1, u1, v1, u2, v2), apart(x2, y2, u1, v1, u2, v2)]
            ends = sum((f <= off).astype(np.int32) << i for i, f in enumerate(far))
            d = (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1)
            t = ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / d
            u = ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / d
            proper = (ends == 0) & (d != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        return pd.DataFrame({"ends": ends, "t": pd.Series(t).astype("Float64").mask(~proper)})

    return F.pandas_udf(meeting, "ends int, t double")


def contacts(a: DataFrame, b: DataFrame, cell: float, on: tuple[str, ...] = (), where: Column | None = None, snap: float = SNAP) -> DataFrame:
    """Pairs of a segment of ``a(seg, x1, y1, x2, y2)`` and one of ``b(other, u1, v1, u2, v2)`` that meet, with ``points`` and ``kind``.

    Both have the columns ``on``, which must agree; ``where`` picks among
    pairs. ``kind`` is 'cross' (inside both), 'overlap' (in more than a point),
    'meet' (at ends of both) or 'touch' (an end within the other).
    """
    left = _boxed(a, cell)
    right = _boxed(b.withColumnsRenamed(dict(zip(("u1", "v1", "u2", "v2"), _XY, strict=True))), cell, "_").withColumnsRenamed(dict(zip(_XY, ("u1", "v1", "u2", "v2"), strict=True)))
    pairs = left.join(unbroadcast(right, a, b), ["cx", "cy", *on])
    for c in "xy":  # two boxes that meet, in the first cell that both have
        pairs = pairs.where((F.col(f"c{c}") == F.greatest(f"f{c}", f"f{c}_")) & (F.col(f"l{c}") <= F.col(f"h{c}_") + 4 * snap) & (F.col(f"l{c}_") <= F.col(f"h{c}") + 4 * snap))
    if where is not None:
        pairs = pairs.where(where)
    pairs = pairs.drop("cx", "cy", *[f"{n}{c}{m}" for n in "lhf" for c in "xy" for m in ("", "_")])
    x1, y1, x2, y2, u1, v1, u2, v2 = (F.col(c) for c in (*_XY, "u1", "v1", "u2", "v2"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    # three ends on the grid that lie on one line may be off it by as much
    off = 2 * snap
    met = pairs.withColumn("m_", _meeting(off)(x1, y1, x2, y2, u1, v1, u2, v2)).where("m_.ends > 0 or m_.t is not null")
    found = [F.when(F.col("m_.ends").bitwiseAND(1 << i) != 0, point(x, y)) for i, (x, y) in enumerate(((u1, v1), (u2, v2), (x1, y1), (x2, y2)))]
    met = met.withColumn("ends", F.array_distinct(F.array_compact(F.array(*found))))
    t = F.col("m_.t")
    crossing = F.array(point(_snapped(x1 + t * (x2 - x1), snap), _snapped(y1 + t * (y2 - y1), snap)))
    met = met.withColumn("points", F.when(F.size("ends") > 0, F.col("ends")).otherwise(crossing)).drop("m_")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    apart = F.hypot(last["x"] - first["x"], last["y"] - first["y"]) > 2 * off
    both = ((first == point(x1, y1)) | (first == point(x2, y2))) & ((first == point(u1, v1)) | (first == point(u2, v2)))
    kind = F.when(F.size("ends") == 0, "cross").when(apart, "overlap").when(both, "meet").otherwise("touch")
    # long segments may meet in several of their pieces
    return met.withColumn("kind", kind).drop("ends").distinct()


def noded(segments: DataFrame, cell: float, within: tuple[str, ...] = (), snap: float = SNAP) -> DataFrame:
    """``segments`` cut wherever they meet others: the same columns, a row per piece, in the segment's direction.

    Only segments that agree in ``within`` cut each other. Pieces that lie on
    one another come of every segment that they are part of, with equal ends.
    """
    keep = [c for c in segments.columns if c not in _XY]
    base = stored(segments.repartition(segments.sparkSession.sparkContext.defaultParallelism).withColumns({c: _snapped(F.col(c), snap) for c in _XY}).where("x1 <> x2 or y1 <> y2").withColumn("seg", F.monotonically_increasing_id()))
    a = base.select("seg", *within, *_XY)
    b = base.select(F.col("seg").alias("other"), *within, *[F.col(c).alias(n) for c, n in zip(_XY, ("u1", "v1", "u2", "v2"), strict=True)])
    met = stored(contacts(a, b, cell, within, F.col("seg") < F.col("other"), snap).select("seg", "other", "points"))
    cuts = met.select(F.explode(F.array("seg", "other")).alias("seg"), "points").select("seg", F.explode("points").alias("p"))
    ends = base.select("seg", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    points = _merged(stored(cuts.unionByName(ends).distinct()), 8 * snap)
    along = (F.col("p.x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("p.y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    placed = base.join(points, "seg").withColumn("t", along)
    to = F.lead("p").over(Window.partitionBy("seg").orderBy("t", "p"))
    pieces = placed.withColumn("to", to).where("to is not null")
    return pieces.select(*keep, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("to.x").alias("x2"), F.col("to.y").alias("y2"))


def _merged(points: DataFrame, within: float) -> DataFrame:
    """``points(seg, p)``, where points that are closer than ``within``, one to the next, become the smallest of them.

    Where several segments pass one point, each two of them give it with an error of its own.
    """
    nodes = stored(points.select("p").distinct())
    left, right = (nodes.select(F.col("p").alias(n), "p.x", "p.y") for n in "uv")
    close = stored(pairs_within(left, right, within).where("u <> v").select("u", "v"))
    if close.isEmpty():
        return points
    of = connected_components(close).withColumnRenamed("node", "p")
    return points.join(of, "p", "left").select("seg", F.coalesce("component", "p").alias("p")).distinct()


def undirected(pieces: DataFrame) -> DataFrame:
    """Add ``a`` and ``b``, a piece's ends in order."""
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return pieces.withColumns({"a": F.least(p, q), "b": F.greatest(p, q)})


def _heights(ring: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))


def _halfway(ys: Column, middle: Column) -> Column:
    return (F.array_max(F.filter(ys, lambda v: v <= middle)) + F.array_min(F.filter(ys, lambda v: v > middle))) / 2


def _crossed_at(ring: Column, y: Column) -> Column:
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    met = F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    return F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))


def _widest(ring: Column, y: Column, xs: Column) -> Column:
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("wide"), (-F.get(xs, i - 1)).alias("left"), ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("x")))
    first = F.get(ring, F.lit(0))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y"))).otherwise(F.struct(first["x"].alias("x"), first["y"].alias("y")))


def point_inside(ring: Column) -> Column:
    """A point inside a closed ring ``array<struct<x, y>>``: the middle of the widest span on the line halfway up.

    Halfway between the two heights of corners nearest to the middle, so that
    the line meets no corner. A ring without height gives its first corner.
    """
    ys = _heights(ring)
    y = _halfway(ys, (F.element_at(ys, 1) + F.element_at(ys, -1)) / 2)
    return _widest(ring, y, _crossed_at(ring, y))


def with_point_inside(df: DataFrame, ring: str, name: str) -> DataFrame:
    """Add ``name``, the :func:`point_inside` of a ring, step by step: in one expression each corner repeats the steps before it."""
    out = df.withColumn("ys_", _heights(F.col(ring)))
    out = out.withColumn("mid_", (F.element_at("ys_", 1) + F.element_at("ys_", -1)) / 2)
    out = out.withColumn("y_", _halfway(F.col("ys_"), F.col("mid_")))
    out = out.withColumn("xs_", _crossed_at(F.col(ring), F.col("y_")))
    return out.withColumn(name, _widest(F.col(ring), F.col("y_"), F.col("xs_"))).drop("ys_", "mid_", "y_", "xs_")


def _middles(pieces: DataFrame) -> DataFrame:
    return pieces.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})


def located(points: DataFrame, areas: DataFrame, key: str, cell: float, on: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (with ``x, y``) once for each area inside which they lie, with its ``key``; points on outlines may go either way.

    A point is inside if an odd number of the area's rings hold it. Points and
    areas agree in ``on``. A row of ``points`` must be told by its columns.
    """
    box = lambda c: F.transform("ring", lambda p: p[c])
    cells = areas.select(key, *on, "ring").withColumns({f"{n}{c}_": f(box(c)) for c in "xy" for n, f in (("l", F.array_min), ("h", F.array_max))})
    for c in "xy":
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"l{c}_") / cell).cast("long"), F.floor(F.col(f"h{c}_") / cell).cast("long"))))
    at = points.withColumns({f"c{c}": F.floor(F.col(c) / cell).cast("long") for c in "xy"})
    held = at.join(cells, ["cx", "cy", *on]).where("x >= lx_ and x <= hx_ and y >= ly_ and y <= hy_").where(_inside(F.col("ring"), F.col("x"), F.col("y")))
    names = list(dict.fromkeys([*points.columns, key]))
    return held.groupBy(*names).agg(F.count("*").alias("n_")).where("n_ % 2 = 1").drop("n_")


#: Signed area of closed outlines given by their directed pieces.
_AREA = "sum(x1 * y2 - x2 * y1) / 2"


#: Edges up to which an area is compared whole with others, and rows of one side that meet in one group, about.
EDGES, GROUP = 64, 10_000


def overlap_areas(a: DataFrame, a_key: str, b: DataFrame, b_key: str, cell: float, snap: float = SNAP, less: bool = False) -> DataFrame:
    """``a_key, b_key, shared``: the area that two areas share, of those that share any; with ``less`` only pairs whose ``a_key`` is the smaller.

    Areas of few edges meet by cells, and what two of them share comes of
    their edges alone (:func:`_shared`); nothing is cut, so that a pair costs
    the same however many others lie about it. Those of more than ``EDGES``
    edges are cut where they meet (:func:`_overlap_cut`). Areas may be concave
    and have holes; outlines may run along each other.
    """
    sides = []
    for df, key in ((a, a_key), (b, b_key)):
        rows = edges(df, key).withColumns({c: _snapped(F.col(c), snap) for c in _XY}).where("x1 <> x2 or y1 <> y2")
        box = [f(g(f"{c}1", f"{c}2")).alias(f"{n}{c}") for c in "xy" for n, f, g in (("l", F.min, F.least), ("h", F.max, F.greatest))]
        sides.append(stored(rows.groupBy(key).agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.when(F.col("x1") != F.col("x2"), F.array(*_XY)))).alias("e"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("round"), *box)))
    few = [s.where(F.col("n") <= EDGES) for s in sides]
    found = _overlap_pairs(few[0].withColumnRenamed(a_key, "k"), few[1].withColumnRenamed(b_key, "k"), cell, snap, less).withColumnsRenamed({"ka": a_key, "kb": b_key})
    many = [s.where(F.col("n") > EDGES) for s in sides]
    for i, rest in enumerate((sides[1], few[0])):  # many edges of a with all of b, then few of a with many of b
        if not many[i].isEmpty():
            own, other = (many[0], rest) if i == 0 else (rest, many[1])
            cut = _overlap_cut(a.join(own.select(a_key), a_key, "left_semi"), a_key, b.join(other.select(b_key), b_key, "left_semi"), b_key, cell, snap)
            found = found.unionByName(cut.where(F.col(a_key) < F.col(b_key)) if less else cut)
    return found


def _shared(left: np.ndarray, right: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What each two directed edges add to the area that their outlines share: below an edge an area begins or ends, so that products of what lies below both, signed by their directions, make up what lies in both."""
    x1, y1, x2, y2 = left.T
    u1, v1, u2, v2 = right.T
    lo, hi = np.maximum(np.minimum(x1, x2), np.minimum(u1, u2)), np.minimum(np.maximum(x1, x2), np.maximum(u1, u2))
    at = lambda x, a, b, c, d: b + (d - b) * ((x - a) / (c - a)) - base
    p, q, r, s = at(lo, x1, y1, x2, y2), at(hi, x1, y1, x2, y2), at(lo, u1, v1, u2, v2), at(hi, u1, v1, u2, v2)
    d1, d2 = p - r, q - s
    crossed = d1 * d2 < 0
    t = np.where(crossed, d1 / np.where(crossed, d1 - d2, 1.0), 0.0)
    first, middle, last = np.minimum(p, r), np.where(crossed, p + t * (q - p), np.minimum(p, r)), np.minimum(q, s)
    size = np.maximum(hi - lo, 0.0) * (t * (first + middle) + (1 - t) * (middle + last)) / 2
    return size * np.sign(x2 - x1) * np.sign(u2 - u1)


def _overlap_pairs(a: DataFrame, b: DataFrame, cell: float, snap: float, less: bool) -> DataFrame:
    """``ka, kb, shared`` of areas ``(k, e, round, lx, hx, ly, hy)``; ``e`` has the edges that aren't upright, four numbers each.

    Cells of very many areas are dealt into several groups, so that a group is
    bounded. Less than the grid's spacing along the shorter outline is nothing.
    """
    at = ["cx", "cy"]

    def celled(df: DataFrame) -> DataFrame:
        for c in "xy":
            df = df.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"l{c}") / cell).cast("long"), F.floor(F.col(f"h{c}") / cell).cast("long"))))
        return df

    sides = [celled(df.select("k", "e", "round", "lx", "hx", "ly", "hy")) for df in (a, b)]
    dealt = [s.groupBy(*at).agg(F.ceil(F.count("*") / GROUP).cast("int").alias(n)) for s, n in zip(sides, ("na", "nb"), strict=True)]
    both = stored(dealt[0].join(dealt[1], at))
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sides[0].join(both, at).withColumn("ga", part("na")).withColumn("gb", every("nb"))
    right = sides[1].join(both, at).withColumn("gb", part("nb")).withColumn("ga", every("na"))
    group = [*at, "ga", "gb"]

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(p) and len(q):
            cx, cy = p.column("cx")[0].as_py(), p.column("cy")[0].as_py()
            (pb, pe, pn, ps, pr), (qb, qe, qn, qs, qr) = (_unpacked(t) for t in (p, q))
            pk, qk = (t.column("k").to_numpy() for t in (p, q))
            step = max(1, 2_000_000 // len(q))
            for begin in range(0, len(p), step):
                lx, hx, ly, hy = (v[begin : begin + step, None] for v in pb)
                ok = (lx < qb[1]) & (qb[0] < hx) & (ly < qb[3]) & (qb[2] < hy)
                # in the first cell that both have
                ok &= (np.floor(np.maximum(lx, qb[0]) / cell) == cx) & (np.floor(np.maximum(ly, qb[2]) / cell) == cy)
                if less:
                    ok &= pk[begin : begin + step, None] < qk
                i, j = np.nonzero(ok)
                i += begin
                size = pn[i] * qn[j]
                i, j, size = i[size > 0], j[size > 0], size[size > 0]
                done, upto = 0, np.cumsum(size)
                while done < len(i):
                    to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 1_000_000)))
                    f, g, n = i[done:to], j[done:to], size[done:to]
                    starts = np.cumsum(n) - n
                    nth = np.arange(int(n.sum())) - np.repeat(starts, n)
                    wide = np.repeat(qn[g], n)
                    base = np.repeat(np.minimum(pb[2][f], qb[2][g]), n)
                    adds = _shared(pe[np.repeat(ps[f], n) + nth // wide], qe[np.repeat(qs[g], n) + nth % wide], base)
                    shared = np.add.reduceat(adds, starts)
                    some = shared > snap * np.minimum(pr[f], qr[g])
                    found.append((f[some], g[some], shared[some]))
                    done = to
        i, j, shared = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([p.column("k").take(pa.array(i)), q.column("k").take(pa.array(j)), pa.array(shared, pa.float64())], names=["ka", "kb", "shared"])

    names = [*group, "k", "e", "round", "lx", "hx", "ly", "hy"]
    kinds = [df.schema["k"].dataType.simpleString() for df in (a, b)]
    return left.select(*names).groupBy(*group).cogroup(right.select(*names).groupBy(*group)).applyInArrow(meet, f"ka {kinds[0]}, kb {kinds[1]}, shared double")


def _unpacked(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes, all edges (rows ``x1, y1, x2, y2``), how many each area has, where they begin, and lengths of outlines."""
    e = t.column("e").combine_chunks()
    n = pc.list_value_length(e).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return [t.column(c).to_numpy() for c in ("lx", "hx", "ly", "hy")], e.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), n, np.cumsum(n) - n, t.column("round").to_numpy()


def _overlap_cut(a: DataFrame, a_key: str, b: DataFrame, b_key: str, cell: float, snap: float = SNAP) -> DataFrame:
    """``a_key, b_key, shared`` of areas of any number of edges.

    The outline of what is shared is made of the pieces of either outline
    inside the other area and of those that both have in the same direction;
    the area is the sum of what each piece adds.
    """
    both = edges(a, a_key).withColumn(b_key, F.lit(None).cast(b.schema[b_key].dataType)).unionByName(edges(b, b_key).withColumn(a_key, F.lit(None).cast(a.schema[a_key].dataType)))
    pieces = stored(undirected(noded(both, cell, snap=snap)))
    of_a, of_b = pieces.where(F.col(a_key).isNotNull()).drop(b_key), pieces.where(F.col(b_key).isNotNull()).drop(a_key)
    shared = stored(of_a.join(of_b.select(b_key, "a", "b", F.col("x1").alias("u"), F.col("y1").alias("v")), ["a", "b"]))
    on = shared.select(a_key, b_key, "a", "b")
    inner = [located(_middles(own), other, key, cell).join(on, [a_key, b_key, "a", "b"], "left_anti") for own, other, key in ((of_a, b, b_key), (of_b, a, a_key))]
    same = shared.where("x1 = u and y1 = v")
    parts = [p.select(a_key, b_key, *_XY) for p in (*inner, same)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(a_key, b_key).agg(F.expr(_AREA).alias("shared")).where(F.col("shared") > 0)


def _numbers(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers from ``lo`` to ``hi``: the rows' places, and the numbers."""
    n = np.maximum(hi - lo + 1, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _strip_parts(of: np.ndarray, xy: np.ndarray, high: float, off: float) -> tuple[np.ndarray, ...]:
    """What lies of edges in strips of height ``high``, ordered by area and strip: ``edge, strip, lo, hi`` along x; then ``area, strip, lo, hi`` of what lies strictly inside an area all over a strip's height."""
    x1, y1, x2, y2 = xy.T
    e, j = _numbers(np.floor((np.minimum(y1, y2) - off) / high).astype(np.int64), np.floor((np.maximum(y1, y2) + off) / high).astype(np.int64))
    a, b, c, d = x1[e], y1[e], x2[e], y2[e]
    flat = b == d
    ends = []
    for y in (j * high - off, (j + 1) * high + off):
        t = np.clip((y - b) / np.where(flat, 1.0, d - b), 0, 1)
        ends.append(a + t * (c - a))
    lo, hi = np.where(flat, np.minimum(a, c), np.minimum(*ends)) - off, np.where(flat, np.maximum(a, c), np.maximum(*ends)) + off
    order = np.lexsort((lo, j, of[e]))
    e, j, lo, hi = e[order], j[order], lo[order], hi[order]
    middle = (j + 0.5) * high
    spans = (y1[e] > middle) != (y2[e] > middle)
    first = np.ones(len(e), bool)
    first[1:] = (of[e][1:] != of[e][:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(first) - 1
    # the farthest end so far within a group: ends by their places in order, groups set apart, for one running maximum
    by = np.sort(hi)
    far = by[np.maximum.accumulate(np.searchsorted(by, hi) + group * len(by)) - group * len(by)]
    times = np.cumsum(spans)
    odd = (times - (times - spans)[np.flatnonzero(first)][group]) % 2 == 1
    gap = np.flatnonzero(odd[:-1] & ~first[1:] & (lo[1:] > far[:-1] + off))
    return e, j, lo, hi, of[e][gap], j[gap], far[gap] + off / 2, lo[gap + 1] - off / 2


def _unhidden(segments: DataFrame, key: str, keys: tuple[str, ...], cell: float, snap: float) -> DataFrame:
    """``segments(key, keys, x1, y1, x2, y2)`` without edges that lie wholly strictly inside areas of the same ``keys``, one or several.

    Such edges bound nothing of the union, and no part of its outline meets
    one. Looked for by strips of a 16th of a cell, in blocks of a cell along
    them; an edge of which this isn't sure stays. Areas of more than eight
    cells across hide none and none of theirs is looked for.
    """
    high, off = cell / 16, 16 * snap
    flat = stored(segments.withColumn("seg_", F.monotonically_increasing_id()))
    wide = F.greatest(*[F.max(F.greatest(f"{c}1", f"{c}2")) - F.min(F.least(f"{c}1", f"{c}2")) for c in "xy"])
    whole = flat.groupBy(key, *keys).agg(F.collect_list(F.struct("seg_", *_XY)).alias("e"), wide.alias("wide"))
    groups = [c for c in keys]
    schema = "".join(f"{k} {segments.schema[k].dataType.simpleString()}, " for k in groups) + "j long, i long, seg_ long, lo double, hi double"

    def parts(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            e = t.column("e").combine_chunks()
            n = pc.list_value_length(e).to_numpy(zero_copy_only=False).astype(np.int64)
            of, rows = np.repeat(np.arange(len(n)), n), e.flatten()
            seg, *xy = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("seg_", *_XY))
            if not len(of):
                continue
            ed, ej, elo, ehi, sa, sj, slo, shi = _strip_parts(of, np.stack(xy, 1), high, off)
            area, j = np.concatenate((of[ed], sa)), np.concatenate((ej, sj))
            lo, hi = np.concatenate((elo, slo)), np.concatenate((ehi, shi))
            who = np.concatenate((seg[ed], np.full(len(sa), -1)))
            at, i = _numbers(np.floor(lo / cell).astype(np.int64), np.floor(hi / cell).astype(np.int64))
            lo, hi = np.maximum(lo[at], i * cell), np.minimum(hi[at], (i + 1) * cell)
            for begin in range(0, len(at), 200_000):
                s = slice(begin, begin + 200_000)
                held = [t.column(k).take(pa.array(area[at[s]])) for k in groups]
                yield from pa.table([*held, *map(pa.array, (j[at[s]], i[s], who[at[s]], lo[s], hi[s]))], names=[*groups, "j", "i", "seg_", "lo", "hi"]).to_batches()

    def seen(t: pa.Table) -> pa.Table:
        who, lo, hi = (t.column(c).to_numpy() for c in ("seg_", "lo", "hi"))
        s = who < 0
        order = np.argsort(lo[s])
        a, far = lo[s][order], np.maximum.accumulate(hi[s][order])
        e = ~s
        if not len(a):
            return pa.table([pa.array(np.unique(who[e]))], names=["seg_"])
        new = np.concatenate(([True], a[1:] > far[:-1]))  # intervals that don't meet
        begins, ends = a[new], far[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]
        k = np.searchsorted(begins, lo[e], "right") - 1
        covered = (k >= 0) & (hi[e] <= ends[np.maximum(k, 0)])
        return pa.table([pa.array(np.unique(who[e][~covered]))], names=["seg_"])

    small = whole.where(F.col("wide") <= 8 * cell)
    found = small.select(*groups, "e").mapInArrow(parts, schema).groupBy(*groups, "j", "i").applyInArrow(seen, "seg_ long").distinct()
    large = whole.where(F.col("wide") > 8 * cell).select(F.explode("e.seg_").alias("seg_"))
    return flat.join(found.unionByName(large), "seg_", "left_semi").drop("seg_")


def union_edges(areas: DataFrame, key: str, *keys: str, cell: float, snap: float = SNAP) -> DataFrame:
    """``keys, x1, y1, x2, y2``: the outline of all areas of the same ``keys`` together, directed with the area on the left.

    Pieces with an area on either side, or inside another area, aren't part of it; pieces that several areas have are taken once.
    """
    pieces = stored(undirected(noded(_unhidden(edges(areas, key, *keys), key, keys, cell, snap), cell, keys, snap)))
    forth = (F.col("x1") == F.col("a.x")) & (F.col("y1") == F.col("a.y"))
    once = pieces.groupBy(*keys, "a", "b").agg(F.max(forth).alias("forth"), F.max(~forth).alias("back")).where("forth <> back")
    way = lambda p, q, c: F.when(F.col("forth"), F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}"))
    outer = stored(once.select(*keys, "a", "b", way("a", "b", "x").alias("x1"), way("a", "b", "y").alias("y1"), way("b", "a", "x").alias("x2"), way("b", "a", "y").alias("y2")))
    within = located(_middles(outer), areas, key, cell, keys).join(pieces.select(key, *keys, "a", "b"), [key, *keys, "a", "b"], "left_anti")
    return outer.join(within.select(*keys, "a", "b").distinct(), [*keys, "a", "b"], "left_anti").drop("a", "b")


# --- rings of directed pieces ------------------------------------------------------------------------


def traced(xy: np.ndarray) -> list[np.ndarray]:
    """The closed rings of one geometry's directed pieces (rows ``x1, y1, x2, y2``), the area on the left.

    At a corner where several pieces begin, the one farthest to the left goes
    on; a ring that comes back to a corner is parted there. Shells turn left,
    holes right. No ring passes a corner twice.
    """
    begin: dict[tuple, list[int]] = {}
    for i, (x, y) in enumerate(xy[:, :2].tolist()):
        begin.setdefault((x, y), []).append(i)
    way = np.arctan2(xy[:, 3] - xy[:, 1], xy[:, 2] - xy[:, 0])
    after = np.full(len(xy), -1)
    for i, (x, y) in enumerate(xy[:, 2:].tolist()):
        going = begin.get((x, y), [])
        if going:
            # the turn from straight back, clockwise: the first met is farthest to the left of the way on
            after[i] = min(going, key=lambda j: ((way[i] + np.pi - way[j]) % (2 * np.pi) or 2 * np.pi, j))
    rings, used = [], np.zeros(len(xy), bool)
    for i in range(len(xy)):
        path: list[tuple] = []
        place: dict[tuple, int] = {}
        while i >= 0 and not used[i]:
            used[i] = True
            here = tuple(xy[i, :2].tolist())
            if here in place:  # back at a corner: what lies between is a ring of its own
                rings.append(path[place[here] :])
                for p in path[place[here] :]:
                    del place[p]
                del path[len(path) - len(rings[-1]) :]
            place[here] = len(path)
            path.append(here)
            i = after[i]
        if len(path) > 2:
            rings.append(path)
    return [np.array([*r, r[0]]) for r in rings if len(r) > 2]


def signed_area(ring: np.ndarray) -> float:
    """Of a closed ring, positive if it turns left."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
    spans = (y1 > p[1]) != (y2 > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((spans & (p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1)).sum() % 2)


def _within(ring: np.ndarray) -> np.ndarray:
    """A point inside a ring."""
    ys = np.unique(ring[:, 1])
    k = min(max(int(np.searchsorted(ys, (ys[0] + ys[-1]) / 2)), 1), len(ys) - 1)
    y = (ys[k - 1] + ys[k]) / 2
    (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
    met = (y1 > y) != (y2 > y)
    xs = np.sort(x1[met] + (y - y1[met]) * (x2[met] - x1[met]) / (y2[met] - y1[met]))
    k = int(np.argmax(xs[1::2] - xs[::2]))
    return np.array([(xs[2 * k] + xs[2 * k + 1]) / 2, y])


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons, each its shell and its holes; a hole belongs to the smallest shell about it."""
    shells = sorted((r for r in rings if signed_area(r) > 0), key=lambda r: (signed_area(r), r.tolist()))
    out = [[s] for s in shells]
    for hole in (r for r in rings if signed_area(r) < 0):
        p = _within(hole)
        of = next((k for k, s in enumerate(shells) if _holds(s, p)), None)
        if of is not None:
            out[of].append(hole)
    return out


def even_odd(xy: np.ndarray) -> np.ndarray:
    """Of one geometry's noded pieces those that bound what an odd number of rings go round, directed with it on the left."""
    ends = np.where((xy[:, :2] > xy[:, 2:])[:, :1] | ((xy[:, :1] == xy[:, 2:3]) & (xy[:, 1:2] > xy[:, 3:])), xy[:, [2, 3, 0, 1]], xy)
    some, count = np.unique(ends, axis=0, return_counts=True)
    some = some[count % 2 == 1]
    x1, y1, x2, y2 = some.T
    out = []
    for k, (a, b, c, d) in enumerate(some):
        x, y = (a + c) / 2, (b + d) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            if a != c:  # pieces straight above the middle
                spans = (x1 > x) != (x2 > x)
                spans[k] = False
                beyond = (spans & (y1 + (x - x1) * (y2 - y1) / (x2 - x1) > y)).sum() % 2
                left = beyond == 1  # above is inside, and above is left of the way from a to c
            else:  # pieces right of the middle
                spans = (y1 > y) != (y2 > y)
                spans[k] = False
                left = (spans & (x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x)).sum() % 2 == 0
        out.append((a, b, c, d) if left else (c, d, a, b))
    return np.array(out).reshape(-1, 4)


_RINGS = "array<array<struct<x:double,y:double>>>"


def _as_points(ring: np.ndarray) -> list[dict[str, float]]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def _of(df: pd.DataFrame) -> np.ndarray:
    return df[list(_XY)].drop_duplicates().sort_values(list(_XY)).to_numpy(float)


def outlines_of(pieces: DataFrame, *keys: str) -> DataFrame:
    """``keys, polygons``: the directed pieces of each geometry as polygons, each an array of its shell and its holes."""
    schema = ", ".join(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in keys) + f", polygons array<{_RINGS}>"

    def trace(df: pd.DataFrame) -> pd.DataFrame:
        found = [[_as_points(r) for r in p] for p in polygons(traced(_of(df)))]
        return pd.DataFrame({**{k: df[k].iloc[:1].to_numpy() for k in keys}, "polygons": [found]})

    return pieces.select(*keys, *_XY).groupBy(*keys).applyInPandas(trace, schema)


def dissolved(areas: DataFrame, key: str, *keys: str, cell: float) -> DataFrame:
    """``keys, polygons``: all areas of the same ``keys`` as one."""
    return outlines_of(union_edges(areas, key, *keys, cell=cell), *keys)


# --- chains ------------------------------------------------------------------------------------------


def chains(lines: DataFrame) -> DataFrame:
    """``chain, a, b``: the distinct pieces of noded lines, told by the chain that they are part of.

    A chain goes from one corner where not just two pieces meet to the next, or round.
    """
    pieces = stored(undirected(lines).select("a", "b").distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = pieces.select("id", F.explode(F.array("a", "b")).alias("end"))
    pairs = ends.groupBy("end").agg(F.count("*").alias("n"), F.min("id").alias("u"), F.max("id").alias("v")).where("n = 2 and u <> v")
    of = connected_components(pairs.select("u", "v")).withColumnsRenamed({"node": "id", "component": "chain"})
    return stored(pieces.join(of, "id", "left").select(F.coalesce("chain", "id").alias("chain"), "a", "b"))


def path(xy: np.ndarray) -> np.ndarray:
    """The corners of one chain of pieces (rows ``x1, y1, x2, y2``) in order.

    From its smaller end; a chain that comes back to where it began starts at
    that corner, or at its smallest if no other chain meets it, and goes to
    the smaller neighbour first.
    """
    beside: dict[tuple, list[tuple]] = {}
    for a, b, c, d in xy.tolist():
        beside.setdefault((a, b), []).append((c, d))
        beside.setdefault((c, d), []).append((a, b))
    here = min([p for p, q in beside.items() if len(q) != 2] or beside)
    out = [here]
    while left := beside[here]:
        to = min(left)
        left.remove(to)
        beside[to].remove(here)
        out.append(here := to)
    return np.array(out)


def _pieces_of(df: pd.DataFrame) -> np.ndarray:
    return np.array([(a["x"], a["y"], b["x"], b["y"]) for a, b in zip(df["a"], df["b"], strict=True)], float)


# --- validity and repair -----------------------------------------------------------------------------


def ring_problems(areas: DataFrame, key: str, cell: float, snap: float = SNAP) -> DataFrame:
    """``key, problem``: what makes an area invalid, each problem once an area.

    ``areas(key, part, nr, ring)`` has ring 0 of each part as its shell, others
    as holes. 'not closed' rings and ones of fewer than four points aside,
    edges may only meet as neighbours do: 'crossing' edges, edges that run along
    each other ('overlap', spikes too) and rings that touch themselves ('self
    touch') are problems. Rings that touch each other in more than one point cut
    the inside apart ('touching twice'). Holes lie inside their shell and not in
    another hole ('hole outside', 'hole in hole'), parts not inside one another
    ('part in part').
    """
    # small rows make much work: they are dealt to all tasks first
    rows = stored(areas.select(key, "part", "nr", "ring").repartition(key).withColumn("id_", F.monotonically_increasing_id()))
    first, last = F.element_at("ring", 1), F.element_at("ring", -1)
    n = F.coalesce(F.size("ring"), F.lit(0))
    bad = F.when(n < 4, "too few points").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not closed")
    flat = rows.select(key, bad.alias("problem")).where("problem is not null")
    whole = rows.where(bad.isNull())
    step = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # a repeated corner is no edge; edges are numbered around the ring without it
    steps = whole.select(key, "id_", "part", F.filter(step, lambda e: e["a"] != e["b"]).alias("step"))
    edge = steps.select(key, "id_", F.size("step").alias("round"), F.posexplode("step").alias("at", "e"))
    a = stored(edge.select(key, "id_", "round", "at", F.struct("id_", "at").alias("seg"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")))
    b = a.select(key, F.col("id_").alias("id2"), F.col("at").alias("at2"), F.col("seg").alias("other"), *[F.col(c).alias(o) for c, o in zip(_XY, ("u1", "v1", "u2", "v2"), strict=True)])
    met = stored(contacts(a, b, cell, (key,), F.col("seg") < F.col("other"), snap))
    own = F.col("id_") == F.col("id2")
    beside = own & ((F.col("at2") - F.col("at") == 1) | ((F.col("at") == 0) & (F.col("at2") == F.col("round") - 1)))
    kind = F.when(F.col("kind") == "cross", "crossing").when(F.col("kind") == "overlap", "overlap").when(own & ~(beside & (F.col("kind") == "meet")), "self touch")
    crossed = met.select(key, kind.alias("problem")).where("problem is not null")
    # parts may touch each other in as many points as they like
    nr = rows.select(F.col("id_").alias("id2"), F.col("part").alias("part2"))
    between = met.where(~own & F.col("kind").isin("meet", "touch")).join(rows.select("id_", "part"), "id_").join(nr, "id2").where("part = part2").select(key, "id_", "id2", F.explode("points").alias("p")).distinct().groupBy(key, "id_", "id2").agg(F.count("*").alias("n")).where("n > 1")
    twice = between.select(key, F.lit("touching twice").alias("problem"))
    mated = whole.withColumn("n_", F.count("*").over(Window.partitionBy(key))).where("n_ > 1")
    inner = stored(with_point_inside(mated.select(key, "id_", "part", "nr", "ring", ring_area(F.col("ring")).alias("size")), "ring", "p"))
    mates = inner.select(key, F.col("id_").alias("id2"), F.col("part").alias("part2"), F.col("nr").alias("nr2"), F.col("ring").alias("ring2"), F.col("size").alias("size2"))
    held = inner.drop("ring").join(mates, key).where((F.col("id_") != F.col("id2")) & _inside(F.col("ring2"), F.col("p.x"), F.col("p.y")))
    same = F.col("part") == F.col("part2")
    about = held.groupBy(key, "id_", "part", "nr").agg(F.max(same & (F.col("nr2") == 0)).alias("shell"), F.max(same & (F.col("nr2") > 0)).alias("hole"))
    holes = whole.where("nr > 0").select(key, "id_").join(about.select("id_", "shell", "hole"), "id_", "left")
    hole_problem = F.explode(F.array_compact(F.array(F.when(~F.coalesce("shell", F.lit(False)), "hole outside"), F.when(F.coalesce("hole", F.lit(False)), "hole in hole"))))
    # inside a larger part's shell and in none of its holes: an island in a hole is no problem
    larger = F.max(F.when(F.col("nr2") == 0, F.col("size2") > F.col("size"))).alias("larger")
    others = held.where((F.col("nr") == 0) & ~same).groupBy(key, "id_", "part2").agg(F.count("*").alias("n"), larger).where("n % 2 = 1 and larger")
    nested = others.select(key, F.lit("part in part").alias("problem"))
    return flat.unionByName(crossed).unionByName(twice).unionByName(holes.select(key, hole_problem.alias("problem"))).unionByName(nested).distinct()


def check_areas(areas: DataFrame, key: str, cell: float, box: tuple[float, float, float, float], mode: str = "within", world: tuple[float, float, float, float] | None = None, examples: int = 5) -> DataFrame:
    """``problem, n, examples``: how many areas have each problem, the smallest keys as examples.

    Besides :func:`ring_problems`: 'missing' and 'empty' areas (no rings, or
    null ones), coordinates that are 'not finite' or outside ``world``, and
    areas that aren't 'within' the ``box``, or don't touch it if ``mode`` is
    'intersects'. Areas with other than finite coordinates are checked no further.
    """
    if mode not in ("within", "intersects"):
        raise ValueError(f"unknown mode: {mode}")
    rows = areas.withColumn("n_", F.size("ring"))
    value = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    spans = rows.withColumns({f"{n}_{c}": value(f, c) for n, f in (("lo", F.array_min), ("hi", F.array_max)) for c in "xy"})
    odd = F.exists("ring", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    of = stored(spans.groupBy(key).agg(F.max(F.col("ring").isNotNull()).alias("some"), F.max(F.col("n_") > 0).alias("filled"), F.max(F.coalesce(odd, F.lit(False))).alias("odd"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"]))
    inside = lambda w: (F.col("lo_x") >= w[0]) & (F.col("lo_y") >= w[1]) & (F.col("hi_x") <= w[2]) & (F.col("hi_y") <= w[3])
    meets = (F.col("hi_x") >= box[0]) & (F.col("hi_y") >= box[1]) & (F.col("lo_x") <= box[2]) & (F.col("lo_y") <= box[3])
    sound = F.col("some") & F.col("filled") & ~F.col("odd")
    rules = {"missing": ~F.col("some"), "empty": F.col("some") & ~F.col("filled"), "not finite": F.col("odd")}
    rules[f"not {mode} the box"] = sound & ~(inside(box) if mode == "within" else meets)
    if world:
        rules["outside the world"] = sound & ~inside(world)
    flat = of.select(key, F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))).alias("problem"))
    found = stored(flat.unionByName(ring_problems(areas.join(of.where(sound).select(key), key, "left_semi"), key, cell)))
    # examples are found by partial aggregation, whatever the number of rows of a problem
    least = found.groupBy("problem", F.pmod(F.xxhash64(key), F.lit(64)).alias("salt")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(key)), 1, examples).alias("e"))
    return least.groupBy("problem").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, examples).alias("examples"))


def repaired(areas: DataFrame, key: str, cell: float) -> DataFrame:
    """``key, repaired, polygons``: invalid areas made valid by the even-odd rule, valid ones as they are.

    An invalid area's edges are cut where they meet, pieces that lie on each
    other an even number of times vanish, and what is left is traced around
    every place that an odd number of rings go round. Nothing left gives null.
    """
    broken = stored(ring_problems(areas, key, cell).select(key).distinct())
    sound = areas.join(broken, key, "left_anti")
    per_part = sound.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "ring"))), lambda r: r["ring"]).alias("rings"))
    kept = per_part.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"]).alias("polygons")).withColumn("repaired", F.lit(False))
    closed = areas.join(broken, key, "left_semi").where(F.size("ring") > 2).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    pieces = noded(edges(closed, key), cell, (key,))

    def mend(df: pd.DataFrame) -> pd.DataFrame:
        found = [[_as_points(r) for r in p] for p in polygons(traced(even_odd(df[list(_XY)].to_numpy(float))))]
        return pd.DataFrame({key: df[key].iloc[:1].to_numpy(), "polygons": [found or None]})

    mended = pieces.groupBy(key).applyInPandas(mend, f"{key} {areas.schema[key].dataType.simpleString()}, polygons array<{_RINGS}>")
    return kept.unionByName(broken.join(mended, key, "left").withColumn("repaired", F.lit(True))).select(key, "repaired", "polygons")


# --- features that areas hold, circles and outlines --------------------------------------------------


def areas_of_segments(segments: DataFrame, key: str, areas: DataFrame, area_key: str, cell: float) -> DataFrame:
    """``key, area_key``: every area that a feature made of ``segments`` meets, by an end inside it or a contact with its outline, once."""
    lines = segments.select(key, *_XY)
    ends = lines.select(key, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(key, "p.x", "p.y").distinct()
    inside = located(ends, areas, area_key, cell).select(key, area_key)
    a = lines.withColumn("seg", F.col(key))
    b = edges(areas, area_key).select(F.col(area_key).alias("other"), *[F.col(c).alias(o) for c, o in zip(_XY, ("u1", "v1", "u2", "v2"), strict=True)])
    touched = contacts(a, b, cell).select(key, F.col("other").alias(area_key))
    return inside.unionByName(touched).distinct()


def circle_area(points: DataFrame, key: str, areas: DataFrame, area_key: str, radius: float, snap: float = SNAP) -> DataFrame:
    """``key, held``: the area of the circle about each point that lies within any of the areas.

    The sum over all edges of the areas' common outline of what the triangle of centre and edge shares with
    the circle. Edges out of reach only add their angles, which all edges
    together make a full turn if the centre is inside, else none; so only edges
    within ``radius`` are looked at. A centre on the outline is moved by 1e-7.
    """
    box, r2 = float(radius), float(radius) ** 2
    outline = union_edges(areas, area_key, cell=box, snap=snap)
    moved = points.select(key, (F.col("x") + 1.3e-7).alias("x"), (F.col("y") + 0.7e-7).alias("y"))
    inside = located(moved, areas, area_key, box).select(key, F.lit(1).alias("in_")).distinct()
    near = moved.withColumns({f"c{c}": F.floor(F.col(c) / box).cast("long") for c in "xy"})
    for c in "xy":
        near = near.withColumn("d_", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d_").cast("long")).drop("d_")
    pairs = near.join(in_cells(outline.select(*_XY), box), ["cx", "cy"]).drop("cx", "cy").distinct()
    px, py, qx, qy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    pairs = pairs.where(segment_distance(F.col("x"), F.col("y"), *map(F.col, _XY)) < radius).select(key, px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"))
    angle = lambda ax, ay, bx, by: F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    dx, dy = qx - px, qy - py
    a, b, c = dx * dx + dy * dy, px * dx + py * dy, px * px + py * py - r2
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - a * c))
    enter, leave = F.greatest(F.lit(0.0), (-b - root) / a), F.least(F.lit(1.0), (-b + root) / a)
    at = lambda t: (px + dx * t, py + dy * t)
    (ex, ey), (lx, ly) = at(enter), at(leave)
    within = (ex * ly - ey * lx) / 2 + r2 / 2 * (F.when(enter > 0, angle(px, py, ex, ey)).otherwise(0.0) + F.when(leave < 1, angle(lx, ly, qx, qy)).otherwise(0.0))
    adds = within - r2 / 2 * angle(px, py, qx, qy)
    sums = pairs.groupBy(key).agg(F.sum(adds).alias("near"))
    full = F.lit(np.pi * r2)
    out = points.select(key).join(sums, key, "left").join(inside, key, "left")
    return out.select(key, (F.coalesce("near", F.lit(0.0)) + F.when(F.col("in_").isNotNull(), full).otherwise(0.0)).alias("held"))
