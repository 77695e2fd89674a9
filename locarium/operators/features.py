"""Per-candidate features by distance joins, in production and backtest mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locarium.functions.tags import selects
from locarium.operators import arrangement, spatial
from locarium.operators.graph import connected_components
from locarium.operators.hosts import selects_any
from locarium.settings import Settings
from locarium.storage import stored


def production_chargers(chargers: DataFrame) -> DataFrame:
    """Chargers open to the public."""
    return chargers.where(~F.coalesce(F.col("access").isin("private", "no"), F.lit(False)))


def backtest_chargers(chargers: DataFrame) -> DataFrame:
    """No charger at all, with the same columns; nothing is read."""
    return chargers.limit(0)


def _chained(points: DataFrame, radius: float) -> DataFrame:
    """``node, component``: points with coordinates chained at most ``radius`` apart; the smallest id of a chain names it.

    Cells of a quarter of the radius whose farthest points are within it are
    linked as wholes; only points of cells that this leaves in different
    groups are compared, so that dense places form no pairs.
    """
    size = radius / 4 or 1.0
    at = {"gx": F.floor(F.col("x") / size).cast("long"), "gy": F.floor(F.col("y") / size).cast("long")}
    placed = stored(points.where("charger_id is not null and abs(x) < double('infinity') and abs(y) < double('infinity')").withColumns(at))
    ends = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = stored(placed.groupBy("gx", "gy").agg(F.min("charger_id").alias("id"), *ends))
    steps = F.sequence(F.lit(-5), F.lit(5))
    shifted = cells.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), F.col("id").alias("other"), *[F.col(f"{n}{c}").alias(f"{n}{c}2") for c in "xy" for n in ("lo", "hi")])
    near = cells.join(shifted, ["gx", "gy"])
    far = lambda c: F.greatest(F.abs(F.col(f"hi{c}") - F.col(f"lo{c}2")), F.abs(F.col(f"hi{c}2") - F.col(f"lo{c}")))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(f"hi{c}2"), F.col(f"lo{c}2") - F.col(f"hi{c}"))
    sure = F.sqrt(far("x") * far("x") + far("y") * far("y")) <= radius
    both = stored(near.where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= radius).select("id", "other", sure.alias("sure")))
    held = placed.join(cells.select("gx", "gy", "id"), ["gx", "gy"]).groupBy("charger_id").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    twice = held.select(F.array_min("ids").alias("u"), F.explode("ids").alias("v"))  # an id of several places joins them
    groups = connected_components(both.where("sure and id < other").select(F.col("id").alias("u"), F.col("other").alias("v")).unionByName(twice))
    known = stored(cells.select("gx", "gy", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"))
    of = known.select("id", "group")
    ways = both.where("not sure").join(of, "id").join(of.select(F.col("id").alias("other"), F.col("group").alias("group2")), "other")
    touched = ways.where("group <> group2").select("id").distinct()
    some = placed.join(known, ["gx", "gy"])
    open_ = stored(some.join(touched, "id", "left_semi").select("charger_id", "group", "x", "y"))
    a, b = (open_.select(F.col("charger_id").alias(n), F.col("group").alias(f"{n}g"), "x", "y") for n in "uv")
    links = spatial.pairs_within(a, b, radius).where("u < v and ug <> vg").select(F.col("ug").alias("u"), F.col("vg").alias("v")).distinct()
    merged = connected_components(links).withColumnRenamed("node", "group")
    return some.join(merged, "group", "left").select(F.col("charger_id").alias("node"), F.coalesce("component", "group").alias("component")).distinct()


def merge_chargers(chargers: DataFrame, radius: float) -> DataFrame:
    """``charger_id, site_id, x, y``: chargers chained at most ``radius`` apart (inclusive) form one site.

    The site's id and place are those of the member that comes first by
    ``source_rank``, then id. Merging is transitive, unlike deduplication.
    """
    parts = _chained(chargers.select("charger_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), radius)
    named = chargers.join(parts.withColumnRenamed("node", "charger_id"), "charger_id", "left").withColumn("component", F.coalesce("component", "charger_id"))
    first = named.groupBy("component").agg(F.min(F.struct("source_rank", "charger_id", "x", "y")).alias("f"))
    return named.select("charger_id", "component").join(first, "component").select("charger_id", F.col("f.charger_id").alias("site_id"), F.col("f.x").alias("x"), F.col("f.y").alias("y"))


#: Where known chargers come from; of a merged site the record of the first source stands for it.
CHARGER_SOURCES = ("charging_stations", "fuel_with_sockets", "manual")


def known_chargers(stations: DataFrame, places: DataFrame, manual: DataFrame | None, fuel: tuple[str, ...], radius: float, sockets_count: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(source, record_id, site_id, x, y)`` of every known charger with its site, and a row of figures per source.

    ``stations(id, access, x, y)`` count unless private; so do ``places(id,
    tags, x, y)`` of a fuel selector with socket tags, if ``sockets_count``,
    and all ``manual(id, x, y)`` rows, or none where that is missing. Records
    at most ``radius`` apart, one to the next, are one site; ``site_id`` is its
    first record's, by source, then id as text: the source's number, a slash, the id. The figures are ``records``,
    ``excluded`` (by access, or not counted), ``sites`` that the source leads,
    ``merged`` records that another leads, and ``status`` ('missing' or 'ok').
    A record without a place is a site of its own; repeated rows are one.
    """
    spark = stations.sparkSession
    text = lambda df: df.select(F.col("id").cast("string").alias("id"), "x", "y", *(c for c in ("access", "counts") if c in df.columns))
    tags = F.col("tags")
    sockets = places.where(selects_any(tags, fuel) & selects(tags, "socket:*")).withColumn("counts", F.lit(sockets_count))
    open_ = stations.withColumn("counts", ~F.coalesce(F.col("access").isin("private", "no"), F.lit(False)))
    parts = [text(open_), text(sockets)] + ([text(manual.withColumn("counts", F.lit(True)))] if manual is not None else [])
    rows = None
    for rank, (source, part) in enumerate(zip(CHARGER_SOURCES, parts, strict=False)):
        one = part.where("id is not null").select(F.lit(source).alias("source"), F.lit(rank).alias("source_rank"), "id", F.concat(F.lit(f"{rank}/"), "id").alias("charger_id"), "x", "y", "counts")
        rows = one if rows is None else rows.unionByName(one)
    first = stored(rows.groupBy("charger_id").agg(F.min(F.struct("source", "source_rank", "id", F.col("counts"), "x", "y")).alias("f")).select("charger_id", "f.*"))
    merged = stored(merge_chargers(first.where("counts").drop("counts"), radius))
    of = first.where("counts").select("charger_id", "source", "id").join(merged, "charger_id")
    records = of.select("source", F.col("id").alias("record_id"), "charger_id", "site_id", "x", "y")
    leads = records.select("charger_id", (F.col("charger_id") == F.col("site_id")).alias("leads"))
    counts = first.join(leads, "charger_id", "left").groupBy("source").agg(F.count("*").alias("records"), F.count_if(~F.col("counts")).alias("excluded"), F.count_if("leads").alias("sites"), F.count_if(~F.col("leads")).alias("merged"))
    names = spark.createDataFrame([(s, "missing" if i >= len(parts) else "ok") for i, s in enumerate(CHARGER_SOURCES)], "source string, status string")
    zero = F.lit(0).cast("long")
    figures = names.join(counts, "source", "left").select("source", *[F.coalesce(c, zero).alias(c) for c in ("records", "excluded", "sites", "merged")], "status")
    return records.select("source", "record_id", "site_id", "x", "y"), figures


def poi_counts(candidates: DataFrame, pois: DataFrame, radii: tuple[float, float], kinds: tuple[str, ...] = ()) -> DataFrame:
    """POIs within two radii, in all and by kind; a candidate's own host doesn't count.

    All POIs are counted by discs, and the own host, found by its id, is taken off.
    """
    names = ["poi_1km", "poi_3km", *[f"poi_{k}_{r}" for k in kinds for r in ("1km", "3km")]]
    flags = ["every", *[f"is_{i}" for i in range(len(kinds))]]
    at = [(r, f) for f in flags for r in (0, 1)]  # radius and flag of each name
    known = pois.select("poi_id", "x", "y", F.lit(1).alias("every"), *[F.coalesce((F.col("kind") == k).cast("int"), F.lit(0)).alias(f"is_{i}") for i, k in enumerate(kinds)])
    sums = lambda points, sources: spatial.disc_sums(points, sources, "candidate_id", flags, list(radii)).select("candidate_id", *[F.col(f"s{r * len(flags) + flags.index(f)}").alias(n) for n, (r, f) in zip(names, at, strict=True)])
    counts = sums(candidates, known.where("poi_id is not null"))
    nameless = known.where("poi_id is null")  # the same as a host that isn't known
    if not nameless.isEmpty():
        counts = counts.unionByName(sums(candidates.where("host_poi_id is not null"), nameless))
    mine = candidates.where("host_poi_id is not null").select("candidate_id", F.col("host_poi_id").alias("poi_id"), F.col("x").alias("cx"), F.col("y").alias("cy")).join(known, "poi_id")
    d = spatial.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    own = mine.select("candidate_id", *[F.when(d <= radii[r], -F.col(f)).otherwise(0).cast("long").alias(n) for n, (r, f) in zip(names, at, strict=True)])
    total = counts.unionByName(own).groupBy("candidate_id").agg(*[F.sum(n).alias(n) for n in names])
    out = candidates.select("candidate_id").join(total, "candidate_id", "left")
    return out.select("candidate_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def completeness(power: DataFrame, districts: DataFrame, cell: float) -> DataFrame:
    """``district_id, features, density, grid_completeness_ratio``: mapped power features per area over the national median.

    ``power`` has segments (``power_id, x1, y1, x2, y2``; a point's ends are
    one), ``districts`` rings. A feature counts once in every district that any
    part of it meets, outline included. Districts without any count as 0 in the
    median. A median of 0 is an error.
    """
    counted = power.where(F.col("power").isin("substation", "line", "pole"))
    met = arrangement.areas_of_segments(counted, "power_id", districts, "district_id", cell).groupBy("district_id").agg(F.count("*").alias("features"))
    table = stored(districts.select("district_id", "area_km2").join(met, "district_id", "left").withColumn("features", F.coalesce("features", F.lit(0).cast("long"))).withColumn("density", F.col("features") / F.col("area_km2")))
    middle = table.agg(F.median("density")).first()[0]
    if not middle:
        raise ValueError("the median density of power features is 0; no ratio can be taken")
    return table.withColumn("grid_completeness_ratio", F.col("density") / F.lit(middle)).drop("area_km2")


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    """``key`` and the columns of all ``parts``, tables of numbers with at most one row a key; null where a part has none.

    Parts lie below each other and are gathered by one aggregate: joined one
    after another, each join sorts both its sides in the same task, and all
    these sorters hold memory at once.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in rows.columns if c != key])


def build(layers: dict[str, DataFrame], cfg: Settings, backtest: bool = False) -> DataFrame:
    """The feature table of one mode.

    Backtest mode is built from inputs without any charger: distances to
    chargers are null and their counts 0.
    """
    cand = layers["candidates"]
    key = "candidate_id"
    chargers = backtest_chargers(layers["chargers"]) if backtest else production_chargers(layers["chargers"])
    pop = spatial.sum_within(cand, layers["pixels"], key, "people", dict(zip(("pop_1km", "pop_5km", "pop_10km"), cfg.population_m, strict=True)))
    poi = poi_counts(cand, layers["pois"], cfg.poi_m)
    near = spatial.nearest(cand, chargers, key, "charger_id", 2 * cfg.start_m).select(key, F.col("dist").alias("dist_charger_m"))
    counts = spatial.count_within(cand, chargers, key, dict(zip(("chargers_10km", "chargers_25km"), cfg.chargers_m, strict=True)))
    parts = [pop, poi, near, counts]
    power = layers["power"]
    for kind in ("substation", "line"):
        d = spatial.nearest(cand, power.where(F.col("power") == kind), key, "power_id", cfg.start_m).select(key, F.col("dist").alias(f"dist_{kind}_m"))
        parts.append(d)
    for name, places in (("centre", layers["places"].where("place = 'city'")), ("town", layers["places"].where("place = 'town'"))):
        parts.append(spatial.nearest(cand, places, key, "place_id", 8 * cfg.start_m).select(key, F.col("dist").alias(f"dist_{name}_m")))
    roads = layers["roads"]
    road = spatial.nearest_segment(cand, roads, key, "road_id", 3 * cfg.start_m, keep=("road_class",)).select(key, F.col("dist").alias("dist_road_m"), "road_class")
    parts.append(spatial.nearest_segment(cand, roads.where("road_class = 'trunk'"), key, "road_id", 3 * cfg.start_m).select(key, F.col("dist").alias("dist_trunk_m")))
    out = cand.join(side_by_side(parts, key), key)
    ratio = completeness(power, layers["districts"], cfg.start_m).select("district_id", "grid_completeness_ratio")
    made = out.join(road, key).join(ratio, "district_id", "left")
    order = [*cand.columns, *(c for p in parts[:-1] for c in p.columns if c != key), "dist_road_m", "road_class", "dist_trunk_m", "grid_completeness_ratio"]
    return made.select("district_id", *(c for c in order if c != "district_id"))
