"""Queries of places, areas, briefs, network studies and corpus checks over the derived world, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium.operators import answers, areas, arrangement, briefs, features, hosts, network, retrieval, spatial, validation
from locarium.plans import site_queries as sites
from locarium.plans import world
from locarium.settings import COMPONENTS, PROFILES, UNKNOWNS
from locarium.settings import WORLD as W
from locarium.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- places by tags -----------------------------------------------------------------------------

_HOST_TAGS = {"fuel": ("amenity=fuel",), "mall": ("shop=mall",), "supermarket": ("shop=supermarket",), "logistics": ("industrial=*",), "industrial": ("landuse=industrial",), "hotel": ("tourism=hotel", "tourism=motel")}


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Customers as places with tags of several keys, so that many are of several types."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    tag = lambda w, key, v: F.when(w, F.struct(F.lit(key).alias("key"), F.lit(v).alias("value")))
    tags = F.array_compact(
        F.array(
            tag(F.col("c_mktsegment") == "AUTOMOBILE", "amenity", "fuel"), tag(k % 3 == 0, "shop", "mall"), tag(k % 3 == 1, "shop", "supermarket"), tag(k % 5 == 0, "industrial", "depot"),
            tag(F.col("c_mktsegment") == "MACHINERY", "landuse", "industrial"), tag(k % 4 == 0, "tourism", "motel"), tag(k % 7 == 0, "socket:type2", "2"), tag(k % 13 == 0, "disused", "yes"),
        )
    )
    return c.select(k.alias("poi_id"), F.map_from_entries(tags).alias("tags"))


@query("SELECT c_custkey AS poi_id, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'fuel' WHEN c_custkey % 3 = 0 THEN 'mall' WHEN c_custkey % 3 = 1 THEN 'supermarket' WHEN c_custkey % 5 = 0 THEN 'logistics' WHEN c_mktsegment = 'MACHINERY' THEN 'industrial' WHEN c_custkey % 4 = 0 THEN 'hotel' END AS host_type FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') OR c_custkey % 3 < 2 OR c_custkey % 5 = 0 OR c_custkey % 4 = 0")
def p05_host_classes(spark: SparkSession, d: str) -> DataFrame:
    return hosts.classify_hosts(_tagged(spark, d), _HOST_TAGS).select("poi_id", "host_type")


_KNOWN = f"""WITH RECURSIVE {world.sql("chargers", "pois", "places")},
    rows_ AS (SELECT 'charging_stations' AS source, 0 AS n, CAST(charger_id AS VARCHAR) AS id, x, y, access <> 'private' AS counts FROM chargers
        UNION ALL SELECT 'fuel_with_sockets', 1, CAST(poi_id AS VARCHAR), x, y, true FROM pois WHERE kind = 'fuel' AND poi_id % 7 = 0
        UNION ALL SELECT 'manual', 2, CAST(place_id AS VARCHAR), x, y, true FROM places),
    records AS (SELECT *, n || '/' || id AS charger_id FROM rows_),
    edges AS MATERIALIZED (SELECT a.charger_id AS u, b.charger_id AS v FROM records a JOIN records b ON abs(a.x - b.x) <= 1500 AND abs(a.y - b.y) <= 1500 WHERE a.counts AND b.counts AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1500),
    reach AS (SELECT charger_id AS m, charger_id AS r FROM records WHERE counts UNION SELECT e.u, r.r FROM reach r JOIN edges e ON e.v = r.m),
    sites AS (SELECT m AS charger_id, min(r) AS site_id FROM reach GROUP BY 1)
"""


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chargers, fuel stations with sockets, and the places as rows that were added by hand."""
    at = world.layer(spark, d, "pois").select(F.col("poi_id").alias("id"), "x", "y")
    places = _tagged(spark, d).withColumnRenamed("poi_id", "id").join(at, "id")
    stations, manual = world.layer(spark, d, "chargers").withColumnRenamed("charger_id", "id"), world.layer(spark, d, "places").withColumnRenamed("place_id", "id")
    return features.known_chargers(stations, places, manual, ("amenity=fuel",), 1500)


@query(_KNOWN + "SELECT source, id AS record_id, site_id FROM records JOIN sites USING (charger_id)")
def h02_known_chargers(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d)[0].select("source", "record_id", "site_id")


@query(_KNOWN + "SELECT source, count(*) AS records, CAST(count_if(NOT counts) AS BIGINT) AS excluded, CAST(count_if(charger_id = site_id) AS BIGINT) AS sites, CAST(count_if(charger_id <> site_id) AS BIGINT) AS merged, 'ok' AS status FROM records LEFT JOIN sites USING (charger_id) GROUP BY 1")
def h02_charger_sources(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d)[1]


@query("SELECT * FROM (SELECT c_custkey AS poi_id, c_mktsegment = 'AUTOMOBILE' AS fuel, c_custkey % 3 < 2 AS shop, c_custkey % 4 = 0 AS lodging FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)) WHERE fuel OR shop OR lodging")
def p06_place_classes(spark: SparkSession, d: str) -> DataFrame:
    removed = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("poi_id"))
    return hosts.classify_places(_tagged(spark, d), "poi_id", {"fuel": ("amenity=fuel",), "shop": ("shop=*",), "lodging": ("tourism=hotel", "tourism=motel")}, ("disused=yes",), removed)


@query("SELECT s_suppkey AS poi_id FROM supplier UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_custkey % 7 = 0")
def h01_charger_objects(spark: SparkSession, d: str) -> DataFrame:
    stations = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("poi_id"))
    return hosts.charger_objects(stations, _tagged(spark, d), "poi_id")


@query(f"WITH {world.sql('candidates', 'districts')} SELECT candidate_id, CASE host_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in hosts.HOST_LABELS.items()) + " END || ', ' || district AS label FROM candidates JOIN districts USING (district_id)")
def p13_host_labels(spark: SparkSession, d: str) -> DataFrame:
    cand, districts = (world.layer(spark, d, n) for n in ("candidates", "districts"))
    return cand.join(districts, "district_id").select("candidate_id", hosts.host_label(F.col("host_type"), F.col("district")).alias("label"))


def _triangles(districts: DataFrame) -> DataFrame:
    """A right triangle in each district's corner; the heights differ."""
    corner = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    high = (F.col("district_id") % 3 + 1) * F.lit(1000.0)
    a = corner(F.lit(0.0), F.lit(0.0))
    return districts.select("district_id", "province_id", "province", F.array(a, corner(F.lit(9000.0), F.lit(0.0)), corner(F.lit(0.0), high), a).alias("ring"))


@query(f"WITH {world.sql('districts')} SELECT district_id, x0 + 2250.0 AS x, y0 + (district_id % 3 + 1) * 500.0 AS y FROM districts")
def p04_points_inside(spark: SparkSession, d: str) -> DataFrame:
    p = hosts.point_inside(F.col("ring"))
    return _triangles(world.layer(spark, d, "districts")).select("district_id", p["x"].alias("x"), p["y"].alias("y"))


_BORDER = "(-1, 0.0, 0.0, 50025.0, 0.0), (-2, 50025.0, 0.0, 50025.0, 50025.0), (-3, 0.0, 50025.0, 50025.0, 50025.0), (-4, 0.0, 0.0, 0.0, 50025.0)"


def _off(p: str, s: str) -> str:
    """Distance of the point ``p`` (two columns) from the segment ``s``."""
    x, y = p.split()
    t = f"greatest(0, least(1, (({x} - {s}.x1) * ({s}.x2 - {s}.x1) + ({y} - {s}.y1) * ({s}.y2 - {s}.y1)) / (pow({s}.x2 - {s}.x1, 2) + pow({s}.y2 - {s}.y1, 2))))"
    return f"sqrt(pow({x} - {s}.x1 - {t} * ({s}.x2 - {s}.x1), 2) + pow({y} - {s}.y1 - {t} * ({s}.y2 - {s}.y1), 2))"


_BOXES = "least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)"
_DET = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
_CHAINS = f"""WITH RECURSIVE {world.sql("streets")}, segs AS (SELECT street_id AS id, x1, y1, x2, y2 FROM streets WHERE road_class <> 'residential' AND (x1 <> x2 OR y1 <> y2) UNION ALL SELECT * FROM (VALUES {_BORDER})),
    touched AS (SELECT a.id, unnest([struct_pack(x := b.x1, y := b.y1, d := {_off("b.x1 b.y1", "a")}), struct_pack(x := b.x2, y := b.y2, d := {_off("b.x2 b.y2", "a")})]) AS p FROM segs a JOIN segs b ON a.id <> b.id AND {_BOXES}),
    crossed AS (SELECT a.id AS i, b.id AS j, a.x1, a.y1, a.x2, a.y2, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / {_DET} AS t, ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / {_DET} AS u FROM segs a JOIN segs b ON a.id < b.id AND {_BOXES} AND {_DET} <> 0
        WHERE least({_off("b.x1 b.y1", "a")}, {_off("b.x2 b.y2", "a")}, {_off("a.x1 a.y1", "b")}, {_off("a.x2 a.y2", "b")}) > 2e-6),
    met AS (SELECT unnest([i, j]) AS id, round((x1 + t * (x2 - x1)) / 1e-6) * 1e-6 AS x, round((y1 + t * (y2 - y1)) / 1e-6) * 1e-6 AS y FROM crossed WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
    cuts AS (SELECT id, p.x AS x, p.y AS y FROM touched WHERE p.d <= 2e-6 UNION SELECT id, x, y FROM met UNION SELECT id, x1, y1 FROM segs UNION SELECT id, x2, y2 FROM segs),
    pieces AS (SELECT id, struct_pack(x := x, y := y) AS p, lead(struct_pack(x := x, y := y)) OVER (PARTITION BY id ORDER BY (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) AS q FROM cuts JOIN segs USING (id)),
    used AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM pieces WHERE id > 0 AND q IS NOT NULL AND p.x + q.x BETWEEN 0 AND 100050 AND p.y + q.y BETWEEN 0 AND 100050),
    half AS (SELECT a AS n, b AS m FROM used UNION ALL SELECT b, a FROM used), degree AS (SELECT n, count(*) AS k FROM half GROUP BY 1),
    walk AS (SELECT [h.n, h.m] AS p FROM half h JOIN degree d ON d.n = h.n AND d.k <> 2 UNION ALL SELECT list_append(w.p, h.m) FROM walk w JOIN degree d ON d.n = w.p[-1] AND d.k = 2 JOIN half h ON h.n = w.p[-1] AND h.m <> w.p[-2]),
    chains AS (SELECT w.p, row_number() OVER (ORDER BY w.p) AS c FROM walk w JOIN degree d ON d.n = w.p[-1] AND d.k <> 2 WHERE w.p[1] < w.p[-1] OR (w.p[1] = w.p[-1] AND w.p[2] < w.p[-2])),
    steps AS (SELECT c, i, p[i] AS a, p[i + 1] AS b, sqrt(pow(p[i + 1].x - p[i].x, 2) + pow(p[i + 1].y - p[i].y, 2)) AS size FROM chains, unnest(range(1, len(p))) r(i)),
    placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY c) AS length FROM steps),
    marks AS (SELECT c, unnest(generate_series(1, CAST(floor(length / 400 + 0.5) AS BIGINT))) AS nth FROM (SELECT c, max(length) AS length FROM placed GROUP BY 1))
    SELECT round(chains.p[1].x, 3) AS from_x, round(chains.p[1].y, 3) AS from_y, round(chains.p[-1].x, 3) AS to_x, round(chains.p[-1].y, 3) AS to_y, nth, round(a.x + (b.x - a.x) * ((nth - 0.5) * 400 - before) / size, 3) AS x, round(a.y + (b.y - a.y) * ((nth - 0.5) * 400 - before) / size, 3) AS y
    FROM marks JOIN placed ON placed.c = marks.c AND (nth - 0.5) * 400 > before AND (nth - 0.5) * 400 <= before + size JOIN chains ON chains.c = marks.c"""


@query(_CHAINS)
def g01_corridor_points(spark: SparkSession, d: str) -> DataFrame:
    """Streets that cross, touch and run along each other, within the outline of all districts; points every 400 m."""
    streets, districts = (world.layer(spark, d, n) for n in ("streets", "districts"))
    out = hosts.corridor_points(streets, ("trunk", "primary"), 400, 2000, sites._rings(districts), "district_id")
    at = lambda c, name: F.round(c, 3).alias(name)
    return out.select(at("from.x", "from_x"), at("from.y", "from_y"), at("to.x", "to_x"), at("to.y", "to_y"), "nth", at("x", "x"), at("y", "y"))


# --- areas ----------------------------------------------------------------------------------------


def _halves(spark: SparkSession) -> DataFrame:
    """Two areas that cut the world at x = 24,000."""
    ring = lambda a, b: [{"x": x, "y": y} for x, y in ((a, 0.0), (b, 0.0), (b, 60000.0), (a, 60000.0), (a, 0.0))]
    return spark.createDataFrame([(1, ring(0.0, 24000.0)), (2, ring(24000.0, 60000.0))], "half_id long, ring array<struct<x:double,y:double>>")


@query(f"WITH {world.sql('districts')}, parts AS (SELECT district_id, greatest(0, least(24000.0, x0 + 10005) - x0) / 10005 AS west FROM districts) SELECT district_id, CASE WHEN west > 0.5 THEN CAST(1 AS BIGINT) ELSE 2 END AS half_id, round(greatest(west, 1 - west), 9) AS share FROM parts")
def j10_overlap(spark: SparkSession, d: str) -> DataFrame:
    districts = sites._rings(world.layer(spark, d, "districts"))
    return areas.assign_by_overlap(districts, "district_id", _halves(spark), "half_id", 10005).withColumn("share", F.round("share", 9))


@query(f"""WITH {world.sql('districts')}, corners AS (SELECT province_id, province, x0, y0, x0 + 10005 AS x1, y0 + 10005 AS y1 FROM districts),
    edges AS (SELECT province_id, x0 AS a, y0 AS b, x1 AS c, y0 AS d FROM corners UNION ALL SELECT province_id, x0, y1, x1, y1 FROM corners UNION ALL SELECT province_id, x0, y0, x0, y1 FROM corners UNION ALL SELECT province_id, x1, y0, x1, y1 FROM corners),
    single AS (SELECT province_id FROM edges GROUP BY province_id, a, b, c, d HAVING count(*) % 2 = 1)
    SELECT province_id, province, count(*) AS n, CAST(sum(10005.0 * 10005.0) AS DOUBLE) AS area, (SELECT CAST(10005.0 * count(*) AS DOUBLE) FROM single s WHERE s.province_id = corners.province_id) AS boundary, (SELECT count(*) FROM single s WHERE s.province_id = corners.province_id) AS edges FROM corners GROUP BY 1, 2""")
def a13_dissolve(spark: SparkSession, d: str) -> DataFrame:
    return areas.dissolve(sites._rings(world.layer(spark, d, "districts")), "district_id", "province_id", "province", cell=10005)


def _els(plots: DataFrame) -> DataFrame:
    """Plots as Ls: a box of w x h without what lies beyond a and b."""
    at = lambda *v: F.struct(*[(F.col(c) + (F.col(o) if o else F.lit(0.0))).alias(c) for c, o in zip("xy", v, strict=True)])
    return plots.withColumn("ring", F.array(at("", ""), at("w", ""), at("w", "b"), at("a", "b"), at("a", "h"), at("", "h"), at("", "")))


_BARS = "bars AS (SELECT plot_id, zone, x, y, x + w AS u, y + b AS v FROM plots UNION ALL SELECT plot_id, zone, x, y + b, x + a, y + h FROM plots)"


@query(f"WITH {world.sql('plots')}, {_BARS} SELECT a.plot_id, b.plot_id AS other_id, sum(greatest(0, least(a.u, b.u) - greatest(a.x, b.x)) * greatest(0, least(a.v, b.v) - greatest(a.y, b.y))) AS shared FROM bars a JOIN bars b ON a.plot_id < b.plot_id AND a.u > b.x AND b.u > a.x AND a.v > b.y AND b.v > a.y GROUP BY 1, 2")
def j10_plot_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Concave plots whose outlines cross and run along each other."""
    plots = _els(world.layer(spark, d, "plots"))
    shared = arrangement.overlap_areas(plots, "plot_id", plots.withColumnRenamed("plot_id", "other_id"), "other_id", 1000, less=True)
    return shared.withColumn("shared", F.round("shared", 3))


@query(
    f"WITH {world.sql('plots')}, {_BARS}, tiles AS (SELECT DISTINCT zone, i, j FROM bars, unnest(generate_series(CAST(x / 100 AS BIGINT), CAST(u / 100 AS BIGINT) - 1)) a(i), unnest(generate_series(CAST(y / 100 AS BIGINT), CAST(v / 100 AS BIGINT) - 1)) b(j)), "
    "sides AS (SELECT zone, i, j, k FROM tiles, unnest([[1, 0], [-1, 0], [0, 1], [0, -1]]) s(k)), open AS (SELECT zone, count(*) AS n FROM sides s WHERE NOT EXISTS (SELECT 1 FROM tiles t WHERE t.zone = s.zone AND t.i = s.i + s.k[1] AND t.j = s.j + s.k[2]) GROUP BY 1) "
    "SELECT zone, (SELECT count(*) FROM plots p WHERE p.zone = t.zone) AS n, count(*) * 10000.0::DOUBLE AS area, any_value(open.n) * 100.0::DOUBLE AS boundary FROM tiles t JOIN open USING (zone) GROUP BY 1"
)
def a13_zone_union(spark: SparkSession, d: str) -> DataFrame:
    """Plots of a zone overlap, and share parts of their edges."""
    out = areas.dissolve(_els(world.layer(spark, d, "plots")), "plot_id", "zone", cell=1000)
    return out.select("zone", "n", F.round("area", 2).alias("area"), F.round("boundary", 2).alias("boundary"))


_ANGLE = "atan2({a}x * {b}y - {a}y * {b}x, {a}x * {b}x + {a}y * {b}y)"
_HELD = f"""corners AS (SELECT unnest([0.0, 50025.0, 50025.0, 0.0])::DOUBLE AS px, unnest([0.0, 0.0, 50025.0, 50025.0])::DOUBLE AS py, unnest([50025.0, 50025.0, 0.0, 0.0])::DOUBLE AS qx, unnest([0.0, 50025.0, 50025.0, 0.0])::DOUBLE AS qy),
    sides AS (SELECT candidate_id, px - x AS px, py - y AS py, qx - x AS qx, qy - y AS qy, qx - px AS dx, qy - py AS dy FROM candidates, corners),
    solved AS (SELECT *, dx * dx + dy * dy AS a, px * dx + py * dy AS b, px * px + py * py - 9e6 AS c FROM sides),
    spans AS (SELECT *, b * b - a * c > 0 AS meets, greatest(0, (-b - sqrt(greatest(0, b * b - a * c))) / a) AS t, least(1, (-b + sqrt(greatest(0, b * b - a * c))) / a) AS u FROM solved),
    ends AS (SELECT *, px + t * dx AS ex, py + t * dy AS ey, px + u * dx AS lx, py + u * dy AS ly FROM spans),
    held AS (SELECT candidate_id, sum(CASE WHEN meets AND t < u THEN (ex * ly - ey * lx) / 2 + 4.5e6 * (CASE WHEN t > 0 THEN {_ANGLE.format(a="p", b="e")} ELSE 0 END + CASE WHEN u < 1 THEN {_ANGLE.format(a="l", b="q")} ELSE 0 END) ELSE 4.5e6 * {_ANGLE.format(a="p", b="q")} END) AS held FROM ends GROUP BY 1)"""


@query(f"WITH {world.sql('candidates')}, {_HELD} SELECT candidate_id, round(greatest(0, 1 - held / (pi() * 9e6)), 6) AS share FROM held")
def a04_outside_share(spark: SparkSession, d: str) -> DataFrame:
    """Circles about the candidates against all districts, whose outline is one square."""
    cand, districts = (world.layer(spark, d, n) for n in ("candidates", "districts"))
    return areas.outside_share(cand, "candidate_id", sites._rings(districts), "district_id", 3000).withColumn("share", F.round("share", 6))


def _planted(plots: DataFrame) -> DataFrame:
    """Boxes, one in two of them broken: bow-ties, spikes, holes outside, holes in holes, rings left open."""
    at = lambda x, y: F.struct((F.col("x") + x * F.col("w")).alias("x"), (F.col("y") + y * F.col("h")).alias("y"))
    ring = lambda *p: F.array(*[at(*map(F.lit, q)) for q in (*p, p[0])])
    k = F.col("plot_id") % 10
    box = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))
    hole = lambda a, b: ring((a, a), (a, b), (b, b), (b, a))
    shell = F.when(k == 0, ring(box[0], box[2], box[1], box[3])).when(k == 1, ring(*box[:3], (2.0, 1.0), box[2], box[3])).when(k == 2, F.slice(ring(*box), 1, 4)).otherwise(ring(*box))
    holes = F.when(k == 3, F.array(hole(2.0, 3.0))).when(k == 4, F.array(hole(0.125, 0.875), hole(0.25, 0.5))).when(k == 5, F.array(hole(0.25, 0.75)))
    rings = F.concat(F.array(shell), F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")))
    return plots.select("plot_id", F.lit(0).alias("part"), F.posexplode(rings).alias("nr", "ring"))


_FAULTS = "faults AS (SELECT plot_id, unnest(CASE plot_id % 10 WHEN 0 THEN ['crossing'] WHEN 1 THEN ['overlap', 'self touch'] WHEN 2 THEN ['not closed'] WHEN 3 THEN ['hole outside'] WHEN 4 THEN ['hole in hole'] END) AS problem FROM plots UNION ALL SELECT plot_id, 'not within the box' FROM plots WHERE x < 1000 OR y < 1000 OR x + w * CASE plot_id % 10 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END > 49000 OR y + h * CASE plot_id % 10 WHEN 3 THEN 3 ELSE 1 END > 49000)"


@query(f"WITH {world.sql('plots')}, {_FAULTS} SELECT problem, count(*) AS n, array_to_string(list_sort(list(plot_id))[1:5], ' ') AS examples FROM faults GROUP BY 1")
def v02_area_checks(spark: SparkSession, d: str) -> DataFrame:
    out = arrangement.check_areas(_planted(world.layer(spark, d, "plots")), "plot_id", 1000, (1000, 1000, 49000, 49000))
    return out.withColumn("examples", F.array_join("examples", " "))


@query(f"WITH {world.sql('plots')} SELECT plot_id, plot_id % 10 < 5 AS repaired, CAST(CASE plot_id % 10 WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS INT) AS parts, w * h * CASE plot_id % 10 WHEN 0 THEN 0.5 WHEN 3 THEN 2 WHEN 4 THEN 1 - 0.5625 + 0.0625 WHEN 5 THEN 0.75 ELSE 1 END AS area FROM plots")
def v04_repaired_areas(spark: SparkSession, d: str) -> DataFrame:
    out = arrangement.repaired(_planted(world.layer(spark, d, "plots")), "plot_id", 1000)
    shell = lambda p: areas.area(p[0])
    size = F.aggregate(F.transform("polygons", lambda p: shell(p) - F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.lit(0.0), lambda s, r: s + areas.area(r))), F.lit(0.0), lambda s, v: s + v)
    return out.select("plot_id", "repaired", F.size("polygons").alias("parts"), F.round(size, 2).alias("area"))


@query(f"WITH {world.sql('districts')} SELECT district_id, CAST(1 AS INT) AS parts, true AS labelled, true AS simple, true AS joined FROM districts")
def s23_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Districts with wavy borders: drawn outlines are valid, each has its label inside, and together they leave no gap."""
    wave = lambda v: 400 * F.sin(v / 700.0)
    side = [(0, i) for i in range(20)] + [(i, 20) for i in range(20)] + [(20, 20 - i) for i in range(20)] + [(20 - i, 0) for i in range(21)]
    x, y = (lambda i, c: F.col(c) + i * 500.25 for _ in "xy")
    corner = lambda i, j: F.struct((x(i, "x0") + wave(y(j, "y0"))).alias("x"), (y(j, "y0") + wave(x(i, "x0"))).alias("y"))
    districts = stored(world.layer(spark, d, "districts").select("district_id", F.array(*[corner(i, j) for i, j in side]).alias("ring")))
    drawn = stored(areas.outlines(districts, "district_id", 150, 5000))
    rings = stored(drawn.select("district_id", F.posexplode("polygons").alias("part", "p")).select("district_id", "part", F.posexplode("p").alias("nr", "ring")))
    bad = arrangement.ring_problems(rings, "district_id", 5000).select("district_id").distinct().withColumn("bad", F.lit(True))
    whole = arrangement.union_edges(rings, "district_id", cell=5000).agg(F.expr(arrangement._AREA).alias("together"))
    own = rings.agg(F.sum(areas.area(F.col("ring"))).alias("apart"))
    inside = spatial.polygons_of_point(drawn.select("district_id", "label.x", "label.y"), rings.withColumnRenamed("district_id", "of"), "district_id", "of", 5000).where("of = district_id").select("district_id").withColumn("labelled", F.lit(True))
    out = drawn.join(bad, "district_id", "left").join(inside, "district_id", "left").join(F.broadcast(whole.join(own, F.lit(True))), F.lit(True))
    return out.select("district_id", F.size("polygons").alias("parts"), F.coalesce("labelled", F.lit(False)).alias("labelled"), F.col("bad").isNull().alias("simple"), (F.abs(F.col("together") - F.col("apart")) < 1).alias("joined"))


@query(f"WITH {world.sql('chargers', 'districts')} SELECT coalesce(name, 'outside') AS name, count(*) AS n FROM (SELECT charger_id, min(province) AS name FROM chargers c LEFT JOIN districts d ON c.x BETWEEN d.x0 AND d.x0 + 10005 AND c.y BETWEEN d.y0 AND d.y0 + 10005 WHERE access <> 'private' GROUP BY 1) GROUP BY 1")
def a12_sites_by_province(spark: SparkSession, d: str) -> DataFrame:
    """The known sites of the evaluation are those of production."""
    ch, districts = (world.layer(spark, d, n) for n in ("chargers", "districts"))
    names = districts.select("district_id", F.col("province").alias("name"))
    return network.sites_by_area(ch.where("access <> 'private'"), "charger_id", sites._rings(districts), "district_id", names, 10005)


@query(f"WITH {world.sql('candidates')}, p AS (SELECT 29.0 + x / 111000 AS lon, -2.5 + y / 111000 AS lat FROM candidates) SELECT round(min(lon), 9) AS west, round(min(lat), 9) AS south, round(max(lon), 9) AS east, round(max(lat), 9) AS north, round(cos(radians((min(lat) + max(lat)) / 2)), 9) AS x_scale, round(3000 / 110574.0, 9) AS radius_deg FROM p")
def s24_frame(spark: SparkSession, d: str) -> DataFrame:
    p = world.layer(spark, d, "candidates").select((29.0 + F.col("x") / 111000).alias("lon"), (-2.5 + F.col("y") / 111000).alias("lat"))
    row = areas.frame(p, 3000)
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


# --- checks ----------------------------------------------------------------------------------------


@query(
    sites._features_sql(False)
    + "SELECT 'ids differ' AS rule, CAST(0 AS BIGINT) AS breaches UNION ALL SELECT 'poi_1km exceeds poi_3km', count_if(poi_1km > poi_3km) FROM feats UNION ALL SELECT 'poi_1km exceeds pop_1km', count_if(poi_1km > pop_1km) FROM feats UNION ALL SELECT 'dist_road_m negative or infinite', count_if(dist_road_m < 0) FROM feats UNION ALL SELECT 'grid_completeness_ratio exceeds 1', count_if(grid_completeness_ratio > 1) FROM feats UNION ALL SELECT 'chargers_10km present', count_if(chargers_10km > 0) FROM feats"
)
def v07_feature_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds that hold, and some that don't, so that the counts say something."""
    f = sites._features(spark, d)
    return validation.feature_bounds(f, world.layer(spark, d, "candidates"), (("poi_1km", "poi_3km"), ("poi_1km", "pop_1km")), ("dist_road_m",), ("grid_completeness_ratio",), ("chargers_10km",))


@query("SELECT o_custkey AS kind, count(*) AS runs, count_if(o_orderstatus = 'F') AS validated, count_if(o_orderstatus IN ('F', 'O')) AS completed, count(*) = 10 AND count_if(o_orderstatus IN ('F', 'O')) = count(*) AND count_if(o_orderstatus = 'F') >= 1 AS passed FROM orders GROUP BY 1")
def a22_gate(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "fallback").otherwise("error")
    runs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("kind"), status.alias("status"))
    return briefs.gate(runs, 10, 1)


# --- briefs and evidence ----------------------------------------------------------------------------

_STRENGTH = "list_transform(list_sort([" + ", ".join(f"struct_pack(m := -component_{c}, n := '{c}')" for c in COMPONENTS) + "]), lambda p: p.n)"


@query(sites._SCORES + f"SELECT candidate_id, {_STRENGTH}[1] AS first, {_STRENGTH}[2] AS second, {_STRENGTH}[5] AS last FROM scores")
def w07_component_order(spark: SparkSession, d: str) -> DataFrame:
    order = briefs.by_strength()
    at = lambda i: F.element_at(order, i)
    return sites._scores(spark, d).select("candidate_id", at(1).alias("first"), at(2).alias("second"), at(5).alias("last"))


def _network(spark: SparkSession, d: str):
    """Scored sites with their district, share outside and marginal demand; the network (the best-ranked eligible sites) and all briefs' figures."""
    s, weights, cover, _ = sites._problem(spark, d)
    chosen = stored(s.orderBy("rank").limit(W.sites))
    top = stored(sites._scores(spark, d).orderBy("rank").limit(W.sites))
    cand, districts = (world.layer(spark, d, n) for n in ("candidates", "districts"))
    outside = areas.outside_share(cand, "candidate_id", sites._rings(districts), "district_id", max(W.population_m))
    marginal = network.marginal_coverage(cover, weights, chosen).where("selected").select("candidate_id", "marginal")
    all_sites = sites._scores(spark, d).join(districts.select("district_id", "district"), "district_id", "left").join(outside.withColumnRenamed("share", "outside_share"), "candidate_id").join(marginal, "candidate_id", "left")
    share = lambda of: network.radius_robustness(of, weights, [W.service_m], {"one": of}).first()["people_share"]
    known = features.production_chargers(world.layer(spark, d, "chargers")).count()
    provinces = districts.select("district_id", "province_id")
    return all_sites, chosen, {"candidates": cand.count(), "known_sites": known, "network_share": share(chosen), "top_share": share(top.join(provinces, "district_id"))}


_M = lambda c: f"CASE WHEN {c} < 1000 THEN printf('%.0f m', {c}) ELSE printf('%.1f km', {c} / 1000) END"
_NAME = "CASE {n} " + " ".join(f"WHEN '{c}' THEN '{n.lower()}'" for c, n in briefs.NAMES.items()) + " END"
_VALUE = "printf('%.1f', CASE {n} " + " ".join(f"WHEN '{c}' THEN component_{c}" for c in briefs.NAMES) + " END)"
_PART = lambda i: "(" + _NAME.format(n=f"o[{i}]") + " || ' ' || " + _VALUE.format(n=f"o[{i}]") + ")"
_HOSTS = "CASE host_type " + " ".join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in hosts.HOST_LABELS.items()) + " END"
_BRIEFS = sites._TOP.rstrip() + f""", best AS (SELECT * FROM scores ORDER BY rank LIMIT 30), reached AS (SELECT (SELECT sum(people) FROM weights b WHERE EXISTS (SELECT 1 FROM selected a WHERE {sites._D} <= 3000)) / (SELECT sum(people) FROM weights) AS ours, (SELECT sum(people) FROM weights b WHERE EXISTS (SELECT 1 FROM best a WHERE {sites._D} <= 3000)) / (SELECT sum(people) FROM weights) AS best),
    times AS (SELECT node_id, count(*) AS times FROM cover WHERE candidate_id IN (SELECT candidate_id FROM selected) GROUP BY 1),
    lost AS (SELECT candidate_id, sum(CASE WHEN times = 1 THEN weight ELSE 0 END) AS marginal FROM cover JOIN times USING (node_id) JOIN weights USING (node_id) WHERE candidate_id IN (SELECT candidate_id FROM selected) GROUP BY 1),
    {_HELD.replace("9e6", "4e6").replace("4.5e6", "2e6")},
    told AS (SELECT s.*, d.district, l.marginal, CASE WHEN 1 - h.held / (pi() * 4e6) < 1e-9 THEN 0 ELSE 1 - h.held / (pi() * 4e6) END AS outside, coalesce(grid_completeness_ratio < 0.5, false) AS sparse, coalesce(dist_charger_m <= 3000, false) AS charger, {_STRENGTH} AS o
        FROM scores s JOIN districts d USING (district_id) JOIN held h USING (candidate_id) LEFT JOIN lost l USING (candidate_id)),
    lines AS (SELECT candidate_id,
        concat_ws(' | ', 'Network: one of 30 sites chosen', CASE WHEN marginal IS NOT NULL THEN 'Demand lost without it: ' || printf('%.1f', marginal * 100) || '%' END, 'Score ' || printf('%.1f', score) || ', rank ' || rank || ' of ' || format('{{:,d}}', (SELECT count(*) FROM candidates)) || ', ' || profile || ' profile',
            'Highest parts: ' || {_PART(1)} || ', ' || {_PART(2)}, 'Population within 3 km: network ' || printf('%.1f', ours * 100) || '%, same number by rank ' || printf('%.1f', best * 100) || '%') AS opportunity,
        CASE WHEN outside > 0 THEN 'Not counted: ' || printf('%.0f', outside * 100) || '% of the 2 km circle, beyond the border' ELSE '' END AS border,
        concat_ws(' | ', CASE WHEN missing THEN 'Grid: nothing within 1.5 km, part set to 0' END, CASE WHEN sparse THEN 'Map of ' || district || ': ' || printf('%.2f', grid_completeness_ratio) || ' of the median density' END, CASE WHEN outside > 0 THEN 'Circle of 2 km: ' || printf('%.0f', outside * 100) || '% without demand figures' END,
            'Gap figures rest on ' || (SELECT count(*) FROM chargers WHERE access <> 'private') || ' chargers', 'Lowest part: ' || {_PART(5)}) AS risks,
        concat_ws(' | ', {", ".join(f"'{u}'" for u in UNKNOWNS)}, CASE WHEN missing THEN 'Grid within 1.5 km' END) AS unknowns,
        concat_ws(' | ', 'Utility: capacities and cost', 'Owner (' || {_HOSTS} || '): land, consent', district || ': permits', CASE WHEN missing THEN 'Utility: network plan within 1.5 km' END, CASE WHEN sparse THEN 'Field check: lines and substations' END, CASE WHEN charger THEN 'Field check: charger at ' || {_M("dist_charger_m")} END,
            CASE WHEN outside > 0 THEN 'Demand beyond the border: own estimate' END) AS actions FROM told, reached) """


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.select("candidate_id", *[F.array_join(F.transform(n, lambda x: x["text"]), " | ").alias(n) for n in names])


@query(_BRIEFS + "SELECT * FROM lines")
def e06_brief_sections(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all sites' sections, as they are shown."""
    s, _, figures = _network(spark, d)
    return _joined(briefs.sections(s, W, figures), *briefs.SECTIONS)


@query(_BRIEFS + "SELECT candidate_id, n.records, n.digest, CASE WHEN candidate_id IN (SELECT candidate_id FROM selected) THEN actions ELSE '' END AS actions FROM lines JOIN (SELECT candidate_id, CAST(count(*) AS INT) AS records, md5(string_agg(id || '=' || display, ';' ORDER BY id)) AS digest FROM (" + sites._RECORDS_SQL + ") GROUP BY 1) n USING (candidate_id)")
def q02_get_sites(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a site by id and display, as one digest, and the actions of the network's sites."""
    s, chosen, figures = _network(spark, d)
    out = briefs.get_sites(s, chosen, W, figures)
    shown = F.md5(F.array_join(F.transform("records", lambda r: F.concat(r["id"], F.lit("="), r["display"])), ";").cast("binary"))
    return out.select("candidate_id", F.size("records").alias("records"), shown.alias("digest"), F.array_join(F.transform("actions", lambda x: x["text"]), " | ").alias("actions"))


@query(_BRIEFS + "SELECT * FROM lines WHERE candidate_id = (SELECT candidate_id FROM selected ORDER BY rank LIMIT 1)")
def q06_generate_brief(spark: SparkSession, d: str) -> DataFrame:
    """The whole brief of the network's best-ranked site."""
    s, chosen, figures = _network(spark, d)
    best = briefs.first_match(chosen)["candidate_id",].first()[0]
    return _joined(briefs.brief(s, chosen, best, W, figures), *briefs.SECTIONS)


@query(sites._SCORES + "SELECT candidate_id, rank FROM scores WHERE profile = 'corridor' AND confidence = 'Low' ORDER BY rank LIMIT 1")
def l09_first_match(spark: SparkSession, d: str) -> DataFrame:
    return briefs.first_match(sites._scores(spark, d), profile="corridor", confidence="Low").select("candidate_id", "rank")


_PROFILE_WEIGHTS = {f"weight_{p}_{c}": w for p, t in PROFILES.items() for c, w in t.items()}


@query(f"WITH {world.sql('candidates')}, n AS (SELECT count(*) AS n FROM candidates) SELECT 'candidates' AS id, 'CALCULATED' AS type, format('{{:,d}}', n) AS display FROM n UNION ALL SELECT * FROM (VALUES ('n_sites', 'RETRIEVED_FACT', '30'), ('service_radius', 'RETRIEVED_FACT', '3 km'), ('grid_radius', 'RETRIEVED_FACT', '1.5 km'), " + ", ".join(f"('radius_{r}', 'RETRIEVED_FACT', '{r / 1000:g} km')" for r in (300, 500, 1000, 1500, 2000, 5000)) + ", " + ", ".join(f"('{k}', 'RETRIEVED_FACT', '{w:.2f}')" for k, w in _PROFILE_WEIGHTS.items()) + ", ('unknown_0', 'UNKNOWN', 'grid connection capacity'), ('unknown_1', 'UNKNOWN', 'transformer capacity'), ('unknown_2', 'UNKNOWN', 'land availability'), ('unknown_3', 'UNKNOWN', 'landowner willingness'), ('unknown_4', 'UNKNOWN', 'permit requirements')) AS t(id, type, display)")
def e04_context_records(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("id", "type", "display")


def _context(spark: SparkSession, d: str) -> DataFrame:
    return briefs.context_records(spark, {"candidates": world.layer(spark, d, "candidates").count()}, W)


@query(sites._SCORES + "SELECT candidate_id, 53 AS records, CAST(6 + CASE WHEN dist_substation_m IS NULL THEN 1 ELSE 0 END AS INT) >= 5 AS has_unknowns, CASE WHEN dist_charger_m IS NULL THEN 'none mapped' WHEN dist_charger_m < 1000 THEN printf('%.0f m', dist_charger_m) ELSE printf('%.1f km', dist_charger_m / 1000) END AS charger FROM scores")
def e05_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every site's records with those of the context: 28 and 25."""
    out = briefs.evidence(_context(spark, d), sites._scores(spark, d))
    unknown = F.size(F.filter("records", lambda r: r["type"] == "UNKNOWN"))
    charger = F.filter("records", lambda r: r["id"].endswith("/dist_charger_m"))
    return out.select("candidate_id", F.size("records").alias("records"), (unknown >= 5).alias("has_unknowns"), F.element_at(charger, 1)["display"].alias("charger"))


# --- networks ----------------------------------------------------------------------------------------

_RADII = (2000.0, 3000.0, 4000.0)
_STUDY = sites._TOP.rstrip() + """, low AS (SELECT * FROM eligible ORDER BY rank DESC LIMIT 30), chosen AS (SELECT 'top' AS method, candidate_id, province_id, s.district_id, s.x, s.y FROM selected s JOIN districts USING (district_id) UNION ALL SELECT 'low', candidate_id, province_id, s.district_id, s.x, s.y FROM low s JOIN districts USING (district_id)),
    reach AS (SELECT a.method, b.node_id, min(""" + sites._D + """) AS dist FROM chosen a JOIN weights b ON abs(a.x - b.x) <= 4000 AND abs(a.y - b.y) <= 4000 GROUP BY 1, 2), grid AS (SELECT unnest([2000.0, 3000.0, 4000.0])::DOUBLE AS radius)"""


@query(_STUDY + " SELECT c.method, g.radius, count(*) AS sites, coalesce((SELECT round(sum(w.weight), 9) FROM reach r JOIN weights w USING (node_id) WHERE r.method = c.method AND r.dist <= g.radius), 0.0) AS demand, coalesce(round((SELECT sum(w.people) FROM reach r JOIN weights w USING (node_id) WHERE r.method = c.method AND r.dist <= g.radius) / (SELECT sum(people) FROM weights), 9), 0.0) AS people_share, count(DISTINCT province_id) AS provinces, count(DISTINCT district_id) AS districts FROM chosen c CROSS JOIN grid g GROUP BY 1, 2")
def n08_radius_robustness(spark: SparkSession, d: str) -> DataFrame:
    s, weights, _, _ = sites._problem(spark, d)
    chosen = {"top": s.orderBy("rank").limit(30), "low": s.orderBy(F.desc("rank")).limit(30)}
    return network.radius_robustness(s, weights, list(_RADII), chosen)


def _by_top(spark: SparkSession, d: str):
    """The best-ranked sites as the selection: the radius and the factor move its figures, the number of sites the selection."""
    s = sites._problem(spark, d)[0]
    px, ch = (world.layer(spark, d, n) for n in ("pixels", "chargers"))

    def solve(n: float, radius: float) -> DataFrame:
        return s.orderBy("rank").limit(int(n)).select("candidate_id")

    def summary(chosen: DataFrame, n: float, radius: float) -> DataFrame:
        w = stored(network.demand_weights(network.demand_nodes(px, 2500), sites.features.production_chargers(ch), W.service_m, W.charger_factor))
        return network.summarise(chosen, network.coverage(s, w, radius), w, s)

    return solve, summary


def _variant(parameter: str, value: float, n: int, radius: int) -> str:
    return f"SELECT '{parameter}' AS parameter, CAST({value} AS DOUBLE) AS value, (SELECT round(sum(weight), 9) FROM weights b WHERE EXISTS (SELECT 1 FROM (SELECT * FROM eligible ORDER BY rank LIMIT {n}) a WHERE {sites._D} <= {radius})) AS demand, (SELECT round(sum(CASE WHEN EXISTS (SELECT 1 FROM (SELECT * FROM eligible ORDER BY rank LIMIT {n}) a WHERE {sites._D} <= {radius}) THEN people ELSE 0 END) / sum(people), 9) FROM weights b) AS people_share, (SELECT count(DISTINCT province_id) FROM (SELECT * FROM eligible ORDER BY rank LIMIT {n}) JOIN districts USING (district_id)) AS provinces, (SELECT count(*) FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT {n}) WHERE candidate_id IN (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 20)) AS overlap"


@query(sites._PROBLEM + _variant("n", 10, 10, 3000) + " UNION ALL " + _variant("n", 40, 40, 3000) + " UNION ALL " + _variant("radius", 2000, 20, 2000) + " UNION ALL " + _variant("radius", 4000, 20, 4000))
def n07_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    solve, summary = _by_top(spark, d)
    return network.sensitivity({"n": 20, "radius": 3000}, {"n": [10, 20, 40], "radius": [2000, 3000, 4000]}, solve, summary)


def _selections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best thirty, and a stored selection of which two are others."""
    s = sites._problem(spark, d)[0].select("candidate_id", "rank")
    now = s.orderBy("rank").limit(30).select(F.lit("top").alias("method"), "candidate_id")
    then = s.orderBy("rank").limit(32).orderBy(F.desc("rank")).limit(30).select(F.lit("top").alias("method"), "candidate_id")
    return stored(now), stored(then)


@query(sites._PROBLEM + "SELECT 'top' AS method, (SELECT count(*) FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 32 OFFSET 2) WHERE candidate_id NOT IN (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30)) AS missing, (SELECT count(*) FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30) WHERE candidate_id NOT IN (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30 OFFSET 2)) AS added, false AS same".replace("LIMIT 32 OFFSET 2", "LIMIT 30 OFFSET 2"))
def n09_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return network.reconcile(*_selections(spark, d))


@query(sites._PROBLEM + "SELECT 'top' AS method, count(*) AS size, count(*) = 30 AS size_ok, count_if(candidate_id NOT IN (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30 OFFSET 2)) AS unflagged, (SELECT count(*) FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30 OFFSET 2) WHERE candidate_id NOT IN (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30)) AS unlisted, false AS consistent FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT 30)")
def v11_consistency(spark: SparkSession, d: str) -> DataFrame:
    return network.consistency(*_selections(spark, d), 30)


_SUMMARY = sites.ORACLE_SQL["a10_selection_summary"]


@query("SELECT 'network/top/' || metric AS id, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT CAST(sites AS DOUBLE) AS sites, demand, CAST(people AS DOUBLE) AS people, people_share, CAST(provinces AS DOUBLE) AS provinces, CAST(districts AS DOUBLE) AS districts, mean_score FROM (" + _SUMMARY + ")) ON COLUMNS(*) INTO NAME metric VALUE value)")
def q07_network_summary(spark: SparkSession, d: str) -> DataFrame:
    s, weights, cover, _ = sites._problem(spark, d)
    return network.network_records(network.summarise(s.orderBy("rank").limit(30), cover, weights, s), "top")


def _unrolled_greedy(n: int) -> str:
    ctes = [f"clash AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b FROM {sites._within('eligible', 'eligible', 2000)} WHERE {sites._D} < 2000)", "gains AS MATERIALIZED (SELECT candidate_id, node_id, weight FROM cover JOIN weights USING (node_id))", "shares AS MATERIALIZED (SELECT candidate_id, 0.01 * score / (SELECT sum(score) FROM eligible) AS bonus FROM eligible)"]
    for i in range(1, n + 1):
        before = " UNION ALL ".join(f"SELECT candidate_id FROM p{k}" for k in range(1, i))
        free = f" WHERE b.candidate_id NOT IN ({before}) AND b.candidate_id NOT IN (SELECT b FROM clash WHERE a IN ({before}))" if before else ""
        left = f" WHERE node_id NOT IN (SELECT node_id FROM cover WHERE candidate_id IN ({before}))" if before else ""
        ctes.append(f"p{i} AS MATERIALIZED (SELECT b.candidate_id, CAST({i} AS INT) AS nth, round(coalesce(w.w, 0) + b.bonus, 12) AS gain FROM shares b LEFT JOIN (SELECT candidate_id, sum(weight) AS w FROM gains{left} GROUP BY 1) w USING (candidate_id){free} ORDER BY gain DESC, b.candidate_id LIMIT 1)")
    return ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT candidate_id, nth, round(gain, 9) AS gain FROM p{i}" for i in range(1, n + 1))


sites.ORACLE_SQL["n04_greedy_network"] = sites._PROBLEM.rstrip() + ", " + _unrolled_greedy(10)


def _unrolled_spacing(n: int, radius: float) -> str:
    ctes = []
    for i in range(1, n + 1):
        before = " UNION ALL ".join(f"SELECT x, y FROM p{k}" for k in range(1, i))
        free = f" WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE {sites._D} < {radius})" if before else ""
        ctes.append(f"p{i} AS MATERIALIZED (SELECT a.candidate_id, a.x, a.y, CAST({i} AS BIGINT) AS nth FROM scores a{free} ORDER BY a.rank LIMIT 1)")
    return ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT candidate_id, nth FROM p{i}" for i in range(1, n + 1))


sites.ORACLE_SQL["n05_spaced_top"] = sites._SCORES.rstrip().replace("scores AS (", "scores AS MATERIALIZED (") + ", " + _unrolled_spacing(20, 4000)


_SPREAD = (3000.0, 6000.0)


def _study_sql(n: int, more: str) -> str:
    """Greedy, top and spaced selections at two radii, every place of every selection a table of its own."""
    raw = sites._WEIGHTS.replace("<= 3000", "<= 2000").replace("raw AS (", "raw2 AS (", 1).replace("weights AS (", "weights2 AS (", 1).replace("FROM raw)", "FROM raw2)")
    ctes = [raw, "shares AS MATERIALIZED (SELECT candidate_id, 0.01 * score / (SELECT sum(score) FROM eligible) AS bonus FROM eligible)"]
    ctes.append(f"span AS MATERIALIZED (SELECT a.candidate_id, b.node_id, {sites._D} AS dist FROM {sites._within('eligible', 'weights', 3000)} WHERE {sites._D} <= 3000)")
    ctes.append(f"clash AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b FROM {sites._within('eligible', 'eligible', 2000)} WHERE {sites._D} < 2000)")
    chosen = []
    for method, name, radius, weights in (("greedy", "g", 2000, "weights"), ("greedy", "h", 3000, "weights"), ("follows", "f", 2000, "weights2")):
        for i in range(1, n + 1):
            before = " UNION ALL ".join(f"SELECT candidate_id FROM {name}{k}" for k in range(1, i))
            free = f" WHERE b.candidate_id NOT IN ({before}) AND b.candidate_id NOT IN (SELECT b FROM clash WHERE a IN ({before}))" if before else ""
            left = f" AND node_id NOT IN (SELECT node_id FROM span WHERE dist <= {radius} AND candidate_id IN ({before}))" if before else ""
            ctes.append(f"{name}{i} AS MATERIALIZED (SELECT b.candidate_id FROM shares b LEFT JOIN (SELECT candidate_id, sum(weight) AS w FROM span JOIN {weights} USING (node_id) WHERE dist <= {radius}{left} GROUP BY 1) w USING (candidate_id){free} ORDER BY round(coalesce(w.w, 0) + b.bonus, 12) DESC, b.candidate_id LIMIT 1)")
            chosen.append(f"SELECT '{method}' AS method, {radius}.0 AS radius, candidate_id FROM {name}{i}")
    for spread in _SPREAD:
        for i in range(1, n + 1):
            before = " UNION ALL ".join(f"SELECT x, y FROM s{spread:g}_{k}" for k in range(1, i))
            free = f" WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE {sites._D} < {spread})" if before else ""
            ctes.append(f"s{spread:g}_{i} AS MATERIALIZED (SELECT a.candidate_id, a.x, a.y FROM eligible a{free} ORDER BY a.rank LIMIT 1)")
            chosen += [f"SELECT 'spaced {spread:g}', {r}.0, candidate_id FROM s{spread:g}_{i}" for r in (2000, 3000)]
    chosen += [f"SELECT 'top', {r}.0, candidate_id FROM (SELECT candidate_id FROM eligible ORDER BY rank LIMIT {n})" for r in (2000, 3000)]
    ctes.append("picked AS MATERIALIZED (" + " UNION ALL ".join(chosen) + ")")
    ctes.append("held AS (SELECT DISTINCT method, radius, node_id FROM picked JOIN span USING (candidate_id) WHERE dist <= radius), got AS (SELECT method, radius, sum(weight) AS demand, sum(people) / (SELECT sum(people) FROM weights) AS share FROM held JOIN weights USING (node_id) GROUP BY 1, 2)")
    return sites._PROBLEM.rstrip() + ", " + ", ".join(ctes) + more


def _study(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = sites._problem(spark, d)[0]
    px, ch = (world.layer(spark, d, n) for n in ("pixels", "chargers"))
    return network.radius_study(s, stored(network.demand_nodes(px, 2500)), features.production_chargers(ch), [2000.0, 3000.0], 3000.0, 4, list(_SPREAD), W.spacing_m, W.charger_factor, W.score_weight)


@query(_study_sql(4, " SELECT p.method, CAST(p.radius AS DOUBLE) AS radius, count(*) AS sites, coalesce(round(any_value(demand), 9), 0.0) AS demand, coalesce(round(any_value(share), 9), 0.0) AS people_share, count(DISTINCT province_id) AS provinces, count(DISTINCT e.district_id) AS districts FROM picked p JOIN eligible e USING (candidate_id) JOIN districts d ON d.district_id = e.district_id LEFT JOIN got g ON g.method = p.method AND g.radius = p.radius WHERE p.method <> 'follows' GROUP BY 1, 2"))
def n08_radius_study(spark: SparkSession, d: str) -> DataFrame:
    """Greedy solved anew at each radius, beside the best-ranked and spaced sites."""
    return _study(spark, d)[0]


@query(_study_sql(4, " SELECT CAST(2000 AS DOUBLE) AS radius, (SELECT count(*) FROM picked WHERE method = 'follows' AND candidate_id IN (SELECT candidate_id FROM picked WHERE method = 'greedy' AND radius = 2000)) AS shared, (SELECT round(share, 9) FROM got WHERE method = 'greedy' AND radius = 2000) AS share_fixed, (SELECT round(share, 9) FROM got WHERE method = 'follows') AS share_follows"))
def n08_weight_check(spark: SparkSession, d: str) -> DataFrame:
    """What weights that follow the radius change."""
    return _study(spark, d)[1]


_BASE = {"score_weight": W.score_weight, "radius": W.service_m, "factor": W.charger_factor}
_VARIED = {"score_weight": [0.0, W.score_weight, 0.5], "radius": [2000.0, W.service_m], "factor": [0.25, W.charger_factor]}


def _solved_sql(n: int) -> str:
    """The greedy network of the base and of each variant, every place a table of its own, and each variant's figures."""
    ctes = [f"span AS MATERIALIZED (SELECT a.candidate_id, b.node_id, {sites._D} AS dist FROM {sites._within('eligible', 'nodes', 3000)} WHERE {sites._D} <= 3000)"]
    ctes.append(f"clash AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b FROM {sites._within('eligible', 'eligible', W.spacing_m)} WHERE {sites._D} < {W.spacing_m})")
    variants = [("base", 0.0, _BASE)] + [(k, v, _BASE | {k: v}) for k, values in _VARIED.items() for v in values if v != _BASE[k]]
    figures = []
    for i, (parameter, value, p) in enumerate(variants):
        near = f"EXISTS (SELECT 1 FROM open_chargers b WHERE {sites._D} <= {p['radius']})"
        ctes.append(f"raw{i} AS MATERIALIZED (SELECT a.node_id, a.people, a.people * CASE WHEN {near} THEN {p['factor']} ELSE 1.0 END::DOUBLE AS raw FROM nodes a)")
        ctes.append(f"w{i} AS MATERIALIZED (SELECT node_id, people, raw / (SELECT sum(raw) FROM raw{i}) AS weight FROM raw{i})")
        ctes.append(f"near{i} AS MATERIALIZED (SELECT candidate_id, node_id, weight, people FROM span JOIN w{i} USING (node_id) WHERE dist <= {p['radius']})")
        for nth in range(1, n + 1):
            before = " UNION ALL ".join(f"SELECT candidate_id FROM v{i}_{k}" for k in range(1, nth))
            free = f" WHERE e.candidate_id NOT IN ({before}) AND e.candidate_id NOT IN (SELECT b FROM clash WHERE a IN ({before}))" if before else ""
            left = f" WHERE node_id NOT IN (SELECT node_id FROM near{i} WHERE candidate_id IN ({before}))" if before else ""
            ctes.append(f"v{i}_{nth} AS MATERIALIZED (SELECT e.candidate_id FROM eligible e LEFT JOIN (SELECT candidate_id, sum(weight) AS w FROM near{i}{left} GROUP BY 1) g USING (candidate_id){free} ORDER BY round(coalesce(w, 0) + CAST({p['score_weight']} AS DOUBLE) * e.score / (SELECT sum(score) FROM eligible), 12) DESC, e.candidate_id LIMIT 1)")
        ctes.append(f"s{i} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT candidate_id FROM v{i}_{k}" for k in range(1, n + 1)) + ")")
        if i:
            got = f"(SELECT DISTINCT node_id, weight, people FROM near{i} WHERE candidate_id IN (FROM s{i}))"
            figures.append(f"SELECT '{parameter}' AS parameter, CAST({value} AS DOUBLE) AS value, coalesce((SELECT round(sum(weight), 9) FROM {got}), 0.0) AS demand, round((SELECT coalesce(sum(people), 0) FROM {got}) / (SELECT sum(people) FROM nodes), 9) AS people_share, (SELECT count(DISTINCT province_id) FROM eligible JOIN districts USING (district_id) WHERE candidate_id IN (FROM s{i})) AS provinces, (SELECT count(*) FROM s{i} WHERE candidate_id IN (FROM s0)) AS overlap")
    return sites._PROBLEM.rstrip() + ", " + ", ".join(ctes) + " " + " UNION ALL ".join(figures)


@query(_solved_sql(4))
def n07_solved_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The network solved anew with each parameter off its default."""
    s = sites._problem(spark, d)[0]
    px, ch = (world.layer(spark, d, n) for n in ("pixels", "chargers"))
    widest = max(_VARIED["radius"])
    solve, summary = network.solved_anew(s, stored(network.demand_nodes(px, 2500)), stored(features.production_chargers(ch)), widest, 4, W.spacing_m)
    return network.sensitivity(_BASE, _VARIED, solve, summary)


# --- knowledge ----------------------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text || chr(13) || chr(10) || 'x' || chr(13) || 'y', '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def t01_normalised(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", F.md5(retrieval.normalised(F.concat("text", F.lit("\r\nx\ry"))).cast("binary")).alias("digest"))


@query("SELECT p_partkey AS doc_id, l AS level, t AS title FROM part, LATERAL (VALUES (1, p_name), (2, 'Scope'), (3, p_brand)) AS v(l, t)")
def t04_select_units(spark: SparkSession, d: str) -> DataFrame:
    """Documents of five headings, of which the manifest leaves out one of level 2 and what is below it."""
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit("# "), "p_name", F.lit("\n## Scope\ntext\n### "), "p_brand", F.lit("\n## Annex\n### "), "p_type", F.lit("\n"))
    units = retrieval.sections(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return retrieval.select_units(units, exclude=("Annex",)).select("doc_id", "level", "title")


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of 300 characters, every seventh document's third one changed, and every fifth's drawn a character to the left."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text")
    n = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / 300).cast("int"))).alias("part")
    cut = docs.where("text <> ''").select("doc_id", "text", n)
    left = F.when((F.col("doc_id") % 5 == 0) & (F.col("part") == 2), 1).otherwise(0)
    start, end = F.col("part") * 300 - left, F.least(F.col("part") * 300 + 300, F.char_length("text"))
    said = F.substr("text", start + 1, end - start)
    said = F.when((F.col("doc_id") % 7 == 0) & (F.col("part") == 2), F.concat(said, F.lit("!"))).otherwise(said)
    return cut.select("doc_id", start.alias("start"), end.alias("end"), said.alias("text")), docs


@query("WITH big AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 600) SELECT 'not a slice' AS rule, (SELECT count(*) FROM big WHERE doc_id % 7 = 0) AS breaches UNION ALL SELECT 'size', (SELECT count(*) FROM big WHERE doc_id % 5 = 0 AND n >= 900) UNION ALL SELECT 'overlap', (SELECT count(*) FROM big WHERE doc_id % 5 = 0)")
def t09_verify_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks, docs = _slices(spark, d)
    return retrieval.verify_chunks(chunks, docs, 300)


@query("WITH t AS (SELECT sha256('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}') AS digest FROM documents), ranges AS (SELECT substr(digest, 1, 4) AS range, sha256(string_agg(digest, '' ORDER BY digest)) AS digest, count(*) AS n FROM t GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS chunks, sha256(string_agg(digest, '' ORDER BY range)) AS fingerprint FROM ranges")
def t09_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_fingerprint(spark.read.parquet(f"{d}/documents.parquet"), ("doc_id", "n_chars"))


@query(f"WITH {world.sql('chunks')}, gold AS (SELECT item_id AS query_id, item_id * 3 AS chunk_id, text AS phrase, CASE WHEN item_id % 2 = 0 THEN 'en' END AS doc_type FROM benchmark), j AS (SELECT g.*, c.chunk_id IS NOT NULL AS there, c.text, c.doc_type AS has FROM gold g LEFT JOIN chunks c USING (chunk_id)) SELECT query_id, chunk_id, 'no such chunk' AS problem FROM j WHERE NOT there UNION ALL SELECT query_id, chunk_id, 'no such phrase' FROM j WHERE there AND NOT contains(text, phrase) UNION ALL SELECT query_id, chunk_id, 'left out by doc_type' FROM j WHERE there AND doc_type IS NOT NULL AND doc_type IS DISTINCT FROM has")
def t14_gold_problems(spark: SparkSession, d: str) -> DataFrame:
    b, chunks = spark.read.parquet(f"{d}/benchmark.parquet"), world.layer(spark, d, "chunks")
    gold = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("chunk_id"), F.col("text").alias("phrase"), F.when(F.col("item_id") % 2 == 0, "en").alias("doc_type"))
    return retrieval.validate_gold(gold, chunks, ("doc_type",))


_CLAIMED = r"""WITH st AS (SELECT conv_id || '-' || turn AS statement_id, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' The grid is near.' WHEN 1 THEN ' Actual grid connection feasibility requires utility confirmation.' WHEN 2 THEN ' The permits have been granted.' ELSE ' It is higher.' END AS t, turn % 4 AS k, conv_id % 2 AS c FROM conversations)"""


@query(_CLAIMED + r" SELECT statement_id, regexp_matches(lower(t), '\bgrid\b') AND k <> 1 AS no_disclaimer, regexp_matches(replace(t, 'Actual grid connection feasibility requires utility confirmation.', ''), '(?i)feasib\w*') AS feasible, regexp_matches(t, '(?i)\bpermits?\s+(?:is|are|has\s+been|have\s+been)\s+(?:approved|granted)\b') AS permitted, regexp_matches(lower(t), '\b(?:greater|higher|more|less|lower|smaller|larger)\b') AND c = 0 AS undirected FROM st")
def r07_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns with an added sentence; those of odd conversations cite a comparison with a direction."""
    k = F.col("turn") % 4
    more = F.when(k == 0, " The grid is near.").when(k == 1, f" {answers.GRID_DISCLAIMER}").when(k == 2, " The permits have been granted.").otherwise(" It is higher.")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    st = turns.select(F.concat_ws("-", "conv_id", "turn").alias("statement_id"), F.lit("FACT").alias("kind"), F.concat(F.coalesce("text", F.lit("")), more).alias("text"), F.array(F.concat(F.lit("r"), (F.col("conv_id") % 2).cast("string"))).alias("evidence_ids"), F.array().cast("array<string>").alias("quotes"))
    records = spark.createDataFrame([("r0", "CALCULATED", "equal", False, "equal"), ("r1", "CALCULATED", "a is greater", False, "a_greater")], "id string, type string, display string, knowledge boolean, relation string")
    has = lambda r: F.array_contains("rules", r)
    return answers.check(st, records).select("statement_id", has("grid_disclaimer_missing").alias("no_disclaimer"), has("feasibility_claim").alias("feasible"), has("permit_approved_claim").alias("permitted"), has("comparison_relation_mismatch").alias("undirected"))
