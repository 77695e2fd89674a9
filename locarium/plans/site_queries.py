"""Queries of the site-selection operators over the derived world, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium import settings as S
from locarium.functions.text import stable_id
from locarium.functions import display
from locarium.operators import evaluation, evidence, features, network, ordered, scoring, spatial
from locarium.plans import world
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


def _layers(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [world.layer(spark, d, n) for n in names]


def _with(*names: str, more: str = "") -> str:
    return f"WITH {world.sql(*names)}{', ' + more if more else ''} "


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _within(a: str, b: str, r: float) -> str:
    """A join of two layers within a box of the radius; the distance decides further on."""
    return f"{a} a JOIN {b} b ON abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r}"


# --- joins by distance ---------------------------------------------------------------------


@query(_with("candidates", "pois") + f"SELECT a.candidate_id, b.poi_id, round({_D}, 6) AS dist FROM {_within('candidates', 'pois', 500)} WHERE {_D} <= 500")
def j03_pairs_within(spark: SparkSession, d: str) -> DataFrame:
    cand, pois = _layers(spark, d, "candidates", "pois")
    out = spatial.pairs_within(pois.select("poi_id", "x", "y"), cand.select("candidate_id", "x", "y"), 500)
    return out.select("candidate_id", "poi_id", F.round("dist", 6).alias("dist"))


@query(_with("chargers") + f"SELECT a.charger_id AS u, b.charger_id AS v FROM {_within('chargers', 'chargers', 2500)} WHERE {_D} < 2500 AND a.charger_id < b.charger_id")
def j03_self_pairs(spark: SparkSession, d: str) -> DataFrame:
    (ch,) = _layers(spark, d, "chargers")
    a, b = (ch.select(F.col("charger_id").alias(n), "x", "y") for n in "uv")
    return spatial.pairs_within(a, b, 2500, inclusive=False).where("u < v").select("u", "v")


_NEAREST = "SELECT candidate_id, charger_id, round(dist, 6) AS dist FROM (SELECT a.candidate_id, b.charger_id, {d} AS dist, row_number() OVER (PARTITION BY a.candidate_id ORDER BY {d}, b.charger_id) AS n FROM candidates a CROSS JOIN chargers b) WHERE n = 1"


@query(_with("candidates", "chargers") + _NEAREST.format(d=_D))
def j04_nearest(spark: SparkSession, d: str) -> DataFrame:
    cand, ch = _layers(spark, d, "candidates", "chargers")
    return spatial.nearest(cand, ch, "candidate_id", "charger_id", W.start_m).withColumn("dist", F.round("dist", 6))


@query(
    _with("candidates", "pois")
    + f"SELECT c.candidate_id, n.poi_id FROM candidates c LEFT JOIN (SELECT a.candidate_id, arg_min(b.poi_id, {_D}) AS poi_id FROM {_within('candidates', 'pois', 800)} WHERE {_D} <= 800 GROUP BY 1) n USING (candidate_id) WHERE c.host_type = 'none'"
)
def j05_snap_to_host(spark: SparkSession, d: str) -> DataFrame:
    cand, pois = _layers(spark, d, "candidates", "pois")
    return spatial.nearest(cand.where("host_type = 'none'"), pois, "candidate_id", "poi_id", W.snap_m, W.snap_m).select("candidate_id", "poi_id")


_SEG = "sqrt(pow(c.x - (r.x1 + t * (r.x2 - r.x1)), 2) + pow(c.y - (r.y1 + t * (r.y2 - r.y1)), 2))"
_ROADS = f"""near AS (SELECT candidate_id, road_id, road_class, {_SEG} AS dist FROM (SELECT c.*, r.*, greatest(0.0, least(1.0, ((c.x - r.x1) * (r.x2 - r.x1) + (c.y - r.y1) * (r.y2 - r.y1)) / (pow(r.x2 - r.x1, 2) + pow(r.y2 - r.y1, 2)))) AS t FROM candidates c CROSS JOIN roads r) AS c, (SELECT 1) AS one)"""
_ROADS = _ROADS.replace("r.x1", "x1").replace("r.x2", "x2").replace("r.y1", "y1").replace("r.y2", "y2").replace("c.x", "x").replace("c.y", "y")


@query(
    _with("candidates", "roads", more=_ROADS)
    + "SELECT candidate_id, road_class, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY dist, road_id) AS n FROM near) WHERE n = 1"
)
def j06_nearest_road(spark: SparkSession, d: str) -> DataFrame:
    cand, roads = _layers(spark, d, "candidates", "roads")
    return spatial.nearest_segment(cand, roads, "candidate_id", "road_id", W.start_m, keep=("road_class",)).select("candidate_id", "road_class", F.round("dist", 6).alias("dist"))


def _rings(districts: DataFrame) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return districts.withColumn("ring", F.array(corner(x0, y0), corner(x0 + 10005, y0), corner(x0 + 10005, y0 + 10005), corner(x0, y0 + 10005), corner(x0, y0)))


@query(
    _with("candidates", "districts")
    + "SELECT c.candidate_id, min(d.district_id) AS district_id FROM candidates c LEFT JOIN districts d ON c.x BETWEEN d.x0 AND d.x0 + 10005 AND c.y BETWEEN d.y0 AND d.y0 + 10005 GROUP BY 1"
)
def j08_point_in_district(spark: SparkSession, d: str) -> DataFrame:
    cand, districts = _layers(spark, d, "candidates", "districts")
    return spatial.polygon_of_point(cand, _rings(districts), "candidate_id", "district_id", 10005)


@query(
    _with("candidates", "districts")
    + "SELECT candidate_id, EXISTS (SELECT 1 FROM districts d WHERE d.district_id % 4 = 1 AND c.x BETWEEN d.x0 AND d.x0 + 10005 AND c.y BETWEEN d.y0 AND d.y0 + 10005) AS inside FROM candidates c"
)
def j07_inside_any(spark: SparkSession, d: str) -> DataFrame:
    cand, districts = _layers(spark, d, "candidates", "districts")
    return spatial.inside_any(cand, _rings(districts.where("district_id % 4 = 1")), "candidate_id", 10005)


@query(_with("candidates", "districts") + "SELECT candidate_id, district, province FROM candidates JOIN districts USING (district_id)")
def j01_equi_join(spark: SparkSession, d: str) -> DataFrame:
    cand, districts = _layers(spark, d, "candidates", "districts")
    return cand.join(districts, "district_id").select("candidate_id", "district", "province")


@query(_with("pois", "chargers") + "SELECT poi_id FROM pois WHERE poi_id IN (SELECT charger_id FROM chargers) UNION ALL SELECT poi_id FROM pois WHERE kind = 'food' AND poi_id NOT IN (SELECT charger_id FROM chargers)")
def j12_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    pois, ch = _layers(spark, d, "pois", "chargers")
    ids = ch.select(F.col("charger_id").alias("poi_id"))
    return pois.join(ids, "poi_id", "left_semi").select("poi_id").unionByName(pois.where("kind = 'food'").join(ids, "poi_id", "left_anti").select("poi_id"))


# --- aggregates by distance -----------------------------------------------------------------


@query(_with("candidates", "chargers") + f"SELECT a.candidate_id, count_if({_D} <= 2000) AS near, count_if({_D} <= 5000) AS far FROM candidates a CROSS JOIN chargers b GROUP BY 1")
def a01_count_within(spark: SparkSession, d: str) -> DataFrame:
    cand, ch = _layers(spark, d, "candidates", "chargers")
    return spatial.count_within(cand, ch, "candidate_id", {"near": 2000, "far": 5000})


_POI = f"""poi AS (SELECT c.candidate_id, coalesce(n.poi_1km, 0) AS poi_1km, coalesce(n.poi_3km, 0) AS poi_3km, coalesce(n.poi_food_1km, 0) AS poi_food_1km, coalesce(n.poi_food_3km, 0) AS poi_food_3km
    FROM candidates c LEFT JOIN (SELECT a.candidate_id, count_if({_D} <= 500) AS poi_1km, count(*) AS poi_3km, count_if({_D} <= 500 AND kind = 'food') AS poi_food_1km, count_if(kind = 'food') AS poi_food_3km
    FROM {_within('candidates', 'pois', 1500)} WHERE {_D} <= 1500 AND b.poi_id IS DISTINCT FROM a.host_poi_id GROUP BY 1) n USING (candidate_id))"""


@query(_with("candidates", "pois", more=_POI) + "SELECT * FROM poi")
def a02_poi_counts(spark: SparkSession, d: str) -> DataFrame:
    cand, pois = _layers(spark, d, "candidates", "pois")
    return features.poi_counts(cand, pois, W.poi_m, ("food",))


_POP = f"""pop AS (SELECT c.candidate_id, CAST(coalesce(n.a, 0) AS BIGINT) AS pop_1km, CAST(coalesce(n.b, 0) AS BIGINT) AS pop_5km, CAST(coalesce(n.c, 0) AS BIGINT) AS pop_10km FROM candidates c LEFT JOIN
    (SELECT a.candidate_id, sum(CASE WHEN {_D} <= 300 THEN people ELSE 0 END) AS a, sum(CASE WHEN {_D} <= 1000 THEN people ELSE 0 END) AS b, sum(CASE WHEN {_D} <= 2000 THEN people ELSE 0 END) AS c
    FROM {_within('candidates', 'pixels', 2000)} GROUP BY 1) n USING (candidate_id))"""


@query(_with("candidates", "pixels", more=_POP) + "SELECT * FROM pop")
def a03_zonal_sum(spark: SparkSession, d: str) -> DataFrame:
    cand, px = _layers(spark, d, "candidates", "pixels")
    return spatial.sum_within(cand, px, "candidate_id", "people", dict(zip(("pop_1km", "pop_5km", "pop_10km"), W.population_m, strict=True)))


# A segment meets a box if it comes no later in than out, over both axes.
_RATIO = """met AS (SELECT d.district_id, p.power_id FROM districts d JOIN (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM power WHERE power IN ('substation', 'line', 'pole')) p
        ON greatest(x1, x2) >= x0 AND least(x1, x2) <= x0 + 10005 AND greatest(y1, y2) >= y0 AND least(y1, y2) <= y0 + 10005
        AND greatest(0, CASE WHEN dx <> 0 THEN least((x0 - x1) / dx, (x0 + 10005 - x1) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((y0 - y1) / dy, (y0 + 10005 - y1) / dy) ELSE 0 END)
         <= least(1, CASE WHEN dx <> 0 THEN greatest((x0 - x1) / dx, (x0 + 10005 - x1) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y0 - y1) / dy, (y0 + 10005 - y1) / dy) ELSE 1 END)),
    density AS (SELECT d.district_id, d.area_km2, count(m.power_id) AS features FROM districts d LEFT JOIN met m ON m.district_id = d.district_id GROUP BY 1, 2),
    ratio AS (SELECT district_id, features, (features / area_km2) / (SELECT median(features / area_km2) FROM density) AS grid_completeness_ratio FROM density)"""


@query(_with("districts", "power", more=_RATIO) + "SELECT district_id, features, round(grid_completeness_ratio, 9) AS ratio FROM ratio")
def a05_completeness(spark: SparkSession, d: str) -> DataFrame:
    power, districts = _layers(spark, d, "power", "districts")
    return features.completeness(power, _rings(districts), 5000).select("district_id", "features", F.round("grid_completeness_ratio", 9).alias("ratio"))


_NODES = "nodes AS (SELECT CAST(floor(x / 2500) AS BIGINT) * 1000000 + CAST(floor(y / 2500) AS BIGINT) AS node_id, CAST(sum(people) AS BIGINT) AS people, (floor(x / 2500) + 0.5) * 2500 AS x, (floor(y / 2500) + 0.5) * 2500 AS y FROM pixels WHERE people > 0 GROUP BY 1, 3, 4)"


@query(_with("pixels", more=_NODES) + "SELECT node_id, people FROM nodes")
def a06_demand_nodes(spark: SparkSession, d: str) -> DataFrame:
    (px,) = _layers(spark, d, "pixels")
    return network.demand_nodes(px, 2500).select("node_id", "people")


_OPEN = "open_chargers AS (SELECT * FROM chargers WHERE access <> 'private')"
_WEIGHTS = f"""raw AS (SELECT a.node_id, a.people, a.x, a.y, a.people * CASE WHEN EXISTS (SELECT 1 FROM open_chargers b WHERE {_D} <= 3000) THEN 0.5 ELSE 1.0 END AS raw FROM nodes a),
    weights AS (SELECT node_id, people, x, y, raw / (SELECT sum(raw) FROM raw) AS weight FROM raw)"""


@query(_with("pixels", "chargers", more=f"{_NODES}, {_OPEN}, {_WEIGHTS}") + "SELECT node_id, round(weight, 12) AS weight FROM weights")
def a07_demand_weights(spark: SparkSession, d: str) -> DataFrame:
    px, ch = _layers(spark, d, "pixels", "chargers")
    w = network.demand_weights(network.demand_nodes(px, 2500), features.production_chargers(ch), W.service_m, W.charger_factor)
    return w.select("node_id", F.round("weight", 12).alias("weight"))


@query(_with("candidates") + "SELECT host_type, count(*) AS n FROM candidates GROUP BY 1")
def a08_category_counts(spark: SparkSession, d: str) -> DataFrame:
    (cand,) = _layers(spark, d, "candidates")
    return cand.groupBy("host_type").agg(F.count("*").alias("n"))


# --- scores -----------------------------------------------------------------------------------


def _all_layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {n: world.layer(spark, d, n) for n in ("candidates", "pixels", "pois", "chargers", "power", "places", "districts", "roads")}
    out["districts"] = _rings(out["districts"])
    return out


_BUILT: dict[tuple[str, str, str, bool], DataFrame] = {}


def _built(kind: str, spark: SparkSession, d: str, backtest: bool, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read, written once."""
    key = (kind, spark.sparkContext.applicationId, d, backtest)
    if key not in _BUILT:
        _BUILT[key] = stored(make())
    return _BUILT[key]


def _features(spark: SparkSession, d: str, backtest: bool = False) -> DataFrame:
    return _built("features", spark, d, backtest, lambda: features.build(_all_layers(spark, d), W, backtest))


def _min_of(name: str, layer: str, where: str) -> str:
    return f"(SELECT min({_D}) FROM {layer} b WHERE {where}) AS {name}"


def _features_sql(backtest: bool) -> str:
    charger = "false" if backtest else "access <> 'private'"
    return _with(
        "candidates", "pixels", "pois", "chargers", "power", "places", "districts", "roads",
        more=f"""{_POI}, {_POP}, {_RATIO}, {_ROADS},
        road AS (SELECT candidate_id, min(dist) AS dist_road_m, arg_min(road_class, struct_pack(a := dist, b := road_id)) AS road_class, min(dist) FILTER (road_class = 'trunk') AS dist_trunk_m FROM near GROUP BY 1),
        dists AS (SELECT a.candidate_id, {_min_of("dist_charger_m", "chargers", charger)}, {_min_of("dist_substation_m", "power", "power = 'substation'")}, {_min_of("dist_line_m", "power", "power = 'line'")},
            {_min_of("dist_centre_m", "places", "place = 'city'")}, {_min_of("dist_town_m", "places", "place = 'town'")},
            (SELECT count(*) FROM chargers b WHERE {charger} AND {_D} <= 2000) AS chargers_10km, (SELECT count(*) FROM chargers b WHERE {charger} AND {_D} <= 5000) AS chargers_25km FROM candidates a),
        feats AS (SELECT c.candidate_id, c.host_type, c.district_id, c.x, c.y, pop_1km, pop_5km, pop_10km, poi_1km, poi_3km, dist_charger_m, chargers_10km, chargers_25km, dist_substation_m, dist_line_m, dist_centre_m, dist_town_m,
            dist_road_m, road_class, dist_trunk_m, grid_completeness_ratio
            FROM candidates c JOIN poi USING (candidate_id) JOIN pop USING (candidate_id) JOIN dists USING (candidate_id) JOIN road USING (candidate_id) LEFT JOIN ratio USING (district_id))""",
    )


_FEATURE_COLUMNS = ("pop_1km", "pop_5km", "pop_10km", "poi_1km", "poi_3km", "chargers_10km", "chargers_25km")
_DISTANCES = ("dist_charger_m", "dist_substation_m", "dist_line_m", "dist_centre_m", "dist_town_m", "dist_road_m", "dist_trunk_m", "grid_completeness_ratio")
_SELECT_FEATURES = "SELECT candidate_id, road_class, " + ", ".join(_FEATURE_COLUMNS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _DISTANCES) + " FROM feats"


def _shown(f: DataFrame) -> DataFrame:
    return f.select("candidate_id", "road_class", *_FEATURE_COLUMNS, *[F.round(c, 6).alias(c) for c in _DISTANCES])


@query(_features_sql(False) + _SELECT_FEATURES)
def h05_features_production(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_features(spark, d))


@query(_features_sql(True) + _SELECT_FEATURES)
def h05_features_backtest(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_features(spark, d, True))


def _points_sql() -> str:
    out = []
    for group in S.COMPONENTS.values():
        for f in group:
            p = f"100.0 * ((rank() OVER (ORDER BY {f}) - 1) + 0.5 * count(*) OVER (PARTITION BY {f})) / count({f}) OVER ()"
            p = f"100.0 - {p}" if f in S.LOWER_IS_BETTER else p
            out.append(f"CASE WHEN {f} IS NULL THEN 0.0 ELSE {p} END AS pct_{f}")
    return "points AS (SELECT *, " + ", ".join(out) + " FROM feats)"


def _case(column: str, table: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def _scores_sql() -> str:
    bonus = {"host_commercial": "host_bonus", "access": "road_bonus"}
    comps = ", ".join(
        f"least(100.0, {' + '.join(f'CAST({w} AS DOUBLE) * pct_{f}' for f, w in g.items())} + {bonus.get(n, '0')}) AS raw_{n}" for n, g in S.COMPONENTS.items()
    )
    final = ", ".join(f"CASE WHEN missing THEN 0.0 ELSE raw_{n} END AS component_{n}" if n == "grid_evidence" else f"raw_{n} AS component_{n}" for n in S.COMPONENTS)
    of = {p: " + ".join(f"CAST({w} AS DOUBLE) * component_{c}" for c, w in t.items()) for p, t in S.PROFILES.items()}
    factors = "CAST(coalesce(grid_completeness_ratio < 0.5, false) AS INT) + CAST(host_type = 'none' AS INT) + CAST(poi_3km <= 0 AS INT)"
    reasons = "concat_ws('; ', CASE WHEN missing THEN 'Grid evidence missing' END, CASE WHEN coalesce(grid_completeness_ratio < 0.5, false) THEN 'District with sparse map coverage' END, CASE WHEN host_type = 'none' THEN 'No identified host' END, CASE WHEN poi_3km <= 0 THEN 'Remote location' END)"
    return f"""{_points_sql()},
        bonus AS (SELECT *, {_case("host_type", S.HOST_BONUS)} AS host_bonus, {_case("road_class", S.ROAD_BONUS)} AS road_bonus,
            NOT coalesce((dist_substation_m <= 1500) OR (dist_line_m <= 1500), false) AS missing,
            CASE WHEN coalesce((dist_centre_m <= 10000) OR (dist_town_m <= 3000), false) THEN 'urban' ELSE 'corridor' END AS profile FROM points),
        comps AS (SELECT *, {comps} FROM bonus),
        finals AS (SELECT *, {final} FROM comps),
        scored AS (SELECT *, CASE WHEN profile = 'urban' THEN {of["urban"]} ELSE {of["corridor"]} END AS score,
            CASE WHEN missing THEN 'Low' WHEN {factors} = 0 THEN 'High' WHEN {factors} = 1 THEN 'Medium' ELSE 'Low' END AS confidence, {reasons} AS reasons FROM finals),
        scores AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, candidate_id) AS rank FROM scored)"""


def _scores(spark: SparkSession, d: str, backtest: bool = False) -> DataFrame:
    return _built("scores", spark, d, backtest, lambda: scoring.score(_features(spark, d, backtest), W))


_SCORES = _features_sql(False).rstrip() + ", " + _scores_sql() + " "
_SELECT_SCORES = "SELECT candidate_id, profile, confidence, CASE WHEN reasons = '' THEN 'No lowering factor' ELSE reasons END AS reasons, CASE WHEN missing THEN 'UNKNOWN' ELSE 'CALCULATED' END AS grid_status, rank, round(score, 8) AS score, " + ", ".join(f"round(component_{n}, 6) AS component_{n}" for n in S.COMPONENTS) + " FROM scores"


def _shown_scores(s: DataFrame) -> DataFrame:
    return s.select("candidate_id", "profile", "confidence", F.col("confidence_reasons").alias("reasons"), F.col("grid_evidence_status").alias("grid_status"), "rank", F.round("score", 8).alias("score"), *[F.round(f"component_{n}", 6).alias(f"component_{n}") for n in S.COMPONENTS])


@query(_SCORES + _SELECT_SCORES)
def c04_scores(spark: SparkSession, d: str) -> DataFrame:
    return _shown_scores(_scores(spark, d))


@query(_features_sql(True).rstrip() + ", " + _scores_sql() + " " + _SELECT_SCORES)
def c04_scores_backtest(spark: SparkSession, d: str) -> DataFrame:
    return _shown_scores(_scores(spark, d, True))


@query(_features_sql(False).rstrip() + ", " + _points_sql() + " SELECT candidate_id, " + ", ".join(f"round(pct_{f}, 6) AS pct_{f}" for g in S.COMPONENTS.values() for f in g) + " FROM points")
def w02_feature_points(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.feature_points(_features(spark, d))
    return p.select("candidate_id", *[F.round(f"pct_{f}", 6).alias(f"pct_{f}") for g in S.COMPONENTS.values() for f in g])


@query("SELECT c_custkey, round(100.0 * ((rank() OVER (ORDER BY c_nationkey) - 1) + 0.5 * count(*) OVER (PARTITION BY c_nationkey)) / count(*) OVER (), 9) AS pct FROM customer")
def w01_mid_rank(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    return scoring.mid_rank(c, ["c_nationkey"]).select("c_custkey", F.round("pct_c_nationkey", 9).alias("pct"))


@query(_SCORES + "SELECT candidate_id, rank, round(score, 8) AS score FROM scores ORDER BY rank LIMIT 30")
def w05_top_sites(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).orderBy("rank").limit(30).select("candidate_id", "rank", F.round("score", 8).alias("score"))


@query(_SCORES + "SELECT profile, confidence, count(*) AS n, round(min(score), 8) AS lo, round(median(score), 8) AS mid, round(max(score), 8) AS hi FROM scores GROUP BY 1, 2")
def a09_score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.groupBy("profile", "confidence").agg(F.count("*").alias("n"), F.round(F.min("score"), 8).alias("lo"), F.round(F.median("score"), 8).alias("mid"), F.round(F.max("score"), 8).alias("hi"))


_FIGURES = ["score", *[f"component_{n}" for n in S.COMPONENTS], *[f"pct_{f}" for g in S.COMPONENTS.values() for f in g]]


@query(_SCORES.rstrip().replace("scores AS (", "scores AS MATERIALIZED (") + " " + " UNION ALL ".join(f"SELECT '{f}' AS figure, count_if({f} IS NULL OR {f} < -1e-9 OR {f} > 100 + 1e-9) AS breaches FROM scores" for f in _FIGURES) + " UNION ALL SELECT 'rank', greatest(count(*), max(rank)) - count(DISTINCT rank) FROM scores")
def v08_score_bounds(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bounds(_scores(spark, d))


# --- ordered selections -----------------------------------------------------------------------

_MERGED = f"""edges AS (SELECT a.charger_id AS u, b.charger_id AS v FROM {_within('chargers', 'chargers', 2500)} WHERE {_D} <= 2500),
    reach AS (SELECT charger_id AS n, charger_id AS r FROM chargers UNION SELECT e.u, r.r FROM reach r JOIN edges e ON e.v = r.n),
    parts AS (SELECT n, min(r) AS part FROM reach GROUP BY 1),
    sites AS (SELECT part, arg_min(charger_id, source_rank * 1000000 + charger_id) AS site_id FROM parts JOIN chargers ON n = charger_id GROUP BY 1)"""


@query("WITH RECURSIVE " + world.sql("chargers") + ", " + _MERGED + " SELECT n AS charger_id, site_id FROM parts JOIN sites USING (part)")
def h03_merge_chargers(spark: SparkSession, d: str) -> DataFrame:
    (ch,) = _layers(spark, d, "chargers")
    return features.merge_chargers(ch, W.merge_m).select("charger_id", "site_id")


def _dedup_sql(rounds: int = 8) -> str:
    """The rounds of priority deduplication unrolled: keep what no open earlier neighbour blocks, drop what a kept one is near."""
    place = "CASE host_type " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(S.HOST_PRIORITY)) + " END"
    ctes = [
        f"ord AS (SELECT candidate_id, x, y, {place} * 10000000 + CASE WHEN origin = 'host' THEN 0 ELSE 5000000 END + candidate_id AS o FROM candidates)",
        f"edges AS MATERIALIZED (SELECT a.candidate_id AS a, b.candidate_id AS b, a.o AS ao FROM {_within('ord', 'ord', 1000)} WHERE {_D} <= 1000 AND a.o < b.o)",
        "s0 AS (SELECT candidate_id, CAST(NULL AS BOOLEAN) AS kept FROM ord)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"k{i} AS MATERIALIZED (SELECT s.candidate_id, CASE WHEN s.kept IS NOT NULL THEN s.kept WHEN NOT EXISTS (SELECT 1 FROM edges e JOIN s{i - 1} t ON t.candidate_id = e.a WHERE e.b = s.candidate_id AND coalesce(t.kept, true)) THEN true END AS kept FROM s{i - 1} s)")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT s.candidate_id, CASE WHEN s.kept IS NOT NULL THEN s.kept WHEN EXISTS (SELECT 1 FROM edges e JOIN k{i} t ON t.candidate_id = e.a WHERE e.b = s.candidate_id AND t.kept) THEN false END AS kept FROM k{i} s)")
    ctes.append(f"into_ AS (SELECT e.b AS candidate_id, arg_min(e.a, e.ao) AS merged_into FROM edges e JOIN s{rounds} t ON t.candidate_id = e.a WHERE t.kept GROUP BY 1)")
    return _with("candidates", more=", ".join(ctes)) + f"SELECT s.candidate_id, s.kept, CASE WHEN NOT s.kept THEN i.merged_into END AS merged_into, CASE WHEN s.kept THEN (SELECT count(*) FROM into_ j JOIN s{rounds} u USING (candidate_id) WHERE j.merged_into = s.candidate_id AND NOT u.kept) END AS merged_count FROM s{rounds} s LEFT JOIN into_ i USING (candidate_id)"


@query(_dedup_sql())
def g03_priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    (cand,) = _layers(spark, d, "candidates")
    return ordered.priority_dedup(cand, "candidate_id", ordered.host_order(), W.dedup_m)


_QUOTA = "counts AS (SELECT district_id, count(*) AS n FROM candidates GROUP BY 1), shares AS (SELECT *, floor(300 * n / (SELECT sum(n) FROM counts)) AS low, (300 * n) % (SELECT CAST(sum(n) AS BIGINT) FROM counts) AS rest FROM counts), quotas AS (SELECT district_id, n, CAST(low AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY rest DESC, district_id) <= 300 - (SELECT sum(low) FROM shares) THEN 1 ELSE 0 END AS quota FROM shares)"


@query(_with("candidates", more=_QUOTA.replace("300", "150")) + "SELECT district_id, n, quota FROM quotas")
def a14_quotas(spark: SparkSession, d: str) -> DataFrame:
    (cand,) = _layers(spark, d, "candidates")
    return ordered.allocate_quotas(cand.groupBy("district_id").agg(F.count("*").alias("n")), "district_id", 150)


@query()
def g07_budget(spark: SparkSession, d: str) -> DataFrame:
    """The largest radius that meets a quota has no plain SQL; a brute-force test holds it."""
    (cand,) = _layers(spark, d, "candidates")
    return ordered.apply_budget(cand, "candidate_id", "district_id", [ordered.host_order()], 150).withColumn("radius", F.round("radius", 6))


@query(_with("candidates", "roads", more=_ROADS) + ", road AS (SELECT candidate_id, min(dist) AS m FROM near GROUP BY 1) SELECT count_if(m > 2500) AS far_from_road, count_if(host_type = 'none') AS no_host, count_if(m > 2500 OR host_type = 'none') AS any_reason FROM candidates JOIN road USING (candidate_id)".replace(", road AS", ", road AS", 1))
def g04_filters(spark: SparkSession, d: str) -> DataFrame:
    cand, roads = _layers(spark, d, "candidates", "roads")
    near = spatial.nearest_segment(cand, roads, "candidate_id", "road_id", W.start_m)
    far, none = F.col("dist") > W.road_m, F.col("host_type") == "none"
    return cand.join(near, "candidate_id").agg(F.count_if(far).alias("far_from_road"), F.count_if(none).alias("no_host"), F.count_if(far | none).alias("any_reason"))


# --- networks -----------------------------------------------------------------------------------

_ELIGIBLE = "ranked AS (SELECT *, 100.0 * ((rank() OVER (ORDER BY score) - 1) + 0.5 * count(*) OVER (PARTITION BY score)) / count(*) OVER () AS pct FROM scores), eligible AS (SELECT * FROM ranked WHERE pct >= 50 AND host_type <> 'none')"


def _problem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Eligible sites, weighted nodes, coverage, and conflicts, which grow with the square of the sites and are found only where they are read."""
    px, ch, districts = _layers(spark, d, "pixels", "chargers", "districts")
    sites = network.eligible(_scores(spark, d).join(districts.select("district_id", "province_id"), "district_id"), W.percentile, 1)
    weights = stored(network.demand_weights(network.demand_nodes(px, 2500), features.production_chargers(ch), W.service_m, W.charger_factor))
    cover = stored(network.coverage(sites, weights, W.service_m))
    return sites, weights, cover, network.conflicts(sites, W.spacing_m)


_PROBLEM = _SCORES.rstrip() + f", {_NODES}, {_OPEN}, {_WEIGHTS}, {_ELIGIBLE}, cover AS (SELECT a.candidate_id, b.node_id FROM {_within('eligible', 'weights', 3000)} WHERE {_D} <= 3000) "
_PROBLEM = _PROBLEM.replace("WITH candidates", "WITH candidates")


@query(_PROBLEM + "SELECT candidate_id, node_id FROM cover")
def n01_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _problem(spark, d)[2]


@query(_PROBLEM + f"SELECT a.candidate_id AS a, b.candidate_id AS b FROM {_within('eligible', 'eligible', 2000)} WHERE {_D} < 2000 AND a.candidate_id < b.candidate_id")
def n02_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _problem(spark, d)[3]


@query()
def n04_greedy_network(spark: SparkSession, d: str) -> DataFrame:
    """Each round depends on the one before; a brute-force test holds it."""
    sites, weights, cover, _ = _problem(spark, d)
    return network.greedy(cover, weights, W.spacing_m, sites, 10, W.score_weight).withColumn("gain", F.round("gain", 9))


@query()
def n03_exact_network(spark: SparkSession, d: str) -> DataFrame:
    """The best three sites of the best-ranked forty; a brute-force test holds the search."""
    sites, weights, cover, _ = _problem(spark, d)
    few = stored(sites.orderBy("rank").limit(40))
    got, value, status = network.solve_exact(cover, weights, stored(network.conflicts(few, W.spacing_m)), few, 3, W.score_weight, 60)
    return spark.createDataFrame([(s, round(value, 9), status) for s in got], "candidate_id long, objective double, status string")


_TOP = _PROBLEM.rstrip() + ", selected AS (SELECT * FROM eligible ORDER BY rank LIMIT 30)"


@query(_TOP + ", covered AS (SELECT DISTINCT node_id FROM cover WHERE candidate_id IN (SELECT candidate_id FROM selected)) SELECT (SELECT count(*) FROM selected) AS sites, (SELECT round(sum(weight), 9) FROM weights WHERE node_id IN (SELECT node_id FROM covered)) AS demand, (SELECT CAST(sum(people) AS BIGINT) FROM weights WHERE node_id IN (SELECT node_id FROM covered)) AS people, round((SELECT sum(people) FROM weights WHERE node_id IN (SELECT node_id FROM covered)) / (SELECT sum(people) FROM weights), 9) AS people_share, (SELECT count(DISTINCT province_id) FROM selected JOIN districts USING (district_id)) AS provinces, (SELECT count(DISTINCT district_id) FROM selected) AS districts, (SELECT round(avg(score), 6) FROM selected) AS mean_score")
def a10_selection_summary(spark: SparkSession, d: str) -> DataFrame:
    sites, weights, cover, _ = _problem(spark, d)
    return network.summarise(sites.orderBy("rank").limit(30), cover, weights, sites)


@query(_TOP + ", times AS (SELECT node_id, count_if(candidate_id IN (SELECT candidate_id FROM selected)) AS times FROM cover GROUP BY 1) SELECT candidate_id, candidate_id IN (SELECT candidate_id FROM selected) AS selected, round(sum(CASE WHEN times = CASE WHEN candidate_id IN (SELECT candidate_id FROM selected) THEN 1 ELSE 0 END THEN weight ELSE 0 END), 9) AS marginal FROM cover JOIN times USING (node_id) JOIN weights USING (node_id) GROUP BY 1, 2")
def a11_marginal_coverage(spark: SparkSession, d: str) -> DataFrame:
    sites, weights, cover, _ = _problem(spark, d)
    return network.marginal_coverage(cover, weights, sites.orderBy("rank").limit(30))


@query(_TOP + f", pairs AS (SELECT a.candidate_id, b.candidate_id AS other_id, {_D} AS dist FROM selected a JOIN selected b ON a.candidate_id <> b.candidate_id WHERE {_D} <= 20000) SELECT s.candidate_id, arg_min(other_id, struct_pack(d := dist, o := other_id)) AS nearest_id, round(min(dist), 6) AS nearest_m, count_if(dist < 2000) AS too_near, count(dist) AS within FROM selected s LEFT JOIN pairs USING (candidate_id) GROUP BY 1")
def q05_contribution(spark: SparkSession, d: str) -> DataFrame:
    sites = _problem(spark, d)[0]
    return network.contribution(sites.orderBy("rank").limit(30), W.spacing_m, 20000)


@query(_with("candidates") + f"SELECT candidate_id, other_id, round(dist, 6) AS dist, nth, total FROM (SELECT a.candidate_id, b.candidate_id AS other_id, {_D} AS dist, row_number() OVER (PARTITION BY a.candidate_id ORDER BY {_D}, b.candidate_id) AS nth, count(*) OVER (PARTITION BY a.candidate_id) AS total FROM {_within('candidates', 'candidates', 1500)} WHERE {_D} <= 1500 AND a.candidate_id <> b.candidate_id) WHERE nth <= 3")
def w08_nearby_sites(spark: SparkSession, d: str) -> DataFrame:
    (cand,) = _layers(spark, d, "candidates")
    return network.nearby(cand, 1500, 3)


@query()
def n05_spaced_top(spark: SparkSession, d: str) -> DataFrame:
    """Each acceptance depends on those before; a brute-force test holds it."""
    s = _scores(spark, d)
    return ordered.spaced_top(s, "candidate_id", 4000, 20)


# --- evaluation ---------------------------------------------------------------------------------

_HITS = _SCORES.rstrip() + f", hits AS (SELECT a.candidate_id, a.rank, EXISTS (SELECT 1 FROM chargers b WHERE access <> 'private' AND {_D} <= 1000) AS hit FROM scores a)"


def _hit_table(spark: SparkSession, d: str) -> DataFrame:
    (ch,) = _layers(spark, d, "chargers")
    s = _scores(spark, d)
    near = spatial.count_within(s, features.production_chargers(ch), "candidate_id", {"known": W.hit_m})
    return stored(s.join(near, "candidate_id").withColumn("hit", F.col("known") > 0).drop("known"))


@query(_HITS + " SELECT k, CAST((SELECT count(*) FROM hits WHERE hit AND rank <= k) AS BIGINT) AS hits, (SELECT count(*) FROM hits WHERE hit AND rank <= k) / k AS precision, (SELECT count(*) FROM hits WHERE hit AND rank <= k) / nullif((SELECT count(*) FROM hits WHERE hit), 0) AS recall FROM (VALUES (10), (20), (30)) AS t(k)")
def a15_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.at_k(_hit_table(spark, d), W.k)


_RUNS = "draws AS (SELECT unnest(range(1000)) AS run), grid AS (SELECT unnest([10, 20, 30])::INT AS k)"


@query(_HITS + f", {_RUNS}, drawn AS (SELECT run, hit, row_number() OVER (PARTITION BY run ORDER BY md5('20260924:' || run || ':' || candidate_id), candidate_id) AS nth FROM hits CROSS JOIN draws), p AS (SELECT run, k, count_if(hit) / k AS precision FROM drawn JOIN grid ON nth <= k GROUP BY 1, 2) SELECT k, round(avg(precision), 9) AS mean, round(quantile_cont(precision, 0.025), 9) AS low, round(quantile_cont(precision, 0.975), 9) AS high FROM p GROUP BY 1")
def a16_random_baseline(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.random_baseline(_hit_table(spark, d), W.k)


_RESAMPLED = _HITS.replace("SELECT a.candidate_id, a.rank,", "SELECT a.candidate_id, a.score, CAST(a.pop_5km AS DOUBLE) AS people,") + f""", {_RUNS}, numbered AS (SELECT *, row_number() OVER (ORDER BY candidate_id) AS nth FROM hits),
    picked AS MATERIALIZED (SELECT run, p.nth AS place, n.candidate_id, n.hit, n.score, n.people FROM numbered p CROSS JOIN draws JOIN numbered n ON n.nth = CAST('0x' || substr(md5('20260924:' || run || ':' || p.nth), 1, 8) AS BIGINT) % (SELECT count(*) FROM hits) + 1),
    tops AS (SELECT 'score' AS method, run, hit, row_number() OVER (PARTITION BY run ORDER BY score DESC, candidate_id, place) AS nth FROM picked UNION ALL SELECT 'people', run, hit, row_number() OVER (PARTITION BY run ORDER BY people DESC, candidate_id, place) FROM picked),
    p AS (SELECT method, run, k, count_if(hit) / k AS precision FROM tops JOIN grid ON nth <= k GROUP BY 1, 2, 3),
    every AS (SELECT * FROM p UNION ALL SELECT 'difference', run, k, a.precision - b.precision FROM p a JOIN p b USING (run, k) WHERE a.method = 'score' AND b.method = 'people')"""


@query(_RESAMPLED + " SELECT method, k, round(quantile_cont(precision, 0.025), 9) AS low, round(quantile_cont(precision, 0.975), 9) AS high FROM every GROUP BY 1, 2")
def a17_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    t = _hit_table(spark, d).withColumn("people", F.col("pop_5km").cast("double"))
    return evaluation.bootstrap(t.select("candidate_id", "hit", "score", "people"), ("score", "people"), W.k)


def _stability_sql() -> str:
    parts = []
    for name, comps, profiles in [("base", S.COMPONENTS, S.PROFILES), *evaluation.variants()]:
        bonus = {"host_commercial": "host_bonus", "access": "road_bonus"}
        c = {n: f"least(100.0, {' + '.join(f'CAST({w!r} AS DOUBLE) * pct_{f}' for f, w in g.items())} + {bonus.get(n, '0')})" for n, g in comps.items()}
        c["grid_evidence"] = f"CASE WHEN missing THEN 0.0 ELSE {c['grid_evidence']} END"
        of = {p: " + ".join(f"CAST({w!r} AS DOUBLE) * ({c[k]})" for k, w in t.items()) for p, t in profiles.items()}
        parts.append(f"SELECT candidate_id FROM scores ORDER BY round(CASE WHEN profile = 'urban' THEN {of['urban']} ELSE {of['corridor']} END, 9) DESC, candidate_id LIMIT 30")
    names = ["base", *[v[0] for v in evaluation.variants()]]
    tops = ", ".join(f"t{i} AS ({p})" for i, p in enumerate(parts))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) / 30 AS overlap FROM t{i} JOIN t0 USING (candidate_id)" for i, n in enumerate(names) if i)
    return _SCORES.rstrip().replace("scores AS (", "scores AS MATERIALIZED (") + ", " + tops + " " + rows


@query(_stability_sql())
def a18_stability(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stability(_scores(spark, d), W, 30)


@query("SELECT 'null p_size' AS \"check\", count_if(p_size IS NULL) AS n FROM part UNION ALL SELECT 'null p_brand', count_if(p_brand IS NULL) FROM part UNION ALL SELECT 'null p_partkey', count_if(p_partkey IS NULL) FROM part UNION ALL SELECT 'repeated ids', count(*) - count(DISTINCT p_brand) FROM part UNION ALL SELECT 'repeated places', count(*) - count(DISTINCT (p_size, p_brand)) FROM part")
def v09_data_quality(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_size", "p_brand", "p_partkey")
    row = p.agg(*[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in p.columns], (F.count("*") - F.count_distinct("p_brand")).alias("repeated ids"), (F.count("*") - F.count_distinct(F.struct("p_size", "p_brand"))).alias("repeated places"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in row.columns])).alias("r")).select("r.*")


# --- evidence -----------------------------------------------------------------------------------

_SHOWN = {
    display.one_decimal: "printf('%.1f', CAST({n} AS DOUBLE))", display.ratio: "printf('%.2f', {n})", display.people: "format('{{:,d}}', CAST({n} AS BIGINT))",
    display.distance: "CASE WHEN {n} IS NULL THEN 'none mapped' WHEN {n} < 1000 THEN printf('%.0f m', {n}) ELSE printf('%.1f km', {n} / 1000) END",
}
_RECORDS_SQL = " UNION ALL ".join(
    [f"SELECT candidate_id, 'site/' || candidate_id || '/{n}' AS id, {_SHOWN[shown].format(n=n)} AS display FROM scores" for n, (_, shown) in evidence.NUMERIC.items()]
    + [f"SELECT candidate_id, 'site/' || candidate_id || '/{n}', coalesce({n if n != 'grid_evidence_status' else "CASE WHEN missing THEN 'UNKNOWN' ELSE 'CALCULATED' END"}, 'unknown') FROM scores" for n in evidence.CATEGORICAL]
)


@query(_SCORES + "SELECT candidate_id, CASE WHEN dist_charger_m IS NULL THEN 'none mapped' WHEN dist_charger_m < 1000 THEN printf('%.0f m', dist_charger_m) ELSE printf('%.1f km', dist_charger_m / 1000) END AS distance, printf('%.1f', score) AS score, format('{:,d}', pop_10km) AS people, printf('%.2f', grid_completeness_ratio) AS ratio, printf('%.0f', component_access / 100 * 100) || '%' AS share FROM scores")
def e02_displays(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("candidate_id", display.distance(F.col("dist_charger_m")).alias("distance"), display.one_decimal(F.col("score")).alias("score"), display.people(F.col("pop_10km")).alias("people"), display.ratio(F.col("grid_completeness_ratio")).alias("ratio"), display.percent(F.col("component_access") / 100).alias("share"))


@query(_SCORES + "SELECT 'site/' || candidate_id || '/' || metric AS id, metric, CASE WHEN v IS NULL THEN 'UNKNOWN' ELSE 'CALCULATED' END AS type, round(v, 8) AS value_d FROM (" + " UNION ALL ".join(f"SELECT candidate_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS v FROM scores" for n in evidence.NUMERIC) + ")")
def e03_site_records(spark: SparkSession, d: str) -> DataFrame:
    return evidence.site_records(_scores(spark, d)).where("kind = 'numeric'").select("id", "metric", "type", F.round("value_d", 8).alias("value_d"))


@query(
    _SCORES
    + "SELECT a.candidate_id AS a, b.candidate_id AS b, v.metric, v.relation FROM scores a JOIN scores b ON b.rank = a.rank + 1, LATERAL (SELECT unnest(["
    + ", ".join(f"struct_pack(metric := '{n}', relation := CASE WHEN a.{n} = b.{n} THEN 'equal' WHEN a.{n} > b.{n} THEN 'a_greater' WHEN a.{n} < b.{n} THEN 'b_greater' END)" for n in ("rank", "poi_3km", "pop_10km", "host_bonus", "chargers_25km"))
    + ", "
    + ", ".join(f"struct_pack(metric := '{n}', relation := CASE WHEN a.{n} = b.{n} THEN 'same' WHEN a.{n} <> b.{n} THEN 'different' END)" for n in ("host_type", "profile", "confidence", "road_class"))
    + "], recursive := true)) AS v"
)
def q03_compare_sites(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    a, b = (s.select(F.col("candidate_id").alias(n), (F.col("rank") - k).alias("at")) for n, k in (("a", 0), ("b", 1)))
    pairs = a.join(b, "at").select("a", "b")
    out = evidence.compare_sites(evidence.site_records(s), pairs)
    return out.where(F.col("metric").isin("rank", "poi_3km", "pop_10km", "host_bonus", "chargers_25km", "host_type", "profile", "confidence", "road_class")).select("a", "b", "metric", "relation")


@query(_SCORES + "SELECT candidate_id, rank FROM scores WHERE host_type = 'fuel' AND profile = 'urban' AND confidence = 'High'")
def p10_find_sites(spark: SparkSession, d: str) -> DataFrame:
    return evidence.find_sites(_scores(spark, d), host_type="fuel", profile="urban", confidence="High").select("candidate_id", "rank")


@query(_SCORES + "SELECT candidate_id, c.component, round(c.value, 6) AS value, round(c.value * CASE WHEN profile = 'urban' THEN c.u ELSE c.k END, 8) AS points FROM scores, LATERAL (SELECT unnest([" + ", ".join(f"struct_pack(component := '{n}', value := component_{n}, u := CAST({S.PROFILES['urban'][n]} AS DOUBLE), k := CAST({S.PROFILES['corridor'][n]} AS DOUBLE))" for n in S.PROFILES["urban"]) + "], recursive := true)) AS c")
def q04_explain_score(spark: SparkSession, d: str) -> DataFrame:
    return evidence.explain(_scores(spark, d), S.PROFILES).select("candidate_id", "component", F.round("value", 6).alias("value"), F.round("points", 8).alias("points"))


@query("SELECT p_partkey, 'cand-' || substr(sha256(CAST(p_partkey AS VARCHAR) || ',' || p_name), 1, 12) AS id FROM part")
def p12_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", stable_id("cand", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")).alias("id"))
