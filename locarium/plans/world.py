"""A deterministic world of sites, derived from the order tables.

Each layer is one SQL text that any engine runs alike; coordinates are
integer arithmetic in metres on a square of some 50 km.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _xy(key: str, salt: int) -> str:
    k = f"(CAST({key} AS BIGINT) + {salt})"
    return f"CAST(({k} * {k} * 31 + {k} * 7919) % 50021 AS DOUBLE) AS x, CAST(({k} * {k} * 47 + {k} * 104729) % 50023 AS DOUBLE) AS y"


#: The numbers 0 to 12.
_NUMBERS = " UNION ALL ".join(f"SELECT {i} AS {{n}}" for i in range(13))

LAYERS: dict[str, str] = {
    "candidates": f"""SELECT p_partkey AS candidate_id,
        CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_type = 'STANDARD' THEN 'fuel' WHEN p_type = 'PROMO' THEN 'mall'
             WHEN p_type = 'SMALL' THEN 'supermarket' WHEN p_type = 'MEDIUM' THEN 'logistics' WHEN p_type = 'LARGE' THEN 'industrial' ELSE 'hotel' END AS host_type,
        CASE WHEN p_partkey % 11 = 0 THEN 'corridor' ELSE 'host' END AS origin,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 1500 END AS host_poi_id,
        CAST(p_partkey % 25 AS BIGINT) AS district_id, {_xy("p_partkey", 1)} FROM part""",
    "pois": f"""SELECT c_custkey AS poi_id,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'fuel' WHEN 'BUILDING' THEN 'shop' WHEN 'FURNITURE' THEN 'food' WHEN 'HOUSEHOLD' THEN 'lodging' ELSE 'services' END AS kind,
        {_xy("c_custkey", 100003)} FROM customer""",
    "chargers": f"""SELECT s_suppkey AS charger_id, CASE WHEN s_suppkey % 7 = 0 THEN 'private' ELSE 'public' END AS access, CAST(s_suppkey % 3 AS INT) AS source_rank,
        {_xy("s_suppkey", 200003)} FROM supplier""",
    "pixels": f"""SELECT o_orderkey AS pixel_id, CAST(floor(o_totalprice / 100) AS BIGINT) AS people, {_xy("o_orderkey", 300007)} FROM orders""",
    "power": f"""SELECT power_id, power, x, y, x AS x1, y AS y1, CASE power WHEN 'line' THEN x + power_id * 37 % 6001 - 3000 ELSE x END AS x2, CASE power WHEN 'line' THEN y + power_id * 53 % 6007 - 3000 ELSE y END AS y2
        FROM (SELECT o_orderkey AS power_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'substation' WHEN '2-HIGH' THEN 'line' WHEN '3-MEDIUM' THEN 'pole' ELSE 'other' END AS power, {_xy("o_orderkey", 400009)} FROM orders)""",
    "places": f"""SELECT CAST(n_nationkey AS BIGINT) AS place_id, CASE WHEN n_nationkey = 12 THEN 'city' WHEN n_nationkey % 2 = 0 THEN 'town' ELSE 'village' END AS place, {_xy("n_nationkey", 500009)} FROM nation""",
    "districts": """SELECT CAST(n_nationkey AS BIGINT) AS district_id, n_name AS district, r_name AS province, CAST(r_regionkey AS BIGINT) AS province_id,
        CAST(n_nationkey % 5 AS DOUBLE) * 10005.0 AS x0, CAST(floor(n_nationkey / 5) AS DOUBLE) * 10005.0 AS y0, 100.1 + CAST(n_nationkey AS DOUBLE) AS area_km2
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "roads": f"""SELECT a.place_id AS road_id, CASE a.place_id % 3 WHEN 0 THEN 'trunk' WHEN 1 THEN 'primary' ELSE 'residential' END AS road_class, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS place_id, {_xy("n_nationkey", 500009)} FROM nation) a
        JOIN (SELECT CAST(n_nationkey AS BIGINT) - 1 AS place_id, {_xy("n_nationkey", 500009)} FROM nation) b ON a.place_id = b.place_id""",
    "streets": f"""SELECT street_id, CASE street_id % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'trunk' WHEN 2 THEN 'trunk' ELSE 'primary' END AS road_class,
        CASE street_id % 3 WHEN 0 THEN 100 * floor(x / 100) WHEN 1 THEN 500 * floor(x / 500) ELSE x END AS x1, CASE street_id % 3 WHEN 0 THEN 500 * floor(y / 500) WHEN 1 THEN 100 * floor(y / 100) ELSE y END AS y1,
        CASE street_id % 3 WHEN 0 THEN 100 * floor(x / 100) + 100 * (5 + street_id % 20) WHEN 1 THEN 500 * floor(x / 500) ELSE x + street_id * 37 % 4001 - 2000 END AS x2,
        CASE street_id % 3 WHEN 0 THEN 500 * floor(y / 500) WHEN 1 THEN 100 * floor(y / 100) + 100 * (5 + street_id % 20) ELSE y + street_id * 53 % 4003 - 2000 END AS y2
        FROM (SELECT CAST(c_custkey AS BIGINT) AS street_id, {_xy("c_custkey", 600011)} FROM customer)""",
    "plots": f"""SELECT plot_id, plot_id % 5 AS zone, 100.0 * floor(x / 100) AS x, 100.0 * floor(y / 100) AS y, 100.0 * (3 + plot_id % 5) AS w, 100.0 * (3 + plot_id % 4) AS h, 100.0 * (1 + plot_id % 2) AS a, 100.0 * (1 + floor(plot_id / 2) % 2) AS b
        FROM (SELECT CAST(p_partkey AS BIGINT) AS plot_id, {_xy("p_partkey", 700001)} FROM part)""",
    "element_nodes": f"""SELECT 20 * k + j AS node_id,
        x + CASE j WHEN 1 THEN w WHEN 2 THEN w WHEN 4 THEN 100 WHEN 5 THEN w - 200 WHEN 6 THEN w - 200 WHEN 7 THEN 100 WHEN 8 THEN 200 WHEN 9 THEN w - 300 WHEN 10 THEN w - 300 WHEN 11 THEN 200 WHEN 12 THEN 50 ELSE 0 END AS x,
        y + CASE j WHEN 2 THEN h WHEN 3 THEN h WHEN 4 THEN 100 WHEN 5 THEN 100 WHEN 6 THEN h - 200 WHEN 7 THEN h - 200 WHEN 8 THEN 200 WHEN 9 THEN 200 WHEN 10 THEN h - 300 WHEN 11 THEN h - 300 WHEN 12 THEN 50 ELSE 0 END AS y,
        CASE WHEN j = 12 THEN CASE k % 2 WHEN 0 THEN 'power' ELSE 'place' END END AS tag, CASE WHEN j = 12 THEN CASE k % 2 WHEN 0 THEN 'tower' ELSE 'village' END END AS value
        FROM (SELECT k, 100.0 * floor(x / 100) AS x, 100.0 * floor(y / 100) AS y, 100.0 * (6 + k % 5) AS w, 100.0 * (6 + k % 4) AS h FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {_xy("p_partkey", 800011)} FROM part)) CROSS JOIN ({_NUMBERS.format(n="j")})
        WHERE j < 13 AND NOT (j = 3 AND k % 7 = 3)""",
    "element_ways": f"""SELECT 10 * k + i AS way_id, CASE i WHEN 5 THEN CASE k % 4 WHEN 0 THEN 'natural' END WHEN 6 THEN 'highway' WHEN 7 THEN 'power' WHEN 8 THEN 'natural' WHEN 9 THEN 'highway' END AS tag,
        CASE i WHEN 5 THEN CASE k % 4 WHEN 0 THEN 'water' END WHEN 6 THEN 'primary' WHEN 7 THEN CASE k % 2 WHEN 0 THEN 'line' ELSE 'substation' END WHEN 8 THEN 'water' WHEN 9 THEN 'track' END AS value, refs
        FROM (SELECT k, i, CASE i WHEN 0 THEN '0 1 2' WHEN 1 THEN CASE k % 2 WHEN 0 THEN '2 3' ELSE '3 2' END WHEN 2 THEN '3 0'
            WHEN 3 THEN CASE WHEN k % 7 = 4 THEN CASE k % 3 WHEN 0 THEN '0 1 2' ELSE '0 1 2 3 0' END WHEN k % 7 = 2 THEN CASE k % 3 WHEN 0 THEN '0 1 5' ELSE '0 1 5 4 0' END ELSE CASE k % 3 WHEN 0 THEN '4 5 6' ELSE '4 5 6 7 4' END END
            WHEN 4 THEN CASE WHEN k % 7 = 4 THEN '0 3 2' WHEN k % 7 = 2 THEN '0 4 5' ELSE '4 7 6' END WHEN 5 THEN '8 9 10 11 8' WHEN 6 THEN '0 5 12' WHEN 7 THEN '8 9 10 8' WHEN 8 THEN '0 1 2' ELSE CASE k % 2 WHEN 0 THEN '12 12' ELSE '12 13' END END AS refs
            FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part) CROSS JOIN ({_NUMBERS.format(n="i")}) WHERE i < 10 AND NOT (i = 1 AND k % 7 = 0) AND NOT (i = 4 AND k % 3 <> 0))""",
    "element_relations": """SELECT k AS relation_id, CASE k % 7 WHEN 1 THEN 'route' ELSE 'multipolygon' END AS type, 'natural' AS tag, 'water' AS value, CASE WHEN k % 7 = 4 THEN CASE k % 3 WHEN 0 THEN '4 3 2 1 0' ELSE '0 1 2 3' END ELSE CASE k % 3 WHEN 0 THEN '0 4 1 5 2 3' ELSE '3 0 1 2 5' END END AS members
        FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)""",
    "chunks": """SELECT doc_id AS chunk_id, lang AS doc_type, source AS topic, text FROM documents WHERE text IS NOT NULL AND text <> ''""",
    "queries": """SELECT item_id AS query_id, text FROM benchmark""",
}
#: Tables each layer reads.
TABLES = {"candidates": ("part",), "pois": ("customer",), "chargers": ("supplier",), "pixels": ("orders",), "power": ("orders",), "places": ("nation",), "districts": ("nation", "region"), "roads": ("nation",), "streets": ("customer",), "plots": ("part",), "element_nodes": ("part",), "element_ways": ("part",), "element_relations": ("part",), "chunks": ("documents",), "queries": ("benchmark",)}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A layer of the world as a DataFrame."""
    text = LAYERS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def sql(*names: str) -> str:
    """``WITH`` entries of the named layers, for an engine that has the tables as views."""
    return ",\n".join(f"{n} AS ({LAYERS[n]})" for n in names)
