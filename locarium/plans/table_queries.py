"""Queries of the layer contract over the plain tables: validation, sources, fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium.functions import geo, tags
from locarium.operators import validation
from locarium.plans import world
from locarium.sources import layers, readers
from locarium.storage import shared_folder

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


@query("SELECT 'p_name' AS \"column\", 'missing' AS problem, CAST(count_if(p_size = 7) AS BIGINT) AS n FROM part UNION ALL SELECT 'p_brand', 'repeated', count(*) - count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_size', 'type string wanted', 1 UNION ALL SELECT 'p_colour', 'no such column', 1")
def v01_schema_check(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("p_name", F.when(F.col("p_size") != 7, F.col("p_name"))).select("p_name", "p_brand", "p_size")
    wanted = [validation.Field("p_name", "string", True), validation.Field("p_brand", "string", True), validation.Field("p_size", "string", False), validation.Field("p_colour", "string", False)]
    return validation.check_table(p, wanted, key="p_brand")


@query("WITH " + world.sql("candidates") + " SELECT candidate_id, x >= 1000 AND x <= 40000 AND y >= 2000 AND y <= 30000 AS inside FROM candidates")
def v03_envelope(spark: SparkSession, d: str) -> DataFrame:
    return world.layer(spark, d, "candidates").select("candidate_id", geo.in_box(F.col("x"), F.col("y"), (1000, 2000, 40000, 30000)).alias("inside"))


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def s16_layer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A layer written, validated, read again and summed."""
    p = spark.read.parquet(f"{d}/part.parquet")
    wanted = [validation.Field(f.name, f.dataType.simpleString(), False) for f in p.schema]
    where = f"{shared_folder(spark)}/layer-part-{uuid.uuid4().hex}"
    layers.write_layer(p, where, wanted, key="p_partkey")
    return layers.read_layer(spark, where, wanted).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT s_suppkey AS row_id, list_filter([CASE WHEN s_acctbal < 0 THEN 'negative balance' END, CASE WHEN s_nationkey % 5 = 0 THEN 'closed nation' END], lambda x: x IS NOT NULL) AS problems FROM supplier WHERE s_acctbal < 0 OR s_nationkey % 5 = 0")
def s13_row_problems(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rules = {"negative balance": F.col("s_acctbal") < 0, "closed nation": F.col("s_nationkey") % 5 == 0}
    return validation.row_problems(s, "s_suppkey", rules).withColumnRenamed("s_suppkey", "row_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS large, event_type = 'click' AS clicked FROM events")
def s05_tag_selectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", (F.element_at(m, "k").cast("long") > 50).alias("large"), tags.selects(F.create_map(F.lit("type"), F.col("event_type")), "type=click").alias("clicked"))


@query("WITH " + world.sql("candidates") + " SELECT candidate_id, 2 AS places, true AS back FROM candidates")
def p01_projection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Metres to degrees and back, to the millimetre; control values are tested."""
    c = world.layer(spark, d, "candidates").select("candidate_id", (F.col("x") + 500_000).alias("x"), (F.col("y") + 9_760_000).alias("y"))
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    there = c.select("candidate_id", "x", "y", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.project(F.col("lon"), F.col("lat"))
    return there.select("candidate_id", F.lit(2).alias("places"), ((F.abs(x - F.col("x")) < 1e-3) & (F.abs(y - F.col("y")) < 1e-3)).alias("back"))


@query("WITH " + world.sql("districts") + " SELECT district_id, CAST(100100025.0 AS DOUBLE) AS area, CAST(40020.0 AS DOUBLE) AS border FROM districts")
def p03_area_length(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(x0, y0), corner(x0 + 10005, y0), corner(x0 + 10005, y0 + 10005), corner(x0, y0 + 10005), corner(x0, y0))
    rows = world.layer(spark, d, "districts").withColumn("ring", ring)
    return rows.select("district_id", geo.ring_area(F.col("ring")).alias("area"), geo.path_length(F.col("ring")).alias("border"))


@query("SELECT CAST(2 AS BIGINT) AS files, CAST(3 AS BIGINT) AS rows_")
def s09_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Boundary features written as JSON text and read by Spark's reader."""
    where = f"{shared_folder(spark)}/boundaries-{uuid.uuid4().hex}"
    feature = '{"type":"Feature","properties":{"name":"%s","id":"%d"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}'
    texts = [f'{{"type":"FeatureCollection","features":[{",".join(feature % (n, i) for n, i in part)}]}}' for part in ([("a", 1), ("b", 2)], [("c", 3)])]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(2).write.mode("overwrite").text(where)
    return readers.read_boundaries(spark, where).agg(F.count_distinct("file").alias("files"), F.count("*").alias("rows_"))
