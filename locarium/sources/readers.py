"""Readers of points in CSV and boundaries in GeoJSON, by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium.functions.text import stable_id
from locarium.operators.validation import row_problems

COORDINATES = "array<array<array<double>>>"
_FEATURES = f"features array<struct<properties:struct<name:string,id:string>,geometry:struct<type:string,coordinates:{COORDINATES}>>>"


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("name", "lat", "lon", "source_url", "date_retrieved")) -> DataFrame:
    """Points of a CSV with exactly these columns; ids are of their places at six digits.

    Every bad row is listed in one error; none is dropped or mended.
    """
    raw = spark.read.option("header", True).csv(path)
    if set(raw.columns) != set(columns):
        raise ValueError(f"columns are {raw.columns}, not {list(columns)}")
    lat, lon = F.expr("try_cast(lat as double)"), F.expr("try_cast(lon as double)")
    rows = raw.withColumns({"y": lat, "x": lon, "row": F.monotonically_increasing_id()})
    rules = {
        "no coordinates": F.col("x").isNull() | F.col("y").isNull(),
        "off the globe": (F.abs("x") > 180) | (F.abs("y") > 90),
        "no source": F.coalesce(F.trim("source_url"), F.lit("")) == "",
    }
    if bad := row_problems(rows, "row", rules).orderBy("row").limit(100).collect():
        raise ValueError("; ".join(f"row {r['row']}: {', '.join(r['problems'])}" for r in bad))
    place = F.concat_ws(",", F.format_string("%.6f", "y"), F.format_string("%.6f", "x"))
    return rows.withColumn("charger_id", stable_id("csv", place)).drop("row")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """``file, name, id, ring``: the outer rings of polygons, closed; a feature without a name or of another type is an error."""
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f"))
    rows = rows.select("file", "f.properties.name", "f.properties.id", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    bad = rows.where((F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce("type", F.lit("")) != "Polygon") | F.col("c").isNull())
    if not bad.isEmpty():
        raise ValueError("a boundary has no name or is no polygon")
    ring = F.transform(F.element_at("c", 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("file", "name", "id", ring.alias("ring"))
