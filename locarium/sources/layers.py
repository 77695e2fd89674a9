"""Layers: validated tables with a fingerprint beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium.operators.validation import Field, require


class LayerMissing(LookupError):
    """The layer's source is recorded as missing: there is no table, not an empty one."""


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows whatever their order: count, and sums of two independent row hashes.

    Rows are hashed where they lie; only three numbers meet.
    """
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    parts = [F.sum(F.conv(F.substring(F.sha2(row, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    got = df.agg(F.count("*").alias("n"), *parts).first()
    return "-".join(str(got[c]) for c in ("n", "h0", "h1", "h2", "h3"))


def _meta(spark: SparkSession, path: str) -> str:
    return f"{path}.meta"


def write_layer(df: DataFrame, path: str, fields: list[Field], key: str | None = None) -> str:
    """Validate and write a layer, then its metadata; returns the fingerprint.

    Rows stay in as many files as Spark makes of them. A failed check leaves
    what was there untouched.
    """
    checked = require(df, fields, key)
    checked.write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    mark = fingerprint(spark.read.schema(checked.schema).parquet(path))
    text = json.dumps({"status": "present", "fingerprint": mark, "columns": [f.name for f in fields]}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(_meta(spark, path))
    return mark


def write_missing(spark: SparkSession, path: str, why: str) -> None:
    """Record that a layer's source is missing."""
    text = json.dumps({"status": "missing", "why": why}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(_meta(spark, path))


def read_layer(spark: SparkSession, path: str, fields: list[Field], key: str | None = None, verify: bool = True) -> DataFrame:
    """A layer, validated again and its fingerprint compared; edited files are an error."""
    meta = json.loads(spark.read.text(_meta(spark, path)).first()[0])
    if meta["status"] == "missing":
        raise LayerMissing(meta["why"])
    df = require(spark.read.parquet(path), fields, key)
    if verify and fingerprint(df) != meta["fingerprint"]:
        raise ValueError(f"{path} is not what was written")
    return df
