"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set only on a single machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="locarium-"))
        folder = sc.getCheckpointDir()
    return folder


_WRITTEN: dict[str, SparkSession] = {}


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with it
            return


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: a table that outlives executors.

    Later plans start from the written files, so that no executor's loss
    repeats the work above them. The files go when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
