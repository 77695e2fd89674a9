"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set only on a single machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="locarium-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


_WRITTEN: dict[str, SparkSession] = {}


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
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
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: Bits of a filter: its broadcast has this size whatever the corpus.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the low bits of ``keys`` (one long column), ``bits`` / 64 words at most whatever their number.

    A key that isn't in the bitmap isn't among ``keys``; one that is has to be
    looked up. The fuller it is, the less it spares, and no result depends on it.
    """
    (key,) = keys.columns
    words = keys.groupBy(F.expr(f"cast(shiftrightunsigned(`{key}` & {bits - 1}L, 6) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{key}` & 63 as int)))").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` the bitmap holds."""
    low = keys.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return ((bitmap.view(np.uint64)[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_in(keys: DataFrame, key: Column) -> Column:
    """True where ``key`` may be among ``keys`` (one long column), false only where it isn't; null keys are not."""
    shared = keys.sparkSession.sparkContext.broadcast(key_filter(keys))

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, values.to_numpy(np.int64)))

    return held(F.coalesce(key, F.lit(0).cast("long")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an edge list ``(u, v)``; component is the smallest node reachable.

    Every round hooks each node onto its smallest neighbour, follows the hooks
    to their roots by pointer doubling, and contracts the edges to those roots,
    so that the graph shrinks geometrically. All steps are joins and
    aggregates with partial combination; the driver sees only whether a table
    is empty. Null ends and self-loops are ignored; an edge may repeat.
    """
    # Both directions of one evaluation: edges that depend on the order of rows differ from one evaluation to the next.
    both = F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    e = stored(edges.where("u <> v").select(both)).distinct()
    whole = None
    while not e.isEmpty():
        p = stored(e.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
            q = stored(p.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            p = q.select("node", "root")
            if q.where("moved").isEmpty():
                break
        if whole is None:
            whole = p
        else:
            onto = p.select(F.col("node").alias("root"), F.col("root").alias("to"))
            whole = stored(whole.join(onto, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = (p.select(F.col("node").alias(x), F.col("root").alias(f"{x}2")) for x in "uv")
        e = stored(e.join(a, "u").join(b, "v").where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct())
    if whole is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return whole.withColumnRenamed("root", "component")


def dealt(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` shuffled by ``keys`` into ``spark.sql.shuffle.partitions`` partitions and sorted by them, for a streaming pass.

    Within equal keys rows are sorted by ``then``, so that a task that is
    repeated after a loss gives the same rows again.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def single_threaded() -> None:
    """One thread per task for libraries that start their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
