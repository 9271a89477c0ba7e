"""Session helpers: code shipping, lineage cuts, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the session was started (once an application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("ledgerloom", os.path.relpath(full, root)))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a local
    session gets a temporary folder; a cluster without it is an error, as a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; its lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` or :func:`stored` frame that nothing reads any more, such as a matrix that the next one replaces."""
    spark, files = df.sparkSession, []
    rdd = df._jdf.queryExecution().toRdd()
    while not (file := rdd.getCheckpointFile()).isDefined():
        if rdd.dependencies().size() != 1:
            files = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/scratch-" in f}
            break
        rdd = rdd.dependencies().head().rdd()
    else:
        files = [file.get()]
    for f in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions, as a small single file has; a large input, or one with a shuffle, stays as it is."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":  # counting its partitions would run its stages
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it is proven to hold at most ``most`` rows; a larger one is joined as the optimizer sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch(spark: SparkSession) -> str:
    """A new folder name within the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    For loops: a checkpoint keeps the optimizer's estimate of its size, and estimates of joins multiply round by round.
    """
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file with ``data`` at a path of any file system that the cluster knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
