"""Session settings: the shared folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local (tests, one
    machine) a temporary folder is made; on a cluster a missing setting is an
    error, because a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own inside the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage, in the shared folder: it survives lost executors.

    Partitions and the order of rows inside them stay as they were.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the stored rows of materialized frames that nothing will read again."""
    for df in frames:
        found = df._jdf.queryExecution().analyzed()
        if found.nodeName() == "LogicalRDD":
            file = found.rdd().getCheckpointFile()
            if file.isDefined():
                remove_folder(df.sparkSession, file.get())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
