"""Extras: the event table as a stream. Counts with watermark, sessions and an interval join, each ending when the files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import materialize, new_folder, remove_folder


def stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table's files as a stream with event time ``at``."""
    import os

    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    local = path.removeprefix("file://")
    glob, where = ("*.parquet", path) if "://" not in path and os.path.isdir(local) else (f"{name}.parquet", folder)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(where).withColumn("at", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows the stream gives until its files are read, kept in the shared folder."""
    spark = df.sparkSession
    where = new_folder(spark, "stream")
    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").option("path", f"{where}/rows").start().awaitTermination()
    else:  # each epoch replaces the result: only groups are kept, never the stream
        run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/rows")).start().awaitTermination()
    out = materialize(spark.read.parquet(f"{where}/rows"))
    remove_folder(spark, where)
    return out


def window_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window."""
    w = F.window("at", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: the streaming form of merged intervals."""
    w = F.session_window("at", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "user_id", "n")
