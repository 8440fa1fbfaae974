"""Streaming twins over file sources: event-time windows, and keyed state that survives between micro-batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vinolake.operators.scale import scratch

STATE = "n bigint, last_ts timestamp, last_value double, top_value double"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The parquet files of a folder, or one file, as a stream; ts becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):  # a stream source wants a folder
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than ``late`` behind the stream are left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def keyed_state(events: DataFrame) -> DataFrame:
    """(user_id, n, last_ts, last_value, top_value) whenever a user's state changes; state is kept per key, rows come in batches."""

    def update(key, batches, state: GroupState):
        n, ts, value, top = state.get if state.exists else (0, None, None, None)
        for b in batches:
            n += len(b)
            newest = b.sort_values(["ts", "event_id"]).iloc[-1]
            if ts is None or newest.ts >= ts:
                ts, value = newest.ts, newest.value
            high = b["value"].max()
            top = high if top is None or high > top else top
        state.update((n, ts, value, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [ts], "last_value": [value], "top_value": [top]})

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(update, f"user_id bigint, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append", sink: Callable | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote; each batch is written under its number, so a repeated batch overwrites itself."""
    spark = stream.sparkSession
    out, check = scratch(spark, name), scratch(spark, name + "-check")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        (sink(batch) if sink else batch).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "integer")).option("basePath", out).parquet(out)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of every key after the whole stream: the last update of each."""
    updates = run_available(keyed_state(event_stream(spark, path)), "state", "update")
    best = updates.groupBy("user_id").agg(F.max_by(F.struct("n", "last_ts", "last_value", "top_value"), "batch").alias("s"))
    return best.select("user_id", "s.*")
