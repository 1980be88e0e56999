"""The monitor log as streams: windowed counts, sessions, late arrivals, latest activity.

Each function takes a streaming or a batch DataFrame of events(event_id, at: timestamp, user_id, event_type, value).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.search_index import scratch

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("at", late) if events.isStreaming else events
    return w.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("at", late) if events.isStreaming else events
    return w.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "14 days") -> DataFrame:
    """The overlapping lookback of a monitor: what comes again within it is dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("at", "event_id")).alias("event_type"), F.max("at").alias("at"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it has put out. Rows that are appended go to files in the shared
    folder, written by the executors, and their state to RocksDB, so neither is held by the driver or in a heap. In other modes, whose
    rows are few groups, they become a table in memory."""
    spark = stream.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    writer = stream.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        q = writer.format("memory").start()
        q.awaitTermination()
        return spark.table(name)
    at = f"{scratch(spark)}/{name}"
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, ROCKSDB)
    try:
        q = writer.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").start()
    finally:
        spark.conf.set(STATE, before) if before else spark.conf.unset(STATE)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
