"""Structured Streaming variants: the event log, incremental folders, exactly-once ingest by content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash
from ..sources.readers import EVENT_SCHEMA, documents


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    log = spark.readStream.schema(EVENT_SCHEMA).json(path)
    return log.withColumn("event", F.coalesce("event", F.lit("unknown"))).withColumn("ts", F.try_to_timestamp("ts"))


def hourly_counts(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events per kind and window; late rows beyond the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event", "n")


START, ENDS = "file_started", ("file_completed", "file_error")


def paired(events: DataFrame, forget: str | None = None) -> DataFrame:
    """End events with the last start of their path, however far back, and the seconds between (never negative).

    The state of a path is its last start's time; a start serves every end after it. Within a batch rows go by time, a start before an end of
    the same time. An end without a start before it gives no row, nor does a row without a path or time. The state holds one number
    for each path; with ``forget`` (an interval of processing time) that of a path which has been silent for so long goes.
    """
    wanted = events.where(F.col("event").isin(START, *ENDS) & F.col("path").isNotNull() & F.col("ts").isNotNull()).select("path", "event", F.unix_micros("ts").alias("us"))
    ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def pair(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        rows = rows.assign(late=rows["event"] != START).sort_values(["us", "late"], kind="stable")
        # A batch's rows follow the start that was known before it.
        known = state.get[0] if state.exists else None
        started = rows["us"].where(~rows["late"]).astype("Int64").ffill()
        started = started if known is None else started.fillna(known)
        if ms is not None:
            state.setTimeoutDuration(ms)
        if pd.notna(started.iloc[-1]):
            state.update((int(started.iloc[-1]),))
        hit = rows["late"] & started.notna()
        if hit.any():
            yield pd.DataFrame({"path": key[0], "us": rows.loc[hit.to_numpy(), "us"], "event": rows.loc[hit.to_numpy(), "event"], "started_us": started[hit.to_numpy()].astype("int64")})

    timeout = GroupStateTimeout.NoTimeout if ms is None else GroupStateTimeout.ProcessingTimeTimeout
    met = wanted.groupBy("path").applyInPandasWithState(pair, "path string, us long, event string, started_us long", "us long", "append", timeout)
    seconds = F.greatest(F.lit(0.0), (F.col("us") - F.col("started_us")) / 1e6)
    return met.select("path", F.timestamp_micros("us").alias("ts"), "event", F.timestamp_micros("started_us").alias("started"), seconds.alias("seconds"))


def folder_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Document rows of files as they come in, each path and content once within the watermark on the files' times; what
    is older is known to ``append_new`` from the table itself."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    rows = documents(files.withWatermark("modificationTime", late), ("modificationTime",))
    return rows.withColumn("content_hash", content_hash(F.col("text"))).dropDuplicatesWithinWatermark(["source_path", "content_hash"])


def append_new(stored_path: str):
    """A ``foreachBatch`` sink that appends rows not stored yet, so that a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored_path)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        new = batch.dropDuplicates(["source_path", "content_hash"])
        if there:
            new = new.join(spark.read.parquet(stored_path).select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")
        new.write.mode("append").parquet(stored_path)

    return write
