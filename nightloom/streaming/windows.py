"""Event-time windows, deduplication and running state over streams and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(df: DataFrame, ts: str, size: str, *by: str) -> DataFrame:
    """start, by and n of fixed windows."""
    return df.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(df: DataFrame, ts: str, size: str, step: str, *by: str) -> DataFrame:
    """start, by and n of overlapping windows."""
    return df.groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    """start, end (last event plus gap), by and n of runs without a pause of ``gap``."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, writes Parquet and returns it; restarts go on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First delivery of each key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_stream(stream: DataFrame, ts: str, delay: str, size: str, *by: Column) -> DataFrame:
    """Tumbling counts with a watermark: late events count until it has passed their window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"))


def running_bursts(stream: DataFrame, key: str, ts: str, delay: str, within_seconds: int, least: int) -> DataFrame:
    """key, at, n: events by which a key has seen ``least`` events within a time span.

    The state of a key is its latest ``least`` event times, so it is bounded; it is
    dropped when the watermark has passed the span.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for at in sorted(int(t.timestamp()) for b in batches for t in b[ts].dropna()):
            times = [t for t in times if at - t < within_seconds][-(least - 1) :] + [at]
            if len(times) >= least:
                out.append((k[0], pd.Timestamp(at, unit="s"), len(times)))
        state.update((times[-least:],))
        if times:
            state.setTimeoutTimestamp(max((times[-1] + within_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "at", "n"])

    at = stream.withColumn(ts, F.col(ts).cast("timestamp")).select(key, F.to_timestamp(F.date_trunc("second", ts)).alias(ts))
    kind = stream.schema[key].dataType.simpleString()
    return at.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at timestamp, n int", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
