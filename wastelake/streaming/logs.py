"""The two append logs as Structured Streaming jobs (attempts and resident submissions)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from wastelake.session import fresh_path

WATERMARK = "1 day"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available now into a parquet table; exactly once through the checkpoint."""
    q: StreamingQuery = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def accept_known(events: DataFrame, bins: DataFrame) -> DataFrame:
    """Stream-static join: only events of registered bins pass."""
    return events.join(bins.select(F.col("id").alias("bin_id")), "bin_id")


def _timed(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp: the wall clock is read in the session zone, which must be UTC."""
    return stream.withColumn("event_time", F.col(column).cast("timestamp"))


def dedup_attempts(attempts: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Attempts unique by bin, time and status; state is dropped once the watermark has passed."""
    timed = _timed(attempts, "date").withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["bin_id", "event_time", "was_serviced"]).drop("event_time")


def daily_trend(events: DataFrame, column: str, delay: str = WATERMARK) -> DataFrame:
    """Tumbling day counts; a day is emitted when the watermark passes its end, later rows are dropped."""
    return (
        _timed(events, column).withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("w"))
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").cast("date").alias("day"), "events")
    )


SINCE = "bin_id long, latest_success timestamp_ntz, submissions_since_success long, total_submissions long"
_STATE = "latest long, total long, times array<long>, counts array<long>"
_CHANGED = "bin_id long, latest long, since long, total long"


def _count_since(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new events of one bin into its state: latest success, all submissions, and the times of those after it.

    The latest success only ever moves forward, so a submission at or before it never counts again and can be
    forgotten; one after it is kept, as a success that arrives late may still pass it. Order does not matter.
    """
    latest, total, times, counts = state.get if state.exists else (None, 0, [], [])
    waiting = Counter(dict(zip(times, counts)))
    for frame in frames:
        wins = frame.loc[frame["kind"] == "success", "at"]
        latest = max([*([] if latest is None else [latest]), *([] if wins.empty else [int(wins.max())])], default=None)
        asked = frame.loc[frame["kind"] == "request", "at"]
        total += len(asked)
        waiting.update(asked.tolist())
    kept = sorted((t, n) for t, n in waiting.items() if latest is None or t > latest)
    state.update((latest, total, [t for t, _ in kept], [n for _, n in kept]))
    since = None if latest is None else sum(n for _, n in kept)
    yield pd.DataFrame({"bin_id": [key[0]], "latest": pd.array([latest], "Int64"), "since": pd.array([since], "Int64"), "total": [total]})


def since_success(events: DataFrame) -> DataFrame:
    """Changed bins of a stream of (bin_id, at, kind in success or request), in update mode.

    Rows without a bin or a time belong to no bin's history and are left out.
    """
    timed = events.where("bin_id is not null and at is not null").select("bin_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind")
    changed = timed.groupBy("bin_id").applyInPandasWithState(_count_since, _CHANGED, _STATE, "update", "NoTimeout")
    latest = F.timestamp_micros("latest").cast("timestamp_ntz")
    return changed.select("bin_id", latest.alias("latest_success"), F.col("since").alias("submissions_since_success"), F.col("total").alias("total_submissions"))


def run_since_success(events: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Drain the stream and return the newest row of every bin.

    Each batch writes only the bins it changed, in a folder of its own, so a replayed batch is harmless and a
    restart without new data finds what was there.
    """
    spark: SparkSession = events.sparkSession
    spark.createDataFrame([], SINCE).write.mode("ignore").parquet(f"{root}/batch=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    query = since_success(events).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return newest_since_success(spark, root)


def newest_since_success(spark: SparkSession, root: str) -> DataFrame:
    columns = ["latest_success", "submissions_since_success", "total_submissions"]
    rows = spark.read.schema(f"{SINCE}, batch long").parquet(root)
    return rows.groupBy("bin_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("bin_id", *[f"s.{c}" for c in columns])


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output and checkpoint folder below the shared folder."""
    base = fresh_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
