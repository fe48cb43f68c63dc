"""Streams of logs and events: windows with watermarks, gaps, completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone: the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling_counts(events: DataFrame, ts: str, keys: Sequence[str], value: str, size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums over windows of event time; a stream forgets windows that the watermark has passed."""
    rows = _watermarked(events, ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events with no gap of that length: start, end, n. A gap after the last row of a log is how staleness shows."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stale(log: DataFrame, ts: str, keys: Sequence[str], now: str, seconds: int) -> DataFrame:
    """Keys whose last row is older than `seconds` at `now`, and by how much."""
    last = log.groupBy(*keys).agg(F.max(ts).alias("last"))
    last = last.withColumn("last", F.col("last").cast("timestamp_ntz"))  # no zone, so that the session's does not matter
    return last.withColumn("age", F.expr(f"timestampdiff(SECOND, date_trunc('SECOND', last), timestamp_ntz'{now}')")).filter(F.col("age") > seconds)


def finished(log: DataFrame, keys: Sequence[str], step: str, last: int) -> DataFrame:
    """For each key its greatest step and whether that is the last one."""
    return log.groupBy(*keys).agg(F.max(step).alias("step")).withColumn("complete", F.col("step") >= last)


def completed(log: DataFrame, files: DataFrame, keys: Sequence[str], step: str, last: int, name: str, required: Sequence[str]) -> DataFrame:
    """As finished(); a run is complete only if all required files are there too. missing: how many are not."""
    have = files.filter(F.col(name).isin(list(required))).groupBy(*keys).agg(F.countDistinct(name).alias("__have"))
    both = finished(log, keys, step, last).join(have, list(keys), "left")
    both = both.withColumn("missing", F.lit(len(set(required))) - F.coalesce("__have", F.lit(0)))
    return both.withColumn("complete", F.col("complete") & (F.col("missing") == 0)).drop("__have")


def run_to_end(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into Parquet, then stops; a second call goes on from the checkpoint."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()


def run_whole(df: DataFrame, checkpoint: str, out: str) -> None:
    """Runs an aggregating stream over what is there now; out holds all of its result as of the last batch, as Parquet."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
