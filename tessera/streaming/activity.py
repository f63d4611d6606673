"""ST1: 7-day activity bins kept up to date as report files land.

readStream (JSON files, declared schema) -> lenient parse -> event-time
watermark -> de-duplication of re-delivered reports within the watermark ->
tumbling 7-day windows per (region, entity) -> append sink.  The watermark
delay is how late a report may arrive and still count (the original re-read
the last 30 days on every request, so 30 days in production); a bin is
emitted once the watermark has passed its end and is final from then on.

Event time: watermarks need TIMESTAMP (not TIMESTAMP_NTZ), so the stream
runs in its own session pinned to UTC, where the cast keeps the wall clock;
bin bounds are written back as TIMESTAMP_NTZ and so read the same in any
session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.recent import prepare_reports
from tessera.sources.payloads import REPORT_LANDING_SCHEMA
from tessera.session import scratch_path


def window_offset(anchor: str, bin_days: int = 7) -> str:
    """startTime that aligns ``bin_days`` windows to begin on ``anchor``."""
    days = (dt.date.fromisoformat(anchor[:10]) - dt.date(1970, 1, 1)).days % bin_days
    return f"{days} days"


def activity_bins_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                         state_partitions: int, delay: str = "30 days", bin_days: int = 7, anchor: str = "2024-01-01",
                         region: str = "state", entity: str = "comName", key: str = "obs_id",
                         max_files_per_trigger: int | None = None):
    """Start the stream (availableNow) and block until the landed files are
    processed; returns the finished StreamingQuery.

    ``state_partitions`` is the number of state-store partitions of the
    de-duplication and the windowed aggregate.  The first run of a checkpoint
    fixes it for good, so the caller states it: size it for the open reports
    of the whole stream, not for the cores of the moment.
    ``max_files_per_trigger`` bounds each micro-batch of a large backlog
    (reports older than the watermark at their batch are then dropped, so
    the delay must cover how out of order the files arrive)."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    reader = s.readStream.schema(REPORT_LANDING_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.json(landing)
    rep = prepare_reports(raw).where(F.col("obs_ts").isNotNull())
    rep = rep.withColumn("event_time", F.col("obs_ts").cast("timestamp"))
    w = F.window("event_time", f"{bin_days} days", startTime=window_offset(anchor, bin_days))
    agg = (rep.withWatermark("event_time", delay)
           .dropDuplicatesWithinWatermark([key])
           .groupBy(w.alias("bin"), region, entity)
           .agg(F.sum("obs_count").alias("obs_count")))
    out = agg.select(F.col("bin.start").cast("timestamp_ntz").alias("bin_start"),
                     F.col("bin.end").cast("timestamp_ntz").alias("bin_end"),
                     region, entity, "obs_count")
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def activity_bins_batch(reports: DataFrame, closed_before, bin_days: int = 7, anchor: str = "2024-01-01",
                        region: str = "state", entity: str = "comName", key: str = "obs_id") -> DataFrame:
    """The same bins as a batch job (for equality checks): distinct reports,
    tumbling bins aligned to ``anchor``, only bins ending at or before
    ``closed_before``."""
    rep = prepare_reports(reports).where(F.col("obs_ts").isNotNull()).dropDuplicates([key])
    anchor_ts = F.lit(anchor[:10] + " 00:00:00").cast("timestamp_ntz")
    days = F.floor(F.timestamp_diff("SECOND", anchor_ts, F.col("obs_ts")) / F.lit(86400 * bin_days))
    start = F.timestamp_add("DAY", (days * bin_days).cast("int"), anchor_ts)
    g = (rep.groupBy(start.alias("bin_start"), region, entity).agg(F.sum("obs_count").alias("obs_count"))
         .withColumn("bin_end", F.timestamp_add("DAY", F.lit(bin_days), F.col("bin_start"))))
    return g.where(F.col("bin_end") <= F.lit(closed_before).cast("timestamp_ntz")).select(
        "bin_start", "bin_end", region, entity, "obs_count")


def deliveries(reports: DataFrame, split_at: str, overlap_from: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries that overlap in time ([.., split_at) and
    [overlap_from, ..)), so reports in the overlap are delivered twice, as a
    re-polling fetcher would."""
    ts = F.col("obsDt").try_cast("timestamp_ntz")
    return (reports.where(ts.isNull() | (ts < F.lit(split_at).cast("timestamp_ntz"))),
            reports.where(ts >= F.lit(overlap_from).cast("timestamp_ntz")))


def run_fixture_stream(spark: SparkSession, reports: DataFrame, delay: str, anchor: str,
                       split_at: str, overlap_from: str, state_partitions: int) -> DataFrame:
    """Land a delivery, run the stream, land the next one, run it again from
    the same checkpoint: the second run meets repeated reports and reports
    behind the watermark.  Returns the sink."""
    root = scratch_path(spark, "stream")
    landing, sink, ckpt = f"{root}/landing", f"{root}/sink", f"{root}/checkpoint"
    for part in deliveries(reports, split_at, overlap_from):
        part.write.mode("append").json(landing)
        activity_bins_stream(spark, landing, sink, ckpt, state_partitions, delay=delay, anchor=anchor)
    return spark.read.parquet(sink)
