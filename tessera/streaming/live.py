"""ST1, live: activity bins that are up to date after every delivery.

A request needs the bins that are still open, so waiting for the watermark to
close them will not do.  The stream keeps fine bins (an hour by default) per
(region, entity) in update mode: every micro-batch gives the bins it changed,
and ``foreachBatch`` puts them into a serving table.  The table is replaced as
a whole: batch *n* is written to folder ``v=n`` from the newest folder before
it, and a folder counts once its ``_SUCCESS`` mark is there.  A batch that is
run again after a failure so writes the same folder again, and readers never
see half a table.

The table holds the bins of the trailing windows (A10: four of 7 days) and of
the watermark delay behind them; its size depends on regions, entities and
hours, not on the number of reports.  Reports within the delay still count,
however late they come; each report counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.recent import BIN_DAYS, N_BINS, prepare_reports, with_activity_features
from tessera.session import materialize
from tessera.sources.payloads import REPORT_LANDING_SCHEMA

SERVING_SCHEMA = "bin_start timestamp_ntz, state string, comName string, obs_count bigint"
GRAIN = "1 hour"


def _folders(spark: SparkSession, serving: str) -> list[tuple[int, str]]:
    """Complete versions of the serving table, oldest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(serving)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        path = status.getPath()
        name = path.getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            found.append((int(name[2:]), path.toString()))
    return sorted(found)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def serving_bins(spark: SparkSession, serving: str, before: int | None = None) -> DataFrame:
    """The newest complete version (below ``before``, if given)."""
    versions = [p for n, p in _folders(spark, serving) if before is None or n < before]
    if not versions:
        return spark.createDataFrame([], SERVING_SCHEMA)
    return spark.read.schema(SERVING_SCHEMA).parquet(versions[-1])


def upsert(changed: DataFrame, batch_id: int, serving: str, keep: str, versions: int = 2) -> None:
    """Put changed bins into the table: the newest one with its own changes
    replaced, without bins older than ``keep`` before the newest bin."""
    spark = changed.sparkSession
    keys = ["bin_start", "state", "comName"]
    changed = materialize(changed, "live-changes")  # read three times, computed once
    old = serving_bins(spark, serving, before=batch_id)
    newest = max((d for d in (t.agg(F.max("bin_start")).first()[0] for t in (old, changed)) if d is not None), default=None)
    rows = old.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
    if newest is not None:
        rows = rows.where(F.col("bin_start") >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep}"))
    rows.coalesce(max(1, spark.sparkContext.defaultParallelism // 4)).write.mode("overwrite").parquet(f"{serving}/v={batch_id}")
    for _, folder in _folders(spark, serving)[:-versions]:
        _drop(spark, folder)


def live_bins(spark: SparkSession, landing: str, serving: str, checkpoint: str, state_partitions: int,
              delay: str = "30 days", grain: str = GRAIN, key: str = "obs_id", max_files_per_trigger: int | None = None):
    """Bring the serving table up to date with the landed files
    (availableNow); returns the finished query.  ``state_partitions`` is fixed
    by the checkpoint's first run, as in ``activity_bins_stream``."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    reader = s.readStream.schema(REPORT_LANDING_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    reports = prepare_reports(reader.json(landing)).where(F.col("obs_ts").isNotNull())
    reports = reports.withColumn("event_time", F.col("obs_ts").cast("timestamp"))
    bins = (reports.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
            .groupBy(F.window("event_time", grain).alias("bin"), "state", "comName").agg(F.sum("obs_count").alias("obs_count")))
    bins = bins.select(F.col("bin.start").cast("timestamp_ntz").alias("bin_start"), "state", "comName", "obs_count")
    keep = f"{BIN_DAYS * N_BINS + int(delay.split()[0])} DAYS"
    query = (bins.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda changed, n: upsert(changed, n, serving, keep)).start())
    query.awaitTermination()
    return query


def activity_from_bins(bins: DataFrame, as_of: str, region: str = "state", entity: str = "comName") -> DataFrame:
    """A10 at ``as_of`` from the serving table.  ``as_of`` must begin a fine
    bin, else a bin would lie on both sides of a border."""
    t0 = F.lit(as_of).cast("timestamp_ntz")
    age = F.ceil(F.timestamp_diff("SECOND", F.col("bin_start"), t0) / F.lit(86_400 * BIN_DAYS))
    rows = bins.withColumn("_k", age).where((F.col("bin_start") < t0) & F.col("_k").between(1, N_BINS))
    sums = [F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("obs_count"))), F.lit(0)).cast("double").alias(f"_bin{k}")
            for k in range(1, N_BINS + 1)]
    return with_activity_features(rows.groupBy(region, entity).agg(*sums))
