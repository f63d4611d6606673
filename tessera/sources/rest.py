"""Tables at rest: laid out once so that later queries move or read less.

* range layout (S5, O1): rows range-partitioned and sorted by the keys, so
  that the row groups of a file hold narrow key ranges and a filter on the
  leading keys skips most of them by their min/max;
* buckets (J-3): panel and weekly covariates bucketed alike on the join keys,
  so that their join needs neither broadcast nor shuffle;
* footers (A4, A6): row counts from file metadata, by aggregate push-down.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import LAGGED_COVARIATES, PANEL_KEYS, WEEKLY_COVARIATES
from tessera.session import scratch_path

COVARIATE_KEYS = ["stateProvince", "year", "week_of_year"]


def write_range_table(df: DataFrame, path: str, keys=PANEL_KEYS, files: int | None = None, row_group_bytes: int = 16 * 1024 * 1024) -> None:
    """One Parquet table in key order: file by file and inside each file."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    (ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path))


def write_bucketed(df: DataFrame, name: str, keys, buckets: int) -> DataFrame:
    """``df`` as a table of the session's catalog, bucketed and sorted on the
    keys, with its files below the shared folder; one file a bucket."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.format("parquet").option("path", scratch_path(spark, name))
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)


def covariates_at_rest(panel: DataFrame, weekly: DataFrame, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Panel and weekly covariates as bucketed tables for ``merge_at_rest``."""
    wanted = [*COVARIATE_KEYS, *WEEKLY_COVARIATES, *LAGGED_COVARIATES]
    return (write_bucketed(panel, "panel", COVARIATE_KEYS, buckets),
            write_bucketed(weekly.select(*wanted), "weekly", COVARIATE_KEYS, buckets))


def merge_at_rest(panel: DataFrame, weekly: DataFrame) -> DataFrame:
    """J-3/P5 on bucketed tables: bucket meets bucket, nothing is shuffled or
    broadcast, however large the covariates are."""
    return panel.join(weekly.hint("merge"), COVARIATE_KEYS, "left")


def footer_session(spark: SparkSession) -> SparkSession:
    """A session that reads Parquet by the newer source, which answers counts
    by partition from the footers."""
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "csv,json,text,orc,avro,kafka")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def footer_profile(spark: SparkSession, lake: str, columns=("year", "month")) -> DataFrame:
    """Rows per partition of a lake; no data page is read."""
    rows = footer_session(spark).read.option("basePath", lake).parquet(lake)
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
