"""Raw observation files -> year/month-partitioned parquet lake (B1: S1, S2,
S4, S5, P1, P2).

* S1: CSV read with an explicit schema (no inference pass over the data) and
  RFC 4180 quotes.  A record with a wrong number of fields, and a value that
  does not parse, raise; nothing is dropped silently.
* P1/P2: the fixed 22-column projection and the NOT NULL date filter.
* S4: ``partitionBy(year, month)`` after a REBALANCE on the partition
  columns: rows of one (year, month) meet in few tasks (few files per
  folder), while AQE splits a month that holds a large share of the rows
  into several tasks and merges small ones.  Dynamic partition overwrite
  replaces exactly the partitions being written, so a re-run is idempotent.
* S2: the lake is read back with partition discovery; filters on year/month
  prune folders, other filters push into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schemas import KEEP_COLUMNS, OBSERVATION_SCHEMA
from tessera.session import compiled_methods

PARTITION_COLUMNS = ["year", "month"]


def _parsed(name: str, kind: T.DataType):
    """A text column as ``kind``.  Blank is NULL; dates may carry a time of day
    and integers a decimal point; anything else that does not parse raises."""
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`").alias(name)
    text = F.trim(F.col(f"`{name}`"))
    value = text.try_cast(kind)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        value = F.coalesce(value, text.try_cast("double").try_cast(kind))
    bad = F.raise_error(F.concat(F.lit(f"bad value in column {name}: "), text)).cast(kind)
    return F.when(value.isNull() & (text != ""), bad).otherwise(value).alias(name)


def read_observations_csv(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA,
                          sep: str = ",", header: bool = True) -> DataFrame:
    """CSV scan with a declared schema."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (spark.read.schema(texts).option("header", header).option("sep", sep).option("mode", "FAILFAST")
           .option("quote", '"').option("escape", '"').csv(path))
    return raw.select(*[_parsed(f.name, f.dataType) for f in schema.fields])


def project_observations(raw: DataFrame) -> DataFrame:
    """P1 + P2: the kept columns in their fixed order, rows with a date only."""
    return raw.select(*[F.col(f"`{c}`") for c in KEEP_COLUMNS]).where(F.col("eventDate").isNotNull())


def write_lake(df: DataFrame, root: str, partition_cols=PARTITION_COLUMNS) -> None:
    """Partitioned parquet write, dynamic overwrite."""
    (df.hint("rebalance", *partition_cols)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(root))


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """Partitioned scan; year/month come back from the folder names."""
    return spark.read.option("basePath", root).parquet(root)


def build_lake(spark: SparkSession, csv_path: str, root: str, sep: str = ",") -> DataFrame:
    """B1 end to end; returns the lake as read back."""
    with compiled_methods(spark):
        write_lake(project_observations(read_observations_csv(spark, csv_path, sep=sep)), root)
    return read_lake(spark, root)


def write_table(df: DataFrame, path: str, sort_cols=None) -> None:
    """One parquet table (rows sorted inside each file if asked)."""
    out = df.sortWithinPartitions(*sort_cols) if sort_cols else df
    out.write.mode("overwrite").parquet(path)


def land_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write a frame as header CSV files (the raw landing format)."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("dateFormat", "yyyy-MM-dd")
     .option("quote", '"').option("escape", '"').csv(path))


def as_observation_rows(obs: DataFrame) -> DataFrame:
    """Give a (species, stateProvince, eventDate, year, month, day, ...) frame
    the full observation schema; columns it lacks are NULL."""
    have = set(obs.columns)
    return obs.select(*[
        (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in OBSERVATION_SCHEMA.fields
    ])
