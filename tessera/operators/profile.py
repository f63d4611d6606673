"""Profiling and label-balance queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partition_profile(df: DataFrame, cols=("year", "month")) -> DataFrame:
    """A4: rows per (year, month) partition."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))


def month_profile(df: DataFrame, month: str = "month") -> DataFrame:
    """Rows per month, NULL month kept as its own group."""
    return df.groupBy(month).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns) -> DataFrame:
    """Of each column its type, non-NULL count, distinct values, least and
    greatest (as text).  ``df`` should be a stored table: every column is read
    and grouped by itself, so no row is repeated for the columns and a value
    is shuffled once a task, however many columns there are."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        v = F.col(f"`{c}`")
        values = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.agg(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.count(F.lit(1)).alias("n_distinct"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest")))
    return reduce(DataFrame.unionByName, parts)


def top_values(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """A5/O3: the k most frequent non-NULL values; ties broken by value.

    The limit is the feature (a top-k report); Spark plans it as a
    per-partition top-k followed by one merge of k rows per partition.
    """
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
        .limit(k)
    )


def top_values_of(df: DataFrame, columns, k: int = 50) -> DataFrame:
    """A5/O3 for several columns in one pass: (column_name, value, n) of the k
    most frequent non-NULL values of each.  The rank limit is planned as a
    group limit before the shuffle by column."""
    counted = df.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"))
    found = counted.select(
        F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]).alias("column_name"),
        F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (found.where(F.col("value").isNotNull()).withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= k).drop("_rank"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows of a table."""
    return df.limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """The schema as rows (column_name, column_type, nullable)."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, column_type string, nullable boolean")


LABELS = ("present_ge_1", "present_ge_5", "present_rel_10pct_peak")


def label_balance(panel: DataFrame, entity: str = "species", region: str = "stateProvince",
                  labels=LABELS) -> DataFrame:
    """A7 + A8 in one pass: GROUPING SETS ((), (entity), (region)).

    ``level`` names the grouping set ('overall', entity, region); counts and
    rates of every label are computed for each set.
    """
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for lab in labels:
        aggs += [F.sum(lab).cast("bigint").alias(f"n_{lab}"), F.avg(lab).alias(f"pct_{lab}")]
    g = panel.groupingSets([[], [entity], [region]], entity, region).agg(
        F.grouping_id().alias("_gid"), *aggs)
    level = (F.when(F.col("_gid") == 3, F.lit("overall"))
             .when(F.col("_gid") == 1, F.lit(entity)).otherwise(F.lit(region)))
    return g.select(level.alias("level"), entity, region, *[c for c in g.columns if c not in ("_gid", entity, region)])
