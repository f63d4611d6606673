"""Landed JSON payloads -> rows.

The original fetched these over HTTP at request time; here a fetcher (out of
scope) lands the payloads as JSON files and Spark reads them with a declared
schema.

* Daily covariate payload (S6): ``{"stateProvince": ..., "daily": {"time":
  [...], "<measure>": [...], ...}}`` - an object of equal-length arrays.
  ``inline(arrays_zip(...))`` turns each payload into rows inside the task
  that read it; no shuffle.
* Recent report payload (S7): one JSON object per report with ``obsDt``,
  ``howMany`` and ``comName`` (plus the landing's ``obs_id``/``state``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.dims import DAILY_VARS
from tessera.functions.calendar import calendar_year, iso_week
from tessera.schemas import RECENT_OBS_SCHEMA, daily_payload_schema, require_columns

REPORT_LANDING_SCHEMA = T.StructType(
    [T.StructField("obs_id", T.LongType()), T.StructField("state", T.StringType())] + RECENT_OBS_SCHEMA.fields)


def pack_daily_payload(daily: DataFrame, region: str = "stateProvince", date: str = "date",
                       measures=DAILY_VARS) -> DataFrame:
    """Landing helper: daily rows -> one payload per (region, month), the
    shape the covariate service returns.  A payload holds at most 31 days."""
    rows = F.sort_array(F.collect_list(F.struct(
        F.date_format(date, "yyyy-MM-dd").alias("time"), *[F.col(m).alias(m) for m in measures])))
    g = daily.groupBy(F.col(region).alias("stateProvince"), F.trunc(date, "month").alias("_m")).agg(rows.alias("_r"))
    def field(name):
        return F.transform("_r", lambda r: r[name]).alias(name)

    arrays = [field("time")] + [field(m) for m in measures]
    return g.select("stateProvince", F.struct(*arrays).alias("daily"))


def read_daily_payload(spark: SparkSession, path: str, measures=DAILY_VARS) -> DataFrame:
    """A corrupt line raises in the task that meets it."""
    return spark.read.schema(daily_payload_schema(measures)).option("mode", "FAILFAST").json(path)


def parse_daily_payload(payload: DataFrame, measures=DAILY_VARS, region: str = "stateProvince") -> DataFrame:
    """S6 + F2-F4 + P11: payload -> (region, date, measures..., year,
    week_of_year).  Fields missing from the schema raise before any job runs;
    a payload without ``daily``, without one of its arrays, or with arrays of
    different lengths raises in the task that meets it, and so does a malformed
    date (strict parse)."""
    daily_fields = payload.schema["daily"].dataType.fieldNames()
    require_columns(payload.select("daily.*"), ["time", *measures], "daily payload")
    zipped = F.arrays_zip(*[F.col(f"daily.{f}").alias(f) for f in ["time", *measures] if f in daily_fields])
    arrays = [F.col(f"daily.{f}") for f in ["time", *measures]]
    whole = F.lit(True)
    for a in arrays:
        whole = whole & a.isNotNull() & (F.size(a) == F.size(arrays[0]))
    guard = F.when(F.coalesce(whole, F.lit(False)), True).otherwise(
        F.raise_error(F.concat(F.lit("incomplete daily payload of "), F.coalesce(F.col(region), F.lit("?")))).cast("boolean"))
    rows = payload.where(guard).select(F.col(region), F.inline(zipped))
    return rows.select(
        region, F.to_date("time", "yyyy-MM-dd").alias("date"), *measures,
    ).withColumn("year", calendar_year("date")).withColumn("week_of_year", iso_week("date"))


def land_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_reports_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed report objects with a declared schema; a corrupt line raises."""
    return spark.read.schema(REPORT_LANDING_SCHEMA).option("mode", "FAILFAST").json(path)


def read_any_measures(spark: SparkSession, path: str) -> DataFrame:
    """S6 for payloads whose measures are not known beforehand: each line is
    parsed as a VARIANT, and every array of ``daily`` beside ``time`` becomes
    rows (stateProvince, date, measure, value).  A line that is no JSON, a
    payload without ``time``, or an array of another length raises."""
    lines = spark.read.text(path).select(F.parse_json("value").alias("payload"))
    lines.createOrReplaceTempView(name := f"payload_{uuid.uuid4().hex}")
    arrays = spark.sql(f"""
        SELECT variant_get(payload, '$.stateProvince', 'string') AS stateProvince,
               variant_get(payload, '$.daily.time', 'array<string>') AS time, key AS measure, cast(value AS array<double>) AS series
        FROM {name}, LATERAL variant_explode(variant_get(payload, '$.daily')) WHERE key <> 'time'""")
    bad = F.raise_error(F.concat(F.lit("incomplete daily payload of "), F.coalesce("stateProvince", F.lit("?")))).cast("boolean")
    whole = F.coalesce(F.size("time") == F.size("series"), F.lit(False))
    rows = arrays.where(F.when(whole, True).otherwise(bad)).select(
        "stateProvince", "measure", F.explode(F.arrays_zip("time", "series")).alias("x"))
    return rows.select("stateProvince", F.to_date("x.time", "yyyy-MM-dd").alias("date"), "measure", F.col("x.series").alias("value"))
