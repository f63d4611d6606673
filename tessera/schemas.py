"""Schemas of the data model and the guards that check inputs.

Guards raise before any action where they only need the schema; where they
need the data they run one small job (``isEmpty``/a grouped count) or
compile into the plan with ``raise_error`` so the check happens inside the
job that computes the result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (column names and types of the original's tables)
# ---------------------------------------------------------------------------
# Raw observation file / lake (22 kept columns; lake adds nothing, partitioned by year, month).
OBSERVATION_SCHEMA = T.StructType([
    T.StructField("eventDate", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("countryCode", T.StringType()),
    T.StructField("stateProvince", T.StringType()),
    T.StructField("locality", T.StringType()),
    T.StructField("decimalLatitude", T.DoubleType()),
    T.StructField("decimalLongitude", T.DoubleType()),
    T.StructField("kingdom", T.StringType()),
    T.StructField("phylum", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("order", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("genus", T.StringType()),
    T.StructField("species", T.StringType()),
    T.StructField("taxonRank", T.StringType()),
    T.StructField("scientificName", T.StringType()),
    T.StructField("occurrenceStatus", T.StringType()),
    T.StructField("individualCount", T.IntegerType()),
    T.StructField("taxonKey", T.LongType()),
    T.StructField("speciesKey", T.LongType()),
])
KEEP_COLUMNS = [f.name for f in OBSERVATION_SCHEMA.fields]

PANEL_KEYS = ["species", "stateProvince", "year", "week_of_year"]

WEEKLY_COVARIATES = [
    "temp_mean_7d",
    "temp_max_7d",
    "temp_min_7d",
    "precip_sum_7d",
    "rain_sum_7d",
    "snowfall_sum_7d",
    "wind_max_7d",
]
LAGGED_COVARIATES = [f"lag_1_{c}" for c in WEEKLY_COVARIATES]

HISTORY_FEATURES = [
    "lag_1_obs_count",
    "lag_2_obs_count",
    "lag_3_obs_count",
    "rolling_2wk_mean_obs_count",
    "rolling_3wk_mean_obs_count",
    "rolling_4wk_max_obs_count",
    "week_sin",
    "week_cos",
    "had_recent_activity",
]

# Recent observation payload: only these three fields are read.
RECENT_OBS_SCHEMA = T.StructType([
    T.StructField("obsDt", T.StringType()),
    T.StructField("howMany", T.StringType()),
    T.StructField("comName", T.StringType()),
])
# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def daily_payload_schema(measures: Iterable[str]) -> T.StructType:
    """Object-of-parallel-arrays payload: ``daily.time`` + one array per measure."""
    daily = T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures]
    )
    return T.StructType([
        T.StructField("stateProvince", T.StringType()),
        T.StructField("daily", daily),
    ])


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> None:
    """Raise before any action when expected columns are missing."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"Missing expected columns for {what}: {missing}")


def fail_when(cond: Column, message: Column | str) -> Column:
    """A column that raises ``message`` in the task that sees ``cond`` true
    and is NULL otherwise; add it to a plan to make a guard lazy."""
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.raise_error(msg))
