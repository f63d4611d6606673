"""Daily covariates -> weekly covariates with a one-week lag, and the merge
onto the panel (B3/B4: S6 parse lives in sources.payloads; A3, W6, F2-F4,
J-3, P5, P7, A9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.calendar import calendar_year, iso_week
from tessera.schemas import LAGGED_COVARIATES, WEEKLY_COVARIATES
from tessera.session import sized_broadcast

# (output, aggregate, daily input).  Sums of an all-NULL week are 0 (as the
# original frame library sums); means, maxima and minima stay NULL.
WEEKLY_SPEC = [
    ("temp_mean_7d", "mean", "temperature_2m_mean"),
    ("temp_max_7d", "max", "temperature_2m_max"),
    ("temp_min_7d", "min", "temperature_2m_min"),
    ("precip_sum_7d", "sum", "precipitation_sum"),
    ("rain_sum_7d", "sum", "rain_sum"),
    ("snowfall_sum_7d", "sum", "snowfall_sum"),
    ("wind_max_7d", "max", "wind_speed_10m_max"),
]


def _agg(kind: str, c: str):
    col = F.col(c)
    if kind == "mean":
        return F.avg(col)
    if kind == "max":
        return F.max(col)
    if kind == "min":
        return F.min(col)
    if kind == "sum":
        return F.coalesce(F.sum(col), F.lit(0.0))
    raise ValueError(f"unknown aggregate {kind}")


def nan_to_null(df: DataFrame, columns) -> DataFrame:
    """NaN -> NULL so that Spark's aggregates skip missing values."""
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def weekly_covariates(daily: DataFrame, region: str = "stateProvince", date: str = "date",
                      spec=WEEKLY_SPEC) -> DataFrame:
    """A3 + W6: one row per (region, calendar year, ISO week) with the weekly
    aggregates, n_days, and lag_1_* of every aggregate (previous row of the
    region ordered by (year, week), across years)."""
    measures = [m for _, _, m in spec]
    d = nan_to_null(daily, set(measures))
    weekly = (
        d.groupBy(F.col(region), calendar_year(date).alias("year"), iso_week(date).alias("week_of_year"))
        .agg(*[_agg(kind, m).cast("double").alias(out) for out, kind, m in spec],
             F.count(F.col(date)).alias("n_days"))
    )
    w = Window.partitionBy(region).orderBy("year", "week_of_year")
    return weekly.select("*", *[F.lag(out, 1).over(w).alias(f"lag_1_{out}") for out, _, _ in spec])


def merge_covariates(panel: DataFrame, weekly: DataFrame, keys=("stateProvince", "year", "week_of_year"),
                     columns=None) -> DataFrame:
    """J-3/P5: all panel columns + the chosen weekly columns, left join.

    The weekly table has one row per key (no fan-out).  Its size is
    measured before the join: below the broadcast limit it is broadcast and
    the panel keeps its (entity, region) partitioning; above it the join is
    a shuffle join.
    """
    columns = list(WEEKLY_COVARIATES + LAGGED_COVARIATES) if columns is None else list(columns)
    right = sized_broadcast(weekly.select(*keys, *columns))
    return panel.join(right, list(keys), "left")


def coverage(merged: DataFrame, probe: str = "temp_mean_7d") -> DataFrame:
    """Total rows and rows without covariates, in one pass."""
    return merged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(probe).isNull()).alias("n_missing_covariates"),
    )
