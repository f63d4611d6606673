import datetime as dt
import math

from pyspark.sql import functions as F

from tessera.dims import DAILY_VARS
from tessera.operators import covariates

DAILY = "stateProvince string, date date, " + ", ".join(f"{m} double" for m in DAILY_VARS)


def day(state, d, vals):
    return (state, d, *vals)


def test_weekly_aggregates_nulls_and_quirk(spark):
    nan = float("nan")
    rows = []
    # calendar year 2017 + ISO week 52 holds 1 Jan 2017 and 25-31 Dec 2017 -> 8 days
    for d in [dt.date(2017, 1, 1)] + [dt.date(2017, 12, 25) + dt.timedelta(days=i) for i in range(7)]:
        rows.append(day("S", d, [1.0, 2.0, 0.5, 1.0, None, None, 3.0]))
    # a week whose snowfall is all NULL and one NaN mean
    for i in range(7):
        rows.append(day("S", dt.date(2017, 3, 6) + dt.timedelta(days=i), [nan if i == 0 else 2.0, 5.0, -1.0, 0.1, 0.2, None, 1.0]))
    w = covariates.weekly_covariates(spark.createDataFrame(rows, DAILY)).orderBy("year", "week_of_year").collect()
    by_key = {(r.year, r.week_of_year): r for r in w}
    q = by_key[(2017, 52)]
    assert q.n_days == 8 and q.rain_sum_7d == 0.0 and q.snowfall_sum_7d == 0.0 and q.temp_mean_7d == 1.0
    m = by_key[(2017, 10)]
    assert m.temp_mean_7d == 2.0  # NaN skipped
    assert math.isclose(m.precip_sum_7d, 0.7) and m.snowfall_sum_7d == 0.0
    # lag follows (year, week) order inside the region
    assert m.lag_1_temp_mean_7d is None
    assert q.lag_1_temp_mean_7d == 2.0


def test_merge_keeps_panel_rows_and_counts_missing(spark):
    panel = spark.createDataFrame([("a", "S", 2017, 10, 1), ("a", "S", 2017, 11, 0), ("a", "T", 2017, 10, 2)],
                                  "species string, stateProvince string, year int, week_of_year int, obs_count long")
    rows = [day("S", dt.date(2017, 3, 6) + dt.timedelta(days=i), [1.0] * 7) for i in range(7)]
    weekly = covariates.weekly_covariates(spark.createDataFrame(rows, DAILY))
    merged = covariates.merge_covariates(panel, weekly)
    assert merged.count() == 3
    cov = covariates.coverage(merged).first()
    assert (cov.n_rows, cov.n_missing_covariates) == (3, 2)
