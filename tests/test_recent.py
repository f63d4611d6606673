import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.dims import region_dim
from tessera.operators import recent

AS_OF = "2024-01-29 00:00:00"
RAW = "obs_id long, state string, comName string, obsDt string, howMany string"


def test_bins_are_half_open(spark):
    rows = [
        (1, "Georgia", "x", "2024-01-22 00:00", "2"),   # first instant of bin 1
        (2, "Georgia", "x", "2024-01-28 23:59", "X"),   # bin 1
        (3, "Georgia", "x", "2024-01-29 00:00", "5"),   # as_of itself: excluded
        (4, "Georgia", "x", "2024-01-21 23:59", "3"),   # bin 2
        (5, "Georgia", "x", "2024-01-01 00:00", "7"),   # first instant of bin 4
        (6, "Georgia", "x", "2023-12-31 23:59", "9"),   # before bin 4: excluded
        (7, "Georgia", "x", "not a date", "4"),          # unparsable: excluded
    ]
    reps = recent.prepare_reports(spark.createDataFrame(rows, RAW))
    r = recent.recent_activity(reps, AS_OF).first()
    assert (r.lag_1_obs_count, r.lag_2_obs_count, r.lag_3_obs_count) == (3.0, 3.0, 0.0)
    assert r.rolling_4wk_max_obs_count == 7.0 and r.rolling_2wk_mean_obs_count == 3.0
    assert r.rolling_3wk_mean_obs_count == 2.0 and r.had_recent_activity == 1


def test_every_pair_adds_pairs_of_other_times_with_zeros(spark):
    rows = [(1, "Georgia", "x", "2024-01-23 10:00", "2"), (2, "Georgia", "y", "2023-01-23 10:00", "9"), (3, "Texas", "x", "junk", "4"),
            (4, None, "x", "2024-01-10 10:00", "3"), (5, "Georgia", "x", "2024-02-10 10:00", "8")]
    reps = recent.prepare_reports(spark.createDataFrame(rows, RAW))
    inside = {tuple(r) for r in recent.recent_activity(reps, AS_OF).collect()}
    every = {tuple(r) for r in recent.recent_activity(reps, AS_OF, every_pair=True).collect()}
    assert inside < every and {r[:2] for r in every} == {r[1:3] for r in rows}
    assert all(not any(r[2:]) for r in every - inside)


def test_missing_count_column_counts_one(spark):
    df = spark.createDataFrame([(1, "Georgia", "x", "2024-01-25 10:00")], "obs_id long, state string, comName string, obsDt string")
    assert recent.prepare_reports(df).first().obs_count == 1


def test_filter_entity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "obs_id long, comName string")
    assert recent.filter_entity(df, "a").count() == 1
    assert recent.filter_entity(df.drop("comName"), "a").count() == 0


def test_corridor_sums_and_empty_list(spark):
    rows = [(1, "Georgia", "x", "2024-01-25 10:00", "4"), (2, "Florida", "x", "2024-01-25 10:00", "5"),
            (3, "Florida", "x", "2024-01-17 10:00", "6"), (4, "Florida", "y", "2024-01-25 10:00", "1")]
    reps = recent.prepare_reports(spark.createDataFrame(rows, RAW))
    act = recent.recent_activity(reps, AS_OF)
    req = spark.createDataFrame([("Georgia", "x"), ("Florida", "x"), ("South Carolina", "x"), ("Maine", "z")],
                                "state string, comName string")
    got = {(r.state, r.comName): (r.south_corridor_obs_last_7d, r.south_corridor_obs_prev_7d)
           for r in recent.corridor_signal(req, act, region_dim(spark)).collect()}
    assert got[("Georgia", "x")] == (5.0, 6.0)
    assert got[("Florida", "x")] == (0.0, 0.0)
    assert got[("South Carolina", "x")] == (9.0, 6.0)
    assert got[("Maine", "z")] == (0.0, 0.0)


def test_unknown_region_raises(spark):
    act = spark.createDataFrame([], "state string, comName string, lag_1_obs_count double, lag_2_obs_count double")
    req = spark.createDataFrame([("Delaware", "x")], "state string, comName string")
    with pytest.raises(Exception, match="Unsupported state: Delaware"):
        recent.corridor_signal(req, act, region_dim(spark)).collect()


DAILY = ("state string, date date, temperature_2m_mean double, temperature_2m_max double, temperature_2m_min double, "
         "precipitation_sum double, rain_sum double, snowfall_sum double, wind_speed_10m_max double")


def test_recent_covariates_positional_slices(spark):
    base = dt.date(2024, 1, 1)
    rows = [("S", base + dt.timedelta(days=i), float(i), float(i), float(i), 1.0, None, 0.5, float(i)) for i in range(20)]
    r = recent.recent_covariates(spark.createDataFrame(rows, DAILY), region="state").first()
    # last 7 rows: days 13..19, the 7 before: 6..12
    assert r.temp_mean_7d == 16.0 and r.temp_max_7d == 19.0 and r.temp_min_7d == 13.0
    assert r.lag_1_temp_mean_7d == 9.0 and r.precip_sum_7d == 7.0 and r.rain_sum_7d == 0.0


def test_recent_covariates_needs_14_rows(spark):
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(13)]
    with pytest.raises(Exception, match="at least 14"):
        recent.recent_covariates(spark.createDataFrame(rows, DAILY), region="state").collect()


def test_full_row_carries_names_and_both_structs(spark):
    from tessera.operators import score

    row = spark.createDataFrame(
        [("Maine", "Yellow Warbler", "Setophaga petechia", "Setophaga petechia", "Maine", 20, 1.0, 0.0, 3.0, 0.0, 0.9, 1,
          10.0, 15.0, 5.0, 25.4, 10.0)],
        "state string, comName string, scientific_name string, species string, stateProvince string, week_of_year int, "
        "lag_1_obs_count double, lag_2_obs_count double, south_corridor_obs_last_7d double, "
        "south_corridor_obs_prev_7d double, probability_present double, prediction int, temp_mean_7d double, "
        "temp_max_7d double, temp_min_7d double, precip_sum_7d double, wind_max_7d double")
    r = score.full_row(row, ["week_of_year", "lag_1_obs_count"]).first()
    assert set(r.asDict()) == {
        "bird_common_name", "bird_scientific_name", "state", "prediction", "prediction_label", "probability_present",
        "interpretation", "arrival_estimate", "model_features", "corridor_features", "migration_warning",
        "adjusted_interpretation"}
    assert r.bird_scientific_name == "Setophaga petechia" and r.model_features.lag_1_obs_count == 1.0
    assert r.corridor_features.south_corridor_obs_last_7d == 3.0 and r.adjusted_interpretation == "Emerging signal"
