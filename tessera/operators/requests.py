"""A10, A11 and M16 for requests that each have their own "now".

Every request (region, entity, as_of) looks at the four half-open 7-day bins
that end at its as_of.  No request meets reports one by one: reports are summed
by day, and by instant.  The days that lie wholly inside a bin come from the
daily sums (at most 28 a request); the five days that a border cuts come from
the instants of those days, with the exact comparison as a residual of the
equi-join on (region, entity, day).  A third of all reports on one region and
entity is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.calendar import week_cos, week_sin
from tessera.operators.recent import BIN_DAYS, N_BINS, check_known, with_activity_features
from tessera.session import materialize

KEYS = ["state", "comName", "as_of"]


def by_instant(reports: DataFrame, ts: str = "obs_ts", n: str = "obs_count") -> DataFrame:
    """Counts summed by region, entity and instant; reports without a time go."""
    return reports.where(F.col(ts).isNotNull()).groupBy("state", "comName", ts).agg(F.sum(n).alias(n))


def activity_at(requests: DataFrame, reports: DataFrame, ts: str = "obs_ts", n: str = "obs_count") -> DataFrame:
    """The activity features of every distinct request (state, comName,
    as_of); zeros where there are no reports."""
    asked = requests.select(*KEYS).distinct()
    instants = by_instant(reports, ts, n).select(
        "state", "comName", F.col(ts).alias("_ts"), F.col(n).alias("_n"), F.to_date(ts).alias("_day"))
    days = instants.groupBy("state", "comName", "_day").agg(F.sum("_n").alias("_n"))

    span = BIN_DAYS * N_BINS
    back = F.explode(F.sequence(F.lit(0), F.lit(span)))
    spread = asked.select("*", back.alias("_back")).withColumn("_day", F.date_sub(F.to_date("as_of"), F.col("_back")))
    cut = F.col("_back") % BIN_DAYS == 0  # days on which a bin begins or ends
    # A day b back, neither first nor last of its bin, lies in bin floor(b / 7) + 1.
    whole = spread.where(~cut).join(days, ["state", "comName", "_day"]).select(
        *KEYS, (F.floor(F.col("_back") / BIN_DAYS) + 1).alias("_k"), "_n")
    age = F.timestamp_diff("MICROSECOND", F.col("_ts"), F.col("as_of"))  # 0 < age <= 7 days: bin 1
    parts = spread.where(cut).join(instants, ["state", "comName", "_day"]).withColumn(
        "_k", F.ceil(age / F.lit(86_400_000_000 * BIN_DAYS))).where((age > 0) & F.col("_k").between(1, N_BINS)).select(*KEYS, "_k", "_n")
    sums = [F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0)).cast("double").alias(f"_bin{k}")
            for k in range(1, N_BINS + 1)]
    nothing = asked.select("*", F.lit(0).cast("bigint").alias("_k"), F.lit(0).cast("bigint").alias("_n"))
    return with_activity_features(whole.unionByName(parts).unionByName(nothing).groupBy(*KEYS).agg(*sums))


def corridor_at(requests: DataFrame, reports: DataFrame, region_dim: DataFrame) -> DataFrame:
    """A11 per request: sums over the regions of its southern corridor, at its
    own as_of.  An unknown region raises."""
    asked = check_known(requests.select(*KEYS).distinct(), region_dim)
    dim = F.broadcast(region_dim.select("state", "south_states"))
    legs = asked.join(dim, "state").select(*KEYS, F.explode_outer("south_states").alias("_south"))
    there = activity_at(legs.where(F.col("_south").isNotNull()).select(F.col("_south").alias("state"), "comName", "as_of"), reports)
    there = there.select(F.col("state").alias("_south"), "comName", "as_of", "lag_1_obs_count", "lag_2_obs_count")
    return legs.join(there, ["_south", "comName", "as_of"], "left").groupBy(*KEYS).agg(
        F.coalesce(F.sum("lag_1_obs_count"), F.lit(0.0)).alias("south_corridor_obs_last_7d"),
        F.coalesce(F.sum("lag_2_obs_count"), F.lit(0.0)).alias("south_corridor_obs_prev_7d"))


def features_at(requests: DataFrame, reports: DataFrame, region_dim: DataFrame) -> DataFrame:
    """M16 without covariates: activity, corridor and season of each request.
    The reports are read once; their sums by instant are stored."""
    reports = materialize(by_instant(reports), "reports-by-instant")
    week = F.weekofyear("as_of")
    return activity_at(requests, reports).join(corridor_at(requests, reports, region_dim), KEYS).select(
        "*", week.alias("week_of_year"), week_sin(week).alias("week_sin"), week_cos(week).alias("week_cos"))
