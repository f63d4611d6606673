"""Recent activity, corridor signal and recent covariates (B10/B11: S7, F5,
F9, F10, F18, F19, A10-A12, W7, J-4, J-5, P8, P13).

Everything is computed for all (region, entity) pairs at once from landed
reports; the original per-request loop over southern regions becomes one
explode + join + aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.counts import lenient_timestamp, normalize_count
from tessera.schemas import fail_when

BIN_DAYS = 7
N_BINS = 4


def prepare_reports(raw: DataFrame, ts: str = "obsDt", how_many: str = "howMany") -> DataFrame:
    """Parse report time leniently (bad -> NULL) and normalise the count
    (no count column at all -> 1 per report)."""
    count = normalize_count(how_many) if how_many in raw.columns else F.lit(1).cast("bigint")
    return raw.withColumn("obs_ts", lenient_timestamp(ts)).withColumn("obs_count", count)


def filter_entity(reports: DataFrame, name: str, column: str = "comName") -> DataFrame:
    """Reports of one entity; an empty frame with the same columns when
    the name column is missing."""
    if column not in reports.columns:
        return reports.limit(0)
    return reports.where(F.col(column) == F.lit(name))


def _as_of(as_of) -> F.Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else F.lit(as_of)


def recent_activity(reports: DataFrame, as_of, region: str = "state", entity: str = "comName",
                    ts: str = "obs_ts", n: str = "obs_count", landed: str | None = None,
                    every_pair: bool = False) -> DataFrame:
    """Per (region, entity), summed counts in four half-open
    7-day bins [as_of - 7k, as_of - 7(k-1)) and the features built on them.

    ``ts`` is parsed from text, which no scan can prune on.  ``landed`` names a
    native time column within a day of it, if there is one: its range (a day
    wider on both sides) pushes into the scan.  The bins are conditional sums
    of one partially-aggregated groupBy.  ``every_pair`` keeps the pairs that
    have reports at other times only, with zeros; it reads all reports once.
    """
    t0 = _as_of(as_of)
    start = t0 - F.expr(f"INTERVAL {BIN_DAYS * N_BINS} DAYS")
    r = reports
    if not every_pair:
        if landed:
            day = F.expr("INTERVAL 1 DAY")
            r = r.where((F.col(landed) >= start - day) & (F.col(landed) < t0 + day))
        r = r.where((F.col(ts) >= start) & (F.col(ts) < t0))
    bins = []
    for k in range(1, N_BINS + 1):
        lo = t0 - F.expr(f"INTERVAL {BIN_DAYS * k} DAYS")
        hi = t0 - F.expr(f"INTERVAL {BIN_DAYS * (k - 1)} DAYS")
        inside = (F.col(ts) >= lo) & (F.col(ts) < hi)
        bins.append(F.coalesce(F.sum(F.when(inside, F.col(n))), F.lit(0)).cast("double").alias(f"_bin{k}"))
    g = r.groupBy(region, entity).agg(*bins)
    return with_activity_features(g)


def with_activity_features(g: DataFrame) -> DataFrame:
    b1, b2, b3, b4 = (F.col(f"_bin{k}") for k in range(1, 5))
    return g.select(
        *[c for c in g.columns if not c.startswith("_bin")],
        b1.alias("lag_1_obs_count"),
        b2.alias("lag_2_obs_count"),
        b3.alias("lag_3_obs_count"),
        ((b1 + b2) / 2.0).alias("rolling_2wk_mean_obs_count"),
        ((b1 + b2 + b3) / 3.0).alias("rolling_3wk_mean_obs_count"),
        F.greatest(b1, b2, b3, b4).alias("rolling_4wk_max_obs_count"),
        ((b1 > 0) | (b2 > 0)).cast("int").alias("had_recent_activity"),
    )


def zero_activity(requests: DataFrame, activity: DataFrame, keys=("state", "comName")) -> DataFrame:
    """Requests left-joined to activity; pairs without reports get zeros."""
    cols = [c for c in activity.columns if c not in keys]
    j = requests.join(activity, list(keys), "left")
    return j.select(*[c for c in j.columns if c not in cols],
                    *[F.coalesce(F.col(c), F.lit(0).cast(activity.schema[c].dataType)).alias(c) for c in cols])


def check_known(requests: DataFrame, dim: DataFrame, key: str = "state", dim_key: str = "state",
                what: str = "state") -> DataFrame:
    """J-4: a lookup whose unmatched key is an error.  Returns ``requests``
    with the check compiled into the plan (raise_error in the task that
    meets an unknown key), so no extra job is run."""
    d = F.broadcast(dim.select(F.col(dim_key).alias("_known")).distinct())
    j = requests.join(d, F.col(key) == F.col("_known"), "left")
    guard = fail_when(F.col("_known").isNull(), F.concat(F.lit(f"Unsupported {what}: "), F.col(key).cast("string")))
    return j.where(F.coalesce(guard.isNull(), F.lit(True))).drop("_known")


def corridor_signal(requests: DataFrame, activity: DataFrame, region_dim: DataFrame,
                    region: str = "state", entity: str = "comName") -> DataFrame:
    """J-5/A11: for each requested (region, entity), the summed last-7-day and
    previous-7-day counts of the regions on its southern corridor.

    The corridor lists come from the (broadcast) dimension; an empty list
    gives zeros.  Unknown regions raise (J-4).
    """
    req = check_known(requests.select(region, entity).distinct(), region_dim, region, "state")
    dim = F.broadcast(region_dim.select(F.col("state").alias(region), "south_states"))
    legs = req.join(dim, region).select(region, entity, F.explode_outer("south_states").alias("_south"))
    act = activity.select(F.col(region).alias("_south"), F.col(entity).alias("_ent"),
                          "lag_1_obs_count", "lag_2_obs_count")
    j = legs.join(act, (legs["_south"] == act["_south"]) & (F.col(entity) == F.col("_ent")), "left")
    return j.groupBy(region, entity).agg(
        F.coalesce(F.sum("lag_1_obs_count"), F.lit(0.0)).alias("south_corridor_obs_last_7d"),
        F.coalesce(F.sum("lag_2_obs_count"), F.lit(0.0)).alias("south_corridor_obs_prev_7d"),
    )


RECENT_SPEC = [
    ("temp_mean_7d", "mean", "temperature_2m_mean"),
    ("temp_max_7d", "max", "temperature_2m_max"),
    ("temp_min_7d", "min", "temperature_2m_min"),
    ("precip_sum_7d", "sum", "precipitation_sum"),
    ("rain_sum_7d", "sum", "rain_sum"),
    ("snowfall_sum_7d", "sum", "snowfall_sum"),
    ("wind_max_7d", "max", "wind_speed_10m_max"),
]
MIN_HISTORY_ROWS = 14


def _slice_agg(kind: str, c: str, inside):
    v = F.when(inside, F.col(c))
    if kind == "mean":
        return F.avg(v)
    if kind == "max":
        return F.max(v)
    if kind == "min":
        return F.min(v)
    return F.coalesce(F.sum(v), F.lit(0.0))


def recent_covariates(daily: DataFrame, region: str = "stateProvince", date: str = "date",
                      spec=RECENT_SPEC, min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Per region, aggregates over its latest 7 daily rows and
    over the 7 rows before them (positional, by date).  A region with fewer
    than ``min_rows`` rows raises.

    ``row_number() <= 14`` per region is planned as a group limit that keeps
    14 rows per region before the shuffle, so a long history costs nothing.
    """
    measures = {m for _, _, m in spec}
    d = daily.select(region, date, *[F.nanvl(F.col(m), F.lit(None).cast("double")).alias(m) for m in measures])
    rn = F.row_number().over(Window.partitionBy(region).orderBy(F.col(date).desc()))
    last = d.withColumn("_rn", rn).where(F.col("_rn") <= min_rows)
    cur, prev = F.col("_rn") <= 7, (F.col("_rn") > 7) & (F.col("_rn") <= 14)
    aggs = ([_slice_agg(k, m, cur).cast("double").alias(o) for o, k, m in spec]
            + [_slice_agg(k, m, prev).cast("double").alias(f"lag_1_{o}") for o, k, m in spec])
    g = last.groupBy(region).agg(F.max("_rn").alias("_n"), *aggs)
    guard = fail_when(F.col("_n") < min_rows, F.concat(
        F.lit(f"Need at least {min_rows} days of daily data; region "), F.col(region).cast("string"),
        F.lit(" has "), F.col("_n").cast("string")))
    return g.where(F.coalesce(guard.isNull(), F.lit(True))).drop("_n")
