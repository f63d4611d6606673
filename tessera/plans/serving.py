"""Registered queries of the serving side - live bins, requests with their own
time, arriving requests, reports as they really come - and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dims import DAILY_VARS, SPECIES_MAP, region_dim, species_dim
from tessera.operators import profile, recent, requests, score
from tessera.plans import fixture as fx
from tessera.plans.oracle import DIM_VALUES, ORACLE as BASE, RECENT_WX, REPORTS, _count_expr, _strs
from tessera.schemas import LAGGED_COVARIATES, WEEKLY_COVARIATES
from tessera.session import materialize, scratch_path
from tessera.sources import payloads, tables
from tessera.streaming.answers import answer_stream, answers
from tessera.streaming.live import activity_from_bins, live_bins, serving_bins

# Instants at which the live table is read, each after a delivery.
LIVE_AS_OF = ["2024-01-15 00:00:00", "2024-01-22 06:00:00", "2024-01-29 00:00:00"]
# Requests' own times: from the first hours of the reports to weeks after the last.
REQUEST_AS_OF = ["2024-01-01 06:00:00", "2024-01-02 00:00:00", "2024-01-10 12:30:00", "2024-01-29 00:00:00",
                 "2024-02-02 00:00:00", "2024-02-03 00:00:00", "2024-02-04 00:00:00", "2024-02-05 00:00:00",
                 "2024-02-06 00:00:00", "2024-02-20 00:00:00"]


def _delivery(reports: DataFrame, k: int) -> DataFrame:
    """What is landed before instant k: the reports since the one before, one
    in ten a delivery late, and the last two days once more."""
    at = [F.lit(t).cast("timestamp_ntz") for t in ["1970-01-01 00:00:00", "1970-01-01 00:00:00", *LIVE_AS_OF]]
    now, last, earlier = at[k + 2], at[k + 1], at[k]
    late = F.col("obs_id") % 10 == 3
    ts = F.col("ts")
    fresh = F.when(late, (ts >= earlier) & (ts < last)).otherwise((ts >= last) & (ts < now))
    again = ~late & (ts >= last - F.expr("INTERVAL 2 DAYS")) & (ts < last)
    return reports.where(fresh | again).drop("ts")


def live_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1/A10: the live table read after each of three deliveries."""
    root = scratch_path(spark, "live")
    reports = tables.recent_observations(spark, sf_dir)
    seen = []
    for k, as_of in enumerate(LIVE_AS_OF):
        payloads.land_json(_delivery(reports, k), f"{root}/landing", mode="append")
        live_bins(spark, f"{root}/landing", f"{root}/serving", f"{root}/checkpoint", state_partitions=8)
        now = activity_from_bins(serving_bins(spark, f"{root}/serving"), as_of)
        seen.append(materialize(now.select(F.lit(as_of).alias("as_of"), "*"), "live-seen"))
    return fx.round_doubles(reduce(DataFrame.unionByName, seen))


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.prepare_reports(tables.rough_reports(spark, sf_dir))


def rough_report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of count and time, parsed."""
    return _rough(spark, sf_dir).select("obs_id", "obsDt", "howMany", "obs_ts", "obs_count")


def entity_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of one entity."""
    reports = recent.filter_entity(_rough(spark, sf_dir), list(SPECIES_MAP)[1])
    return reports.select("obs_id", "state", "comName", "obs_count")


def _requests(reports: DataFrame) -> DataFrame:
    times = F.array(*[F.lit(t).cast("timestamp_ntz") for t in REQUEST_AS_OF])
    return reports.select("state", "comName").distinct().select("*", F.explode(times).alias("as_of"))


def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10/A11/M16 with an as_of per request."""
    reports = _rough(spark, sf_dir)
    return fx.round_doubles(requests.features_at(_requests(reports), reports, region_dim(spark)))


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole answer to every request on the fixed probability,
    both structs laid out as columns, with the caution and its override."""
    reports = _rough(spark, sf_dir)
    feats = requests.features_at(_requests(reports), reports, region_dim(spark))
    weather = recent.recent_covariates(tables.daily_covariates(spark, sf_dir, by_state=True), region="state")
    named = score.to_model_features(feats.join(weather, "state", "left"), species_dim(spark))
    scored = score.fixed_probability(named)
    numeric = ["week_of_year", "lag_1_obs_count", "lag_2_obs_count", "had_recent_activity", *WEEKLY_COVARIATES, *LAGGED_COVARIATES]
    rows = score.full_row(scored, numeric, also=["as_of"])
    final = F.coalesce("adjusted_interpretation", "interpretation").alias("final_interpretation")
    return fx.round_doubles(rows.select(
        *[c for c in rows.columns if not c.endswith("_features")], final,
        *[F.col(f"model_features.{c}").alias(f"model_{c}") for c in ["species", "stateProvince", *numeric]], "corridor_features.*"))


def stream_request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 on arriving requests: the rows of ``presence_rules``, answered in
    two deliveries of a stream."""
    reps = recent.prepare_reports(tables.recent_observations(spark, sf_dir))
    act = materialize(recent.recent_activity(reps, fx.FIXTURE_AS_OF, landed="ts"), "activity")
    asked = materialize(reps.select("state", "comName").distinct(), "requests")
    weather = recent.recent_covariates(tables.daily_covariates(spark, sf_dir, by_state=True), region="state")
    corridor = recent.corridor_signal(asked, act, region_dim(spark))
    feats = materialize(score.assemble_features(asked, act, corridor, weather, fx.FIXTURE_AS_OF), "features")
    root = scratch_path(spark, "answers")
    numbered = asked.select(F.xxhash64("state", "comName").alias("request_id"), "state", "comName")
    for part in (0, 1):
        payloads.land_json(numbered.where(F.pmod("request_id", F.lit(2)) == part), f"{root}/landing", mode="append")
        answer_stream(spark, f"{root}/landing", f"{root}/sink", f"{root}/checkpoint", feats,
                      lambda df: fx.round_doubles(score.apply_rules(score.fixed_probability(df))))
    return answers(spark, f"{root}/sink")


def payload_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 without declared measures: payloads with one more array than is
    known, as rows (region, date, measure, value)."""
    path = scratch_path(spark, "payload")
    daily = tables.daily_covariates(spark, sf_dir).withColumn("relative_humidity", F.col("rain_sum") * 2)
    payloads.land_json(payloads.pack_daily_payload(daily, measures=[*DAILY_VARS, "relative_humidity"]), path)
    return fx.round_doubles(payloads.read_any_measures(spark, path))


def table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of three tables as rows."""
    parts = [profile.describe_schema(tables.table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "column_name", "column_type")
             for t in ("lineitem", "events", "customer")]
    return reduce(DataFrame.unionByName, parts)


def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the panel in key order."""
    panel = fx.fixture_panel(spark, sf_dir)
    keys = ["species", "stateProvince", "year", "week_of_year"]
    return profile.preview(panel.orderBy(*keys).select(*keys, "obs_count"), 5)


QUERIES = {f.__name__: f for f in (
    live_recent_activity, rough_report_values, entity_reports, request_features, request_answers, stream_request_rules,
    payload_measures, table_schemas, table_preview)}


# ---- SQL ----

_NAMES = _strs(SPECIES_MAP)
_ODD = " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(["", " x ", "X", "2.7", "1e3", "abc", "5d", " 7 ", "-3", "1_000"]))
ROUGH = REPORTS.split("reports AS")[0].strip().rstrip(",") + f""",
rough AS (
  SELECT raw.obs_id, state, ([{_NAMES}])[(raw.obs_id % 4) + 1] AS comName,
         CASE raw.obs_id % 16 WHEN 0 THEN NULL {_ODD} ELSE howMany END AS howMany,
         CASE raw.obs_id % 9 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M') || ':30Z'
              WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M') || ':30+02:00' WHEN 3 THEN strftime(ts, '%Y-%m-%d')
              WHEN 4 THEN 'garbage' WHEN 5 THEN NULL ELSE obsDt END AS obsDt
  FROM raw JOIN events ON event_id = raw.obs_id
),
reports AS (
  SELECT *, TRY_CAST(regexp_replace(obsDt, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', '') AS TIMESTAMP) AS obs_ts, {_count_expr('howMany')} AS obs_count
  FROM rough
)"""


def _bins(n: str = "n", by: str = "as_of") -> str:
    return ", ".join(
        f"CAST(COALESCE(SUM({n}) FILTER (WHERE obs_ts >= {by} - INTERVAL {7 * k} DAY AND obs_ts < {by} - INTERVAL {7 * (k - 1)} DAY), 0) AS DOUBLE) AS b{k}"
        for k in range(1, 5))


_FEATURES = """b1 AS lag_1_obs_count, b2 AS lag_2_obs_count, b3 AS lag_3_obs_count, ROUND((b1 + b2) / 2.0, 6) AS rolling_2wk_mean_obs_count,
       ROUND((b1 + b2 + b3) / 3.0, 6) AS rolling_3wk_mean_obs_count, GREATEST(b1, b2, b3, b4) AS rolling_4wk_max_obs_count,
       CAST(b1 > 0 OR b2 > 0 AS INTEGER) AS had_recent_activity"""

_LIVE = ", ".join(f"('{t}', TIMESTAMP '{t}', TIMESTAMP '{b}')" for t, b in zip(LIVE_AS_OF, ["1970-01-01 00:00:00", *LIVE_AS_OF], strict=False))
_TIMES = ", ".join(f"(TIMESTAMP '{t}')" for t in REQUEST_AS_OF)

REQUESTED = "WITH " + ROUGH + f""",
asked AS (
  SELECT state, comName, as_of FROM (SELECT state, comName FROM reports GROUP BY ALL) pairs, (VALUES {_TIMES}) times(as_of)
),
sums AS (
  SELECT a.state, a.comName, a.as_of, {_bins("r.obs_count", "a.as_of")}
  FROM asked a LEFT JOIN reports r ON r.state = a.state AND r.comName = a.comName AND r.obs_ts >= a.as_of - INTERVAL 28 DAY AND r.obs_ts < a.as_of
  GROUP BY ALL
),
legs AS (SELECT state, unnest(south) AS south FROM (VALUES {DIM_VALUES}) dim(state, south)),
corridor AS (
  SELECT a.state, a.comName, a.as_of, COALESCE(SUM(s.b1), 0) AS c1, COALESCE(SUM(s.b2), 0) AS c2
  FROM asked a LEFT JOIN legs l ON l.state = a.state
  LEFT JOIN sums s ON s.state = l.south AND s.comName = a.comName AND s.as_of = a.as_of
  GROUP BY ALL
),
feats AS (
  SELECT state, comName, as_of, {_FEATURES}, c1 AS south_corridor_obs_last_7d, c2 AS south_corridor_obs_prev_7d,
         CAST(week(as_of) AS INTEGER) AS week_of_year, ROUND(sin(2 * pi() * week(as_of) / 52), 6) + 0.0 AS week_sin,
         ROUND(cos(2 * pi() * week(as_of) / 52), 6) + 0.0 AS week_cos
  FROM sums JOIN corridor USING (state, comName, as_of)
)"""


def _answers_sql() -> str:
    from tessera.functions import rules as r
    wx = [*WEEKLY_COVARIATES, *LAGGED_COVARIATES]
    lo, mid, hi = r.BAND_CUTS
    now, soon, maybe = r.ARRIVAL_CUTS
    caution = f"state IN ({_strs(['Maine', 'New Hampshire', 'Vermont'])}) AND p >= {r.NORTHERN_MIN_PROBABILITY} AND l1 < {r.NORTHERN_MIN_LOCAL}"
    names = ", ".join(f"('{c}', '{s}')" for c, (s, _) in SPECIES_MAP.items())
    return REQUESTED + "," + RECENT_WX + f""",
names AS (SELECT * FROM (VALUES {names}) n(comName, scientific)),
scored AS (
  SELECT f.*, n.scientific, lag_1_obs_count AS l1, south_corridor_obs_last_7d AS c1,
         (lag_1_obs_count + south_corridor_obs_last_7d + 1.0)
           / (lag_1_obs_count + lag_2_obs_count + south_corridor_obs_last_7d + south_corridor_obs_prev_7d + 2.0) AS p,
         {", ".join("w." + c for c in wx)}
  FROM feats f JOIN names n USING (comName) LEFT JOIN recent_wx w ON w.state = f.state
),
ruled AS (
  SELECT *, CASE WHEN p < {lo} THEN '{r.BAND_LOW}' WHEN p < {mid} THEN '{r.BAND_EMERGING}' WHEN p < {hi} THEN '{r.BAND_LIKELY}' ELSE '{r.BAND_STRONG}' END AS band,
         CASE WHEN p >= {now} THEN '{r.ARRIVAL_NOW}' WHEN p >= {soon} THEN '{r.ARRIVAL_1_2}'
              WHEN p >= {maybe} THEN CASE WHEN c1 > 0 OR l1 > 0 THEN '{r.ARRIVAL_2_3}' ELSE '{r.ARRIVAL_NONE}' END
              WHEN c1 > 0 THEN '{r.ARRIVAL_3_4}' ELSE '{r.ARRIVAL_NONE}' END AS arrival,
         CASE WHEN {caution} THEN '{r.NORTHERN_WARNING}' END AS warning, CASE WHEN {caution} THEN '{r.BAND_EMERGING}' END AS adjusted
  FROM scored
)
SELECT state, comName AS bird_common_name, scientific AS bird_scientific_name, as_of, CAST(p >= 0.5 AS INTEGER) AS prediction,
       ROUND(p, 6) AS probability_present, CASE WHEN p >= 0.5 THEN '{r.LABEL_PRESENT}' ELSE '{r.LABEL_ABSENT}' END AS prediction_label,
       band AS interpretation, arrival AS arrival_estimate, warning AS migration_warning, adjusted AS adjusted_interpretation,
       coalesce(adjusted, band) AS final_interpretation, scientific AS model_species, state AS "model_stateProvince",
       week_of_year AS model_week_of_year, lag_1_obs_count AS model_lag_1_obs_count, lag_2_obs_count AS model_lag_2_obs_count,
       had_recent_activity AS model_had_recent_activity, {", ".join(f"ROUND({c}, 6) AS model_{c}" for c in wx)},
       south_corridor_obs_last_7d, south_corridor_obs_prev_7d
FROM ruled"""


_DAILY = BASE["array_payload"].split("SELECT stateProvince, date, ROUND")[0]
_SCHEMA_TYPES = {t: tables.TABLE_SCHEMAS[t] for t in ("lineitem", "events", "customer")}

ORACLE = {
    "live_recent_activity": "WITH " + REPORTS.lstrip() + f""",
asked AS (SELECT * FROM (VALUES {_LIVE}) a(as_of_text, as_of, late_before)),
sums AS (
  SELECT as_of_text, state, comName, {_bins("obs_count")}
  FROM asked JOIN reports ON obs_ts < CASE WHEN obs_id % 10 = 3 THEN late_before ELSE as_of END AND obs_ts >= as_of - INTERVAL 28 DAY
  GROUP BY ALL
)
SELECT as_of_text AS as_of, state, comName, {_FEATURES} FROM sums""",
    "rough_report_values": "WITH " + ROUGH + "\nSELECT obs_id, obsDt, howMany, obs_ts, obs_count FROM reports",
    "entity_reports": "WITH " + ROUGH + f"\nSELECT obs_id, state, comName, obs_count FROM reports WHERE comName = '{list(SPECIES_MAP)[1]}'",
    "request_features": REQUESTED + "\nSELECT * FROM feats",
    "request_answers": _answers_sql(),
    "stream_request_rules": BASE["presence_rules"],
    "payload_measures": _DAILY + " UNION ALL BY NAME ".join(
        f"\nSELECT stateProvince, date, '{m}' AS measure, ROUND({e}, 6) AS value FROM daily"
        for m, e in [*((m, m) for m in DAILY_VARS), ("relative_humidity", "rain_sum * 2")]),
    "table_schemas": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c.split()[0]}' AS column_name, '{c.split()[1]}' AS column_type"
        for t, ddl in _SCHEMA_TYPES.items() for c in ddl.split(", ")),
    "table_preview": f"SELECT species, stateProvince, year, week_of_year, obs_count FROM ({BASE['panel_labeled']}) p "
                     "ORDER BY species, stateProvince, year, week_of_year LIMIT 5",
}
