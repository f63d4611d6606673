"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator
group of the inventory.  Each reads the whole test tables (or data Spark
derives from them) and returns a lazy DataFrame; the column names equal
those of the matching SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dims import MAX_ITER_BASE, MAX_ITER_WEATHER, TARGET_COL, region_dim, species_dim
from tessera.functions.rules import fixed_text, percent_text
from tessera.operators import covariates, features, metrics, model, panel, profile, recent, score
from tessera.plans import fixture as fx
from tessera.schemas import LAGGED_COVARIATES, WEEKLY_COVARIATES
from tessera.session import materialize, scratch_path
from tessera.sources import lake, payloads, tables
from tessera.streaming.activity import run_fixture_stream


# --- panel (B2) -------------------------------------------------------------

def panel_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir)
    return panel.weekly_counts(obs, entities=fx.FIXTURE_ENTITIES, months=fx.FIXTURE_MONTHS)


def panel_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir)
    counts = panel.weekly_counts(obs, entities=fx.FIXTURE_ENTITIES, months=fx.FIXTURE_MONTHS)
    return panel.dense_panel(counts)


def panel_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixture_panel(spark, sf_dir)


def panel_labeled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixture_flag_panel(spark, sf_dir)


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(profile.label_balance(fx.fixture_flag_panel(spark, sf_dir)))


# --- features (B5) ----------------------------------------------------------

def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.fixture_history(spark, sf_dir)
    return fx.round_doubles(h.select(
        "species", "stateProvince", "year", "week_of_year", "obs_count", "present_rel_10pct_peak",
        *fx.HISTORY_COLUMNS))


# --- covariates (B3/B4) -----------------------------------------------------

def weekly_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(covariates.weekly_covariates(tables.daily_covariates(spark, sf_dir)))


def panel_with_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = covariates.weekly_covariates(tables.daily_covariates(spark, sf_dir))
    return fx.round_doubles(covariates.merge_covariates(fx.fixture_panel(spark, sf_dir), weekly))


def covariate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = covariates.weekly_covariates(tables.daily_covariates(spark, sf_dir))
    return covariates.coverage(covariates.merge_covariates(fx.fixture_panel(spark, sf_dir), weekly))


# --- profiling (B9) ---------------------------------------------------------

def partition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.partition_profile(tables.observations(spark, sf_dir))


def month_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.month_profile(tables.observations(spark, sf_dir))


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir)
    return profile.top_values_of(obs, ["species", "stateProvince"], k=fx.FIXTURE_TOP_K)


# --- splits and metrics (B6-B8) ---------------------------------------------

def time_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.fixture_panel(spark, sf_dir)
    s = model.with_split(p, fx.FIXTURE_TRAIN_END_YEAR, fx.FIXTURE_VALID_YEAR, fx.FIXTURE_TEST_YEAR)
    return fx.round_doubles(model.split_counts(s, "present_rel_10pct_peak"))


def grouped_metrics_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.fixture_scored_test(spark, sf_dir)
    return fx.round_doubles(metrics.grouped_metrics(
        scored, "stateProvince", flag_name="is_new_england", flag_members=fx.FIXTURE_FOCUS_REGIONS))


def grouped_metrics_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(metrics.grouped_metrics(fx.fixture_scored_test(spark, sf_dir), "species"))


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(metrics.overall_metrics(fx.fixture_scored_test(spark, sf_dir)))


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.fixture_scored_test(spark, sf_dir).groupBy("stateProvince").agg(*metrics.confusion_aggs())
    return metrics.error_summary(counts, "stateProvince")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(metrics.class_report(fx.fixture_scored_test(spark, sf_dir)))


# --- recent activity, corridor, recent covariates, rules (B10-B12) ----------

def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.prepare_reports(tables.recent_observations(spark, sf_dir))


def count_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("obs_id", "howMany", "obs_count")


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(recent.recent_activity(_reports(spark, sf_dir), fx.FIXTURE_AS_OF, landed="ts"))


def _requested_activity(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every reported (state, comName) as a request, and the activity of all: one scan of the reports, stored."""
    act = materialize(recent.recent_activity(reports, fx.FIXTURE_AS_OF, every_pair=True), "activity")
    return act.select("state", "comName"), act


def corridor_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, act = _requested_activity(_reports(spark, sf_dir))
    return recent.corridor_signal(requests, act, region_dim(spark))


def recent_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.daily_covariates(spark, sf_dir, by_state=True)
    return fx.round_doubles(recent.recent_covariates(daily, region="state"))


def presence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, act = _requested_activity(_reports(spark, sf_dir))
    corridor = recent.corridor_signal(requests, act, region_dim(spark))
    weather = recent.recent_covariates(tables.daily_covariates(spark, sf_dir, by_state=True), region="state")
    feats = score.assemble_features(requests, act, corridor, weather, fx.FIXTURE_AS_OF)
    return fx.round_doubles(score.apply_rules(score.fixed_probability(feats)))


# --- model (B6) ---------------------------------------------------------------

def _train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.fixture_history(spark, sf_dir)
    s = model.with_split(h, fx.FIXTURE_TRAIN_END_YEAR, fx.FIXTURE_VALID_YEAR, fx.FIXTURE_TEST_YEAR)
    return s.where(F.col("split") == "train")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.round_doubles(model.class_weights(_train_frame(spark, sf_dir), "present_rel_10pct_peak"))


def mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.mode_values(_train_frame(spark, sf_dir), model.BASE_CATEGORICAL)


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/M5 applied: every split row, numeric features zero-imputed and
    standardised with the training statistics."""
    h = model.with_split(fx.fixture_history(spark, sf_dir), fx.FIXTURE_TRAIN_END_YEAR,
                         fx.FIXTURE_VALID_YEAR, fx.FIXTURE_TEST_YEAR).where(F.col("split").isNotNull())
    stats = {r["feature"]: (r["mean"], r["scale"])
             for r in model.scaler_stats(h.where(F.col("split") == "train"), model.BASE_NUMERIC).collect()}
    cols = [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats[c][0])) / F.lit(stats[c][1]))
            .alias(f"{c}_std") for c in model.BASE_NUMERIC]
    return fx.round_doubles(h.select("species", "stateProvince", "year", "week_of_year", "split", *cols))


def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M6: one-hot digits of every split row; the levels come from training
    rows without one entity, which is therefore unknown (all zeros)."""
    h = model.with_split(fx.fixture_history(spark, sf_dir), fx.FIXTURE_TRAIN_END_YEAR, fx.FIXTURE_VALID_YEAR,
                         fx.FIXTURE_TEST_YEAR).where(F.col("split").isNotNull())
    h = h.select("species", "stateProvince", "year", "week_of_year", "split")
    train = h.where((F.col("split") == "train") & (F.col("species") != fx.FIXTURE_UNKNOWN_ENTITY))
    digits = [F.array_join(F.transform(f"{c}_onehot", lambda x: x.cast("int").cast("string")), "").alias(f"{c}_digits")
              for c in model.BASE_CATEGORICAL]
    return model.one_hot(train, h, model.BASE_CATEGORICAL).select(*h.columns, *digits)


WEATHER_NUMERIC = model.BASE_NUMERIC + WEEKLY_COVARIATES + LAGGED_COVARIATES


def _fit(feats: DataFrame, numeric, max_iter: int):
    return model.fit_presence_model(feats, TARGET_COL, fx.FIXTURE_TRAIN_END_YEAR, fx.FIXTURE_VALID_YEAR,
                                    fx.FIXTURE_TEST_YEAR, numeric=numeric, max_iter=max_iter)


def _reloaded(spark: SparkSession, fitted):
    """The model as every later job gets it: saved and loaded."""
    path = scratch_path(spark, "model")
    model.save_model(fitted, path)
    return model.load_model(path)


def _base_model(spark: SparkSession, sf_dir: str):
    return _fit(fx.fixture_history(spark, sf_dir), model.BASE_NUMERIC, MAX_ITER_BASE)


def _weather_model(spark: SparkSession, sf_dir: str):
    """History first, on the narrow panel; the covariates join its result."""
    weekly = covariates.weekly_covariates(tables.daily_covariates(spark, sf_dir))
    feats = covariates.merge_covariates(fx.fixture_history(spark, sf_dir), weekly)
    return _fit(feats, WEATHER_NUMERIC, MAX_ITER_WEATHER)


SCORE_KEY = ["species", "stateProvince", "year", "week_of_year"]


def _test_scores(fitted, split: DataFrame) -> DataFrame:
    test = split.where(F.col("split") == "test")
    return model.score(fitted, test, keep=[*SCORE_KEY, TARGET_COL]).withColumnRenamed(TARGET_COL, "y_true")


def train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the train years, save, load, score the test year."""
    fitted, split = _base_model(spark, sf_dir)
    return fx.round_doubles(_test_scores(_reloaded(spark, fitted), split))


def train_score_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariate variant: history features + 14 weekly covariates."""
    fitted, split = _weather_model(spark, sf_dir)
    return fx.round_doubles(_test_scores(_reloaded(spark, fitted), split))


def model_reload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows, and those whose score by the loaded model differs."""
    fitted, split = _base_model(spark, sf_dir)
    again = _test_scores(_reloaded(spark, fitted), split).select(
        *SCORE_KEY, F.col("y_proba").alias("p2"), F.col("y_pred").alias("h2"))
    both = _test_scores(fitted, split).join(again, SCORE_KEY, "full")
    same = F.col("y_proba").eqNullSafe(F.col("p2")) & F.col("y_pred").eqNullSafe(F.col("h2"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_diff"))


def fit_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the objective's gradient at the fitted coefficients, three digits."""
    fitted, split = _base_model(spark, sf_dir)
    return fx.round_doubles(model.objective_gradient(
        fitted, split, TARGET_COL, model.BASE_CATEGORICAL, model.BASE_NUMERIC), 3)


def model_metrics_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 with the fitted covariate model: test-year metrics per region with
    the focus-group flag, best F1 first."""
    fitted, split = _weather_model(spark, sf_dir)
    m = metrics.grouped_metrics(_test_scores(_reloaded(spark, fitted), split), "stateProvince",
                                flag_name="is_new_england", flag_members=fx.FIXTURE_FOCUS_REGIONS)
    return fx.round_doubles(metrics.rank_by_f1(m, "stateProvince"))


def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models, loaded, on validation and test: overall, per region,
    per entity; ``is_new_england`` marks the focus group."""
    parts = []
    for name, build in (("base", _base_model), ("weather", _weather_model)):
        fitted, split = build(spark, sf_dir)
        parts.append(model.evaluate(_reloaded(spark, fitted), split, TARGET_COL).select(F.lit(name).alias("model"), "*"))
    focus = (F.col("level") == "stateProvince") & F.col("key").isin(fx.FIXTURE_FOCUS_REGIONS)
    return fx.round_doubles(parts[0].unionByName(parts[1]).withColumn("is_new_england", focus))


def model_focus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focus group's regions only, best F1 first, on the fixed score."""
    m = metrics.grouped_metrics(fx.fixture_scored_test(spark, sf_dir), "stateProvince",
                                flag_name="is_new_england", flag_members=fx.FIXTURE_FOCUS_REGIONS)
    return fx.round_doubles(metrics.rank_by_f1(metrics.only_flagged(m, "is_new_england"), "stateProvince"))


def model_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 of the loaded model, validation and test."""
    fitted, split = _base_model(spark, sf_dir)
    loaded = _reloaded(spark, fitted)
    parts = [metrics.class_report(model.score(loaded, split.where(F.col("split") == s), keep=[TARGET_COL])
                                  .withColumnRenamed(TARGET_COL, "y_true")).select(F.lit(s).alias("split"), "*")
             for s in ("valid", "test")]
    return fx.round_doubles(parts[0].unionByName(parts[1]))


def presence_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16/M17/J-4 with a model fitted on the requested entities and regions
    and loaded: every requested pair is assembled (activity, corridor, recent
    covariates, season) and scored in one transform, then the rules apply.
    An unknown entity or region raises."""
    daily = tables.daily_covariates(spark, sf_dir, by_state=True)
    weekly = covariates.weekly_covariates(daily.withColumnRenamed("state", "stateProvince"))
    hist = features.add_history(panel.build_panel(tables.serving_observations(spark, sf_dir), months=fx.FIXTURE_MONTHS))
    fitted, _ = _fit(covariates.merge_covariates(hist, weekly), WEATHER_NUMERIC, MAX_ITER_WEATHER)
    requests, act = _requested_activity(recent.prepare_reports(tables.serving_reports(spark, sf_dir)))
    corridor = recent.corridor_signal(requests, act, region_dim(spark))
    feats = score.assemble_features(requests, act, corridor, recent.recent_covariates(daily, region="state"),
                                    fx.FIXTURE_AS_OF)
    scored = score.model_probability(_reloaded(spark, fitted), score.to_model_features(feats, species_dim(spark)))
    out = score.full_row(scored, WEATHER_NUMERIC)
    return out.select(
        *[F.round(c, 6).alias(c) if c == "probability_present" else F.col(c) for c in out.columns],
        percent_text("probability_present").alias("probability_text"),
        fixed_text("model_features.lag_1_obs_count", 0).alias("local_last_7d_text"))


# --- lake and payloads (B1, S6, S7) ---------------------------------------------

def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations landed as CSV, read with the declared
    schema, projected, written as a year/month lake, read back with
    partition discovery, profiled."""
    root = scratch_path(spark, "lake")
    lake.land_csv(lake.as_observation_rows(tables.observations(spark, sf_dir)), f"{root}/raw")
    back = lake.build_lake(spark, f"{root}/raw", f"{root}/lake")
    return profile.partition_profile(back)


def lake_spring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 pruning: the panel's weekly counts read from the lake with the
    spring months as a partition filter."""
    root = scratch_path(spark, "lake")
    lake.write_lake(lake.project_observations(lake.as_observation_rows(tables.observations(spark, sf_dir))), root)
    return panel.weekly_counts(lake.read_lake(spark, root), entities=fx.FIXTURE_ENTITIES, months=fx.FIXTURE_MONTHS)


def array_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily measures landed as parallel-array payloads and parsed back."""
    path = scratch_path(spark, "payload")
    payloads.land_json(payloads.pack_daily_payload(tables.daily_covariates(spark, sf_dir)), path)
    return fx.round_doubles(payloads.parse_daily_payload(payloads.read_daily_payload(spark, path)))


def report_payload_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports landed as JSON objects, read with the declared schema,
    normalised and binned (equals ``recent_activity``)."""
    path = scratch_path(spark, "reports")
    payloads.land_json(tables.recent_observations(spark, sf_dir).drop("ts"), path)
    reps = recent.prepare_reports(payloads.read_reports_json(spark, path))
    return fx.round_doubles(recent.recent_activity(reps, fx.FIXTURE_AS_OF))


# --- streaming (ST1) -------------------------------------------------------------

STREAM_DELAY = "1 day"
STREAM_ANCHOR = "2024-01-01"


def stream_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 on landed report files: two overlapping deliveries, a run after each,
    watermark 1 day, 7-day bins from 2024-01-01; only closed bins are emitted."""
    return run_fixture_stream(spark, tables.recent_observations(spark, sf_dir).drop("ts"), STREAM_DELAY, STREAM_ANCHOR,
                              split_at="2024-01-20 00:00:00", overlap_from="2024-01-15 00:00:00", state_partitions=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "panel_weekly_counts": panel_weekly_counts,
    "panel_dense_grid": panel_dense_grid,
    "panel_labeled": panel_labeled,
    "panel_labeled_flags": panel_labeled_flags,
    "label_balance": label_balance,
    "history_features": history_features,
    "weekly_covariates": weekly_covariates,
    "panel_with_covariates": panel_with_covariates,
    "covariate_coverage": covariate_coverage,
    "partition_profile": partition_profile,
    "month_profile": month_profile,
    "top_values": top_values,
    "time_split_counts": time_split_counts,
    "grouped_metrics_region": grouped_metrics_region,
    "grouped_metrics_entity": grouped_metrics_entity,
    "overall_metrics": overall_metrics,
    "error_summary": error_summary,
    "class_report": class_report,
    "count_normalize": count_normalize,
    "recent_activity": recent_activity,
    "corridor_signal": corridor_signal,
    "recent_covariates": recent_covariates,
    "presence_rules": presence_rules,
    "class_weights": class_weights,
    "mode_impute": mode_impute,
    "scaled_features": scaled_features,
    "encoded_features": encoded_features,
    "model_reload_diff": model_reload_diff,
    "fit_optimality": fit_optimality,
    "model_evaluation": model_evaluation,
    "model_class_report": model_class_report,
    "model_focus_report": model_focus_report,
    "train_score": train_score,
    "train_score_weather": train_score_weather,
    "presence_model_scores": presence_model_scores,
    "model_metrics_region": model_metrics_region,
    "lake_roundtrip": lake_roundtrip,
    "lake_spring_counts": lake_spring_counts,
    "array_payload": array_payload,
    "report_payload_activity": report_payload_activity,
    "stream_recent_activity": stream_recent_activity,
}
