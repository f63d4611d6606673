"""Batch scoring of requested (region, entity) pairs and the post-scoring
rules (B12: M16, M17, F13-F17, F20, F21).

The original scored one pair per request through three remote calls; here
all requested pairs are assembled with joins (activity, corridor, recent
covariates) and scored by one ``transform``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.calendar import week_cos, week_sin
from tessera.operators.recent import check_known, zero_activity
from tessera.schemas import require_columns


def assemble_features(requests: DataFrame, activity: DataFrame, corridor: DataFrame, weather: DataFrame,
                      as_of, region: str = "state", entity: str = "comName") -> DataFrame:
    """One feature row per requested pair: recent activity (zeros when
    none), corridor sums, the region's recent covariates, and the ISO week of
    ``as_of`` with its season terms."""
    t0 = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else F.lit(as_of)
    req = requests.select(region, entity).distinct()
    feats = zero_activity(req, activity, (region, entity))
    feats = feats.join(corridor, [region, entity], "left")
    require_columns(weather, [region], "recent covariates")
    feats = feats.join(weather, region, "left")
    week = F.weekofyear(t0)
    return feats.select("*", week.alias("week_of_year"), week_sin(week).alias("week_sin"),
                        week_cos(week).alias("week_cos"))


def fixed_probability(feats: DataFrame) -> DataFrame:
    """Deterministic stand-in for the model (rational arithmetic only):
    p = (l1 + c1 + 1) / (l1 + l2 + c1 + c2 + 2)."""
    l1, l2 = F.col("lag_1_obs_count"), F.col("lag_2_obs_count")
    c1 = F.coalesce(F.col("south_corridor_obs_last_7d"), F.lit(0.0))
    c2 = F.coalesce(F.col("south_corridor_obs_prev_7d"), F.lit(0.0))
    p = (l1 + c1 + F.lit(1.0)) / (l1 + l2 + c1 + c2 + F.lit(2.0))
    return feats.withColumn("probability_present", p).withColumn("prediction", (p >= 0.5).cast("int"))


def apply_rules(df: DataFrame, state: str = "state", entity: str = "comName") -> DataFrame:
    """Label, band, arrival text, northern caution, final text and the
    display conversions, as columns."""
    p = F.col("probability_present")
    local = F.col("lag_1_obs_count")
    corr = F.coalesce(F.col("south_corridor_obs_last_7d"), F.lit(0.0))
    interp = rules.interpret_probability(p)
    adjusted = rules.adjusted_interpretation(F.col(state), p, local)
    return df.select(
        state, entity, "week_of_year",
        "lag_1_obs_count", "lag_2_obs_count", "south_corridor_obs_last_7d", "south_corridor_obs_prev_7d",
        "probability_present", "prediction",
        rules.prediction_label(F.col("prediction")).alias("prediction_label"),
        interp.alias("interpretation"),
        rules.arrival_window(p, corr, local).alias("arrival_estimate"),
        rules.migration_warning(F.col(state), p, local).alias("migration_warning"),
        adjusted.alias("adjusted_interpretation"),
        rules.final_interpretation(adjusted, interp).alias("final_interpretation"),
        rules.c_to_f(F.col("temp_mean_7d")).alias("temp_mean_f"),
        rules.c_to_f(F.col("temp_max_7d")).alias("temp_max_f"),
        rules.c_to_f(F.col("temp_min_7d")).alias("temp_min_f"),
        rules.mm_to_in(F.col("precip_sum_7d")).alias("precip_in"),
        rules.kmh_to_mph(F.col("wind_max_7d")).alias("wind_mph"),
        F.round(p * 100.0, 1).alias("probability_pct"),
    )


def full_row(scored: DataFrame, numeric, region: str = "state", entity: str = "comName", also=()) -> DataFrame:
    """The answer to a request as one row: names, prediction, texts, and
    the structs ``model_features`` (what the model was given) and
    ``corridor_features``.  ``also`` names columns of the request to keep."""
    p, local = F.col("probability_present"), F.col("lag_1_obs_count")
    corr = F.coalesce(F.col("south_corridor_obs_last_7d"), F.lit(0.0))
    return scored.select(
        F.col(region).alias("state"), F.col(entity).alias("bird_common_name"),
        F.col("scientific_name").alias("bird_scientific_name"), *also, "prediction", "probability_present",
        F.struct("species", "stateProvince", *numeric).alias("model_features"),
        F.struct("south_corridor_obs_last_7d", "south_corridor_obs_prev_7d").alias("corridor_features"),
        rules.prediction_label(F.col("prediction")).alias("prediction_label"),
        rules.interpret_probability(p).alias("interpretation"),
        rules.arrival_window(p, corr, local).alias("arrival_estimate"),
        rules.migration_warning(F.col(region), p, local).alias("migration_warning"),
        rules.adjusted_interpretation(F.col(region), p, local).alias("adjusted_interpretation"))


def to_model_features(feats: DataFrame, species_dim: DataFrame, region: str = "state",
                      entity: str = "comName", strict: bool = True) -> DataFrame:
    """Rename the assembled request features to the training schema:
    ``species`` = scientific name of the requested common name (lookup in the
    broadcast entity dimension), ``stateProvince`` = region.

    ``strict`` (J-4): a requested name missing from the dimension raises; when
    off, its ``species`` is NULL and the fitted imputer gives it the training
    mode."""
    if strict:
        feats = check_known(feats, species_dim, key=entity, dim_key="common_name", what="entity")
    names = F.broadcast(species_dim.select(F.col("common_name").alias(entity), F.col("scientific_name")))
    return (feats.join(names, entity, "left")
            .withColumn("species", F.col("scientific_name"))
            .withColumn("stateProvince", F.col(region)))


def model_probability(model, feats: DataFrame) -> DataFrame:
    """M9 on request rows: probability of presence and predicted class from
    a fitted pipeline (its own 0.5 threshold decides the class)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(feats)
    return out.select(*feats.columns,
                      vector_to_array("probability")[1].alias("probability_present"),
                      F.col("prediction").cast("int").alias("prediction"))
