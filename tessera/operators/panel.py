"""Dense entity x region x year x week panel with presence labels (B2).

Operators: P2/P3 filters, F1 ISO week, A1 weekly counts, A2 axes, J-1 grid,
J-2 densifying left join, F7 zero fill, W1 yearly peak, F11/F12 labels.

Plan shape (see README, "panel"):

* A1 is one hash aggregate on the four keys with map-side partial
  aggregation, so a hot entity/region is combined before the shuffle.
* The sparse counts are written once to the shared scratch folder and read
  back three times (axes, pairs, cells).  Nothing is cached: a later call sees
  files that landed in between.
* The grid is generated, not joined: entities meet regions through an
  equi-join on a fixed number of salts, the pairs are dealt by (entity,
  region), left-joined to one sorted array of cells per pair, and only then
  exploded over the (year, week) axis.  The dense rows - the largest data set
  of the job - are never shuffled.
* A pair's array holds at most |years| x |weeks| cells, a bound set by the
  calendar.  Each cell is exploded up to the next one, so the zero cells
  between two of them need no search.
* The yearly peak (W1) and the history windows downstream
  (``features.add_history``) are clustered on (entity, region, ...) and
  ordered by (year, week), so they reuse that single exchange and one sort.
* The distinct years and weeks are collected to the driver: a handful of
  numbers, whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.calendar import iso_week
from tessera.session import materialize

# Salts over which regions are spread when they are paired with entities.
PAIR_SALTS = 1024


def weekly_counts(obs: DataFrame, entity: str = "species", region: str = "stateProvince",
                  date: str = "eventDate", year: str = "year", month: str = "month",
                  entities: list | None = None, regions: list | None = None,
                  months: list | None = None) -> DataFrame:
    """A1: rows per (entity, region, year, ISO week) and the first date seen.

    Counts rows (reports), not the individual counts they carry.  Rows with a
    NULL date or a NULL key are dropped; IN-lists and the month window are
    optional (on a year/month-partitioned lake the month list prunes
    partitions).
    """
    cond = (F.col(date).isNotNull() & F.col(entity).isNotNull()
            & F.col(region).isNotNull() & F.col(year).isNotNull())
    if entities is not None:
        cond = cond & F.col(entity).isin(list(entities))
    if regions is not None:
        cond = cond & F.col(region).isin(list(regions))
    if months is not None:
        cond = cond & F.col(month).isin(list(months))
    return (
        obs.where(cond)
        .groupBy(F.col(entity), F.col(region), F.col(year).cast("int").alias(year),
                 iso_week(date).alias("week_of_year"))
        .agg(F.min(F.col(date).cast("date")).alias("first_event_date_in_week"),
             F.count(F.lit(1)).alias("obs_count"))
    )


def _time_axes(counts: DataFrame, year: str, week: str) -> tuple[list[int], list[int]]:
    row = counts.agg(F.sort_array(F.collect_set(year)), F.sort_array(F.collect_set(week))).first()
    return [int(y) for y in row[0] or []], [int(w) for w in row[1] or []]


def _entity_region_pairs(counts: DataFrame, entity: str, region: str) -> DataFrame:
    """Every entity with every region, dealt by (entity, region)."""
    regions = counts.select(region).distinct().withColumn("_salt", F.pmod(F.xxhash64(region), F.lit(PAIR_SALTS)))
    entities = counts.select(entity).distinct().withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PAIR_SALTS - 1).cast("bigint"))))
    return entities.join(regions, "_salt").select(entity, region).repartition(entity, region)


def dense_panel(counts: DataFrame, entity: str = "species", region: str = "stateProvince",
                year: str = "year", week: str = "week_of_year") -> DataFrame:
    """J-1/J-2/F7: every entity x region x year x week cell, zero-filled.

    Axes are the distinct values present in ``counts``; all (year, week)
    combinations are produced, even those that never occur together.
    """
    counts = materialize(counts, "panel-counts")
    years, weeks = _time_axes(counts, year, week)
    n_weeks, n_cells = len(weeks), len(years) * len(weeks)
    year_axis = F.array(*[F.lit(y) for y in years]).cast("array<int>")
    week_axis = F.array(*[F.lit(w) for w in weeks]).cast("array<int>")

    # A cell's place on the time axis; places run from 0 to n_cells - 1.
    place = (F.array_position(year_axis, F.col(year)) - 1) * F.lit(n_weeks) + F.array_position(week_axis, F.col(week)) - 1
    cells = counts.groupBy(entity, region).agg(F.sort_array(F.collect_list(F.struct(
        place.cast("int").alias("at"), "obs_count", "first_event_date_in_week"))).alias("_cells"))
    before = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("obs_count"),
                      F.lit(None).cast("date").alias("first_event_date_in_week"))
    spans = F.transform("_cells", lambda c, i: F.struct(
        c["at"].alias("at"), c["obs_count"].alias("n"), c["first_event_date_in_week"].alias("first"),
        F.coalesce(F.get("_cells", i + 1)["at"], F.lit(n_cells)).alias("next")))

    grid = _entity_region_pairs(counts, entity, region).join(cells, [entity, region], "left")
    grid = grid.withColumn("_cells", F.concat(F.array(before), F.coalesce("_cells", F.array().cast(
        "array<struct<at:int,obs_count:bigint,first_event_date_in_week:date>>"))))
    runs = grid.select(entity, region, F.inline(spans))
    dense = runs.select(entity, region, "at", "n", "first",
                        F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("_place")).where("_place >= 0")
    seen = F.col("_place") == F.col("at")
    return dense.select(
        entity, region,
        F.get(year_axis, F.floor(F.col("_place") / F.lit(max(1, n_weeks))).cast("int")).alias(year),
        F.get(week_axis, F.col("_place") % F.lit(max(1, n_weeks))).alias(week),
        F.when(seen, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("obs_count"),
        F.when(seen, F.col("first")).alias("first_event_date_in_week"),
    )


def add_labels(panel: DataFrame, entity: str = "species", region: str = "stateProvince",
               year: str = "year", week: str = "week_of_year") -> DataFrame:
    """W1 + F11/F12: yearly peak per (entity, region, year) and three labels.

    The relative label is ``obs_count >= 0.10 * peak`` for a positive peak,
    computed exactly in integers as ``10 * obs_count >= peak``.
    """
    w = (Window.partitionBy(entity, region, year).orderBy(week)
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    peak = F.max("obs_count").over(w)
    obs = F.col("obs_count")
    return (
        panel.withColumn("yearly_peak_count", peak)
        .withColumn("present_ge_1", F.when(obs >= 1, 1).otherwise(0))
        .withColumn("present_ge_5", F.when(obs >= 5, 1).otherwise(0))
        .withColumn("present_rel_10pct_peak",
                    F.when((F.col("yearly_peak_count") > 0) & (obs * 10 >= F.col("yearly_peak_count")), 1)
                    .otherwise(0))
    )


def build_panel(obs: DataFrame, entity: str = "species", region: str = "stateProvince",
                date: str = "eventDate", year: str = "year", month: str = "month",
                entities: list | None = None, regions: list | None = None,
                months: list | None = None) -> DataFrame:
    """B2 end to end: filtered observations -> dense labeled panel.

    Output columns: entity, region, year, week_of_year, obs_count,
    first_event_date_in_week, yearly_peak_count, present_ge_1, present_ge_5,
    present_rel_10pct_peak.
    """
    counts = weekly_counts(obs, entity, region, date, year, month, entities, regions, months)
    return add_labels(dense_panel(counts, entity, region, year), entity, region, year)


def write_panel(panel: DataFrame, path: str, entity: str = "species", region: str = "stateProvince",
                year: str = "year", week: str = "week_of_year") -> None:
    """Write the panel as one parquet table, rows ordered inside each
    file by the four keys (O1) without a global sort."""
    (panel.sortWithinPartitions(entity, region, year, week)
     .write.mode("overwrite").parquet(path))
