"""Registered queries of files and tables at rest - sniffed CSV, increments,
quarantine, range layout, buckets, footers - and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import covariates, panel, profile
from tessera.plans import fixture as fx
from tessera.plans.oracle import ORACLE as BASE, _strs
from tessera.schemas import KEEP_COLUMNS, OBSERVATION_SCHEMA
from tessera.session import compiled_methods, materialize, scratch_path, spare_disk
from tessera.sources import lake, rest, sniff, tables
from tessera.sources.landing import Landing

#: Delimiter of the files that hold the records of a year, by year % 3.
SEPARATORS = [",", "\t", ";"]
#: How deliveries are written.
DELIVERY = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 500_000}
#: The folder whose records arrive in the second delivery.
LATE_YEAR, LATE_MONTH = 1998, 5
#: Regions and entities of the filtered counts.
SOME_REGIONS = ["NATION_1", "NATION_7", "NATION_20"]
SOME_ENTITIES = ["BUILDING", "MACHINERY"]


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.full_observations(spark, sf_dir)


def _land_csv(rows: DataFrame, path: str, sep: str, mode: str = "overwrite", **options) -> None:
    (rows.write.mode(mode).options(**options).option("header", True).option("sep", sep).option("dateFormat", "yyyy-MM-dd")
     .option("quote", '"').option("escape", '"').csv(path))


def _deliver(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A delivery of comma files as they are sent: compressed.  Such a file is read by one task, so its rows are bounded."""
    with spare_disk(rows.sparkSession):
        _land_csv(rows, path, ",", mode, **DELIVERY)


def lake_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 22 columns landed as comma, tab and semicolon files, read
    with sniffed dialects and types; each column's type, count, distinct
    values, least and greatest."""
    root = scratch_path(spark, "sniffed")
    full = materialize(_full(spark, sf_dir), "full")  # joined once, not once for each kind of file
    for i, sep in enumerate(SEPARATORS):
        _land_csv(full.where(F.col("year") % 3 == i), f"{root}/raw/part{i}", sep)
    back = lake.project_observations(sniff.read_csv_sniffed(spark, f"{root}/raw/*"))
    with compiled_methods(spark):
        back = materialize(back, "sniffed-rows")
    return profile.column_profile(back, KEEP_COLUMNS)


def lake_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries and a run over nothing new; rows of each folder and
    how often it was written."""
    root = scratch_path(spark, "increments")
    full = _full(spark, sf_dir)
    late = (F.col("year") == LATE_YEAR) & (F.col("month") == LATE_MONTH) & (F.col("day") > 15)
    landing = Landing(spark, f"{root}/raw", root)
    written = []
    for rows in (full.where(~late), full.where(late), None):
        if rows is not None:
            _deliver(rows, f"{root}/raw", mode="append")
        written += landing.run().folders
    times = spark.createDataFrame(written, "year int, month int").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_written"))
    return landing.rows().groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(times), ["year", "month"])


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not parse, by reason, counted in the table and
    by the pass itself; the good ones are in the lake."""
    root = scratch_path(spark, "quarantine")
    key = F.col("taxonKey")
    rough = _full(spark, sf_dir).select(*[
        F.when(key % 50 == 1, F.lit("yesterday")).otherwise(F.col("eventDate").cast("string")).alias("eventDate") if c == "eventDate"
        else F.when(key % 70 == 2, F.lit("many")).otherwise(F.col("individualCount").cast("string")).alias(c) if c == "individualCount"
        else F.when(key % 90 == 3, F.lit("north")).otherwise(F.col("decimalLatitude").cast("string")).alias(c) if c == "decimalLatitude"
        else F.col(f"`{c}`") for c in KEEP_COLUMNS])
    _deliver(rough, f"{root}/raw")
    landing = Landing(spark, f"{root}/raw", root)
    done = landing.run()
    parts = [landing.rejects().groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
             spark.createDataFrame([("all records", done.rows), ("all rejected", done.rejected)], "reason string, n bigint"),
             landing.rows().agg(F.lit("in the lake").alias("reason"), F.count(F.lit(1)).alias("n"))]
    return reduce(DataFrame.unionByName, parts)


def panel_range_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a table in key order, one entity's regions read back."""
    path = scratch_path(spark, "panel-table")
    rest.write_range_table(fx.fixture_panel(spark, sf_dir), path)
    return spark.read.parquet(path).where(F.col("species").isin(SOME_ENTITIES) & F.col("stateProvince").isin(SOME_REGIONS))


def panel_weekly_counts_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN-lists that leave out most entities and regions."""
    return panel.weekly_counts(tables.observations(spark, sf_dir), entities=SOME_ENTITIES, regions=SOME_REGIONS, months=fx.FIXTURE_MONTHS)


def panel_covariates_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3 on bucketed tables."""
    weekly = covariates.weekly_covariates(tables.daily_covariates(spark, sf_dir))
    return fx.round_doubles(rest.merge_at_rest(*rest.covariates_at_rest(fx.fixture_panel(spark, sf_dir), weekly, buckets=8)))


def lake_footer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 from the lake's footers."""
    root = scratch_path(spark, "lake")
    lake.write_lake(lake.project_observations(lake.as_observation_rows(tables.observations(spark, sf_dir))), root)
    return rest.footer_profile(spark, root)


QUERIES = {f.__name__: f for f in (lake_columns, lake_increments, quarantine_reasons, panel_range_table, panel_weekly_counts_some,
                                   panel_covariates_at_rest, lake_footer_counts)}


# ---- SQL ----

FULL = """WITH full_rows AS (
  SELECT CAST(l_shipdate AS DATE) AS "eventDate", CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
         CAST(day(l_shipdate) AS BIGINT) AS day, 'R' || n_regionkey AS "countryCode", n_name AS "stateProvince",
         'Site ' || c_custkey || ', "' || o_orderstatus || '"; east' AS locality,
         n_nationkey * 1.5 - 20.25 AS "decimalLatitude", -(c_custkey % 180) - 0.75 AS "decimalLongitude",
         'Animalia' AS kingdom, CASE WHEN l_linenumber > 1 THEN 'Chordata' END AS phylum, 'Aves' AS class, o_orderpriority AS "order",
         l_returnflag || l_linestatus AS family, 'Genus ' || l_linenumber AS genus, c_mktsegment AS species, 'SPECIES' AS "taxonRank",
         c_mktsegment || ' ' || l_linenumber AS "scientificName", CASE WHEN l_quantity > 0 THEN 'PRESENT' END AS "occurrenceStatus",
         CAST(l_quantity AS BIGINT) AS "individualCount", l_partkey AS "taxonKey", l_suppkey AS "speciesKey"
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

_TYPES = {"eventDate": "date", "decimalLatitude": "double", "decimalLongitude": "double"}
_NUMBERS = ["year", "month", "day", "individualCount", "taxonKey", "speciesKey"]
_BAD = [("eventDate", '"taxonKey" % 50 = 1'), ("decimalLatitude", '"taxonKey" % 90 = 3'), ("individualCount", '"taxonKey" % 70 = 2')]
_FIRST = "CASE " + " ".join(f"WHEN {cond} THEN 'bad value in column {c}'" for c, cond in _BAD) + " END"

ORACLE = {
    "lake_columns": FULL + " UNION ALL ".join(
        f"""\nSELECT '{c}' AS column_name, '{_TYPES.get(c, "bigint" if c in _NUMBERS else "string")}' AS column_type, count("{c}") AS n,
        count(DISTINCT "{c}") AS n_distinct, CAST(min("{c}") AS VARCHAR) AS least, CAST(max("{c}") AS VARCHAR) AS greatest FROM full_rows"""
        for c in KEEP_COLUMNS),
    "lake_increments": FULL + f"""
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, count(*) AS n_rows,
       CAST(count(DISTINCT year = {LATE_YEAR} AND month = {LATE_MONTH} AND day > 15) AS BIGINT) AS n_written
FROM full_rows GROUP BY year, month""",
    "quarantine_reasons": FULL + f""",
judged AS (SELECT {_FIRST} AS reason FROM full_rows)
SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'all records', count(*) FROM judged UNION ALL SELECT 'all rejected', count(reason) FROM judged
UNION ALL SELECT 'in the lake', count(*) FROM judged WHERE reason IS NULL""",
    "panel_range_table": f"SELECT * FROM ({BASE['panel_labeled']}) p WHERE species IN ({_strs(SOME_ENTITIES)}) AND stateProvince IN ({_strs(SOME_REGIONS)})",
    "panel_weekly_counts_some": f"SELECT * FROM ({BASE['panel_weekly_counts']}) p WHERE species IN ({_strs(SOME_ENTITIES)}) "
                                f"AND stateProvince IN ({_strs(SOME_REGIONS)})",
    "panel_covariates_at_rest": BASE["panel_with_covariates"],
    "lake_footer_counts": BASE["partition_profile"],
}
assert [f.name for f in OBSERVATION_SCHEMA.fields] == KEEP_COLUMNS
