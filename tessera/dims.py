"""Constant dimension tables.

Everything below the marker is a fixed value that has to equal the original
application's configuration for results to agree: the focus entities and
regions of the panel, the region dimension with its southern corridor lists,
the entity name/code map and the region subsets used by the evaluation and
scoring rules.  They are small by definition (tens of rows), so joins against
them broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original configuration exactly)
# ---------------------------------------------------------------------------

# Panel focus entities (scientific names) and regions, spring months.
TARGET_SPECIES = [
    "Archilochus colubris",
    "Setophaga petechia",
    "Icterus galbula",
    "Agelaius phoeniceus",
]
TARGET_STATES = [
    "Florida",
    "Georgia",
    "South Carolina",
    "North Carolina",
    "Virginia",
    "Maryland",
    "Delaware",
    "New Jersey",
    "Pennsylvania",
    "New York",
    "Connecticut",
    "Rhode Island",
    "Massachusetts",
    "Vermont",
    "New Hampshire",
    "Maine",
]
SPRING_MONTHS = [3, 4, 5, 6]

# Weather centroids used for the historical covariates (16 states, incl. Delaware).
WEATHER_STATE_COORDS = {
    "Florida": (27.6648, -81.5158),
    "Georgia": (32.1656, -82.9001),
    "South Carolina": (33.8361, -81.1637),
    "North Carolina": (35.7596, -79.0193),
    "Virginia": (37.4316, -78.6569),
    "Maryland": (39.0458, -76.6413),
    "Delaware": (38.9108, -75.5277),
    "New Jersey": (40.0583, -74.4057),
    "Pennsylvania": (41.2033, -77.1945),
    "New York": (42.9538, -75.5268),
    "Connecticut": (41.6032, -73.0877),
    "Rhode Island": (41.5801, -71.4774),
    "Massachusetts": (42.4072, -71.3824),
    "Vermont": (44.5588, -72.5778),
    "New Hampshire": (43.1939, -71.5724),
    "Maine": (45.2538, -69.4455),
}
WEATHER_START_DATE = "2016-03-01"
WEATHER_END_DATE = "2024-06-30"
DAILY_VARS = [
    "temperature_2m_mean",
    "temperature_2m_max",
    "temperature_2m_min",
    "precipitation_sum",
    "rain_sum",
    "snowfall_sum",
    "wind_speed_10m_max",
]

# Region dimension for scoring: state -> (lat, lon, region code, southern corridor).
STATE_CONFIG = {
    "Massachusetts": (42.4072, -71.3824, "US-MA", ["Connecticut", "New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "New Hampshire": (43.1939, -71.5724, "US-NH", ["Massachusetts", "Connecticut", "New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Maine": (45.2538, -69.4455, "US-ME", ["New Hampshire", "Massachusetts", "Connecticut", "New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Vermont": (44.5588, -72.5778, "US-VT", ["Massachusetts", "Connecticut", "New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Rhode Island": (41.5801, -71.4774, "US-RI", ["Connecticut", "New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Connecticut": (41.6032, -73.0877, "US-CT", ["New York", "New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "New York": (42.9538, -75.5268, "US-NY", ["New Jersey", "Pennsylvania", "Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Pennsylvania": (41.2033, -77.1945, "US-PA", ["Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "New Jersey": (40.0583, -74.4057, "US-NJ", ["Maryland", "Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Maryland": (39.0458, -76.6413, "US-MD", ["Virginia", "North Carolina", "South Carolina", "Georgia", "Florida"]),
    "Virginia": (37.4316, -78.6569, "US-VA", ["North Carolina", "South Carolina", "Georgia", "Florida"]),
    "North Carolina": (35.7596, -79.0193, "US-NC", ["South Carolina", "Georgia", "Florida"]),
    "South Carolina": (33.8361, -81.1637, "US-SC", ["Georgia", "Florida"]),
    "Georgia": (32.1656, -82.9001, "US-GA", ["Florida"]),
    "Florida": (27.6648, -81.5158, "US-FL", []),
}

# Entity names: common name -> (scientific name, source code).
SPECIES_MAP = {
    "Ruby-throated Hummingbird": ("Archilochus colubris", "rthhum"),
    "Yellow Warbler": ("Setophaga petechia", "yerwar"),
    "Baltimore Oriole": ("Icterus galbula", "balori"),
    "Red-winged Blackbird": ("Agelaius phoeniceus", "rewbla"),
}

# Region subsets used by the evaluation report and the scoring sanity rule.
NEW_ENGLAND_STATES = [
    "Connecticut",
    "Massachusetts",
    "Rhode Island",
    "Vermont",
    "New Hampshire",
    "Maine",
]
NORTHERN_STATES = ["Maine", "New Hampshire", "Vermont"]

# Model settings: target label, year split, solver iteration limits.
TARGET_COL = "present_rel_10pct_peak"
TRAIN_END_YEAR = 2022
VALID_YEAR = 2023
TEST_YEAR = 2024
MAX_ITER_BASE = 2000
MAX_ITER_WEATHER = 3000

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

REGION_DIM_SCHEMA = T.StructType([
    T.StructField("state", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("region_code", T.StringType(), False),
    T.StructField("south_states", T.ArrayType(T.StringType(), False), False),
])

SPECIES_DIM_SCHEMA = T.StructType([
    T.StructField("common_name", T.StringType(), False),
    T.StructField("scientific_name", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
])


def region_dim(spark: SparkSession, config: dict | None = None) -> DataFrame:
    """Region dimension (state, lat, lon, region_code, south_states)."""
    config = STATE_CONFIG if config is None else config
    rows = [(s, lat, lon, code, list(south)) for s, (lat, lon, code, south) in config.items()]
    return spark.createDataFrame(rows, REGION_DIM_SCHEMA)


def species_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """Entity dimension (common_name, scientific_name, code)."""
    mapping = SPECIES_MAP if mapping is None else mapping
    rows = [(c, s, code) for c, (s, code) in mapping.items()]
    return spark.createDataFrame(rows, SPECIES_DIM_SCHEMA)


def weather_coords_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, lat, lon) for s, (lat, lon) in WEATHER_STATE_COORDS.items()]
    return spark.createDataFrame(rows, "stateProvince string, lat double, lon double")


def state_order() -> list[str]:
    """States of the region dimension in their configured order."""
    return list(STATE_CONFIG.keys())
