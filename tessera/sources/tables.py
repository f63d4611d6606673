"""Reading the driver's test tables and mapping them onto the data model.

The test tables are TPC-H-like.  The mapping (also in FIXTURES.md):

* observations: one row per lineitem; entity ``species`` = customer market
  segment, region ``stateProvince`` = customer nation name, ``eventDate`` =
  ship date (year/month/day derived from it).
* flag observations (a dense variant): entity = return flag, region =
  supplier's region name.
* daily covariates: per customer nation and ship day, seven aggregates of
  the line measures standing for the seven daily weather measures.
* recent observations: ``events``; entity = event type, region = the state
  at position ``user_id % 15`` of the region dimension, reported count =
  key ``k`` of ``props``, report time = ``ts`` as a minute-precision string.

Every reader selects only the columns it needs, so the parquet scans carry
a pruned ``ReadSchema``; filters applied downstream push into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dims import SPECIES_MAP, state_order

# As-of instant of the recent-activity fixture (the fourth 7-day bin starts
# exactly at the first event day).
RECENT_AS_OF = "2024-01-29 00:00:00"


# Declared schemas of the test tables (as FIXTURES.md lists them).  Reading
# with a schema skips the footer-reading job Spark runs to infer one.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _customer_region(spark: SparkSession, sf_dir: str, by_state: bool = False) -> DataFrame:
    """orders -> (o_orderkey, species, stateProvince).  ``nation`` has 25 rows
    by the TPC-H definition, so it is broadcast; the orders/customer join is
    left to the planner (AQE turns it into a broadcast only if the measured
    customer side is small).  With ``by_state`` the region is the state at
    position ``nationkey % 15`` of the region dimension instead of the
    nation name."""
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    oc = orders.join(customer, orders.o_custkey == customer.c_custkey)
    if by_state:
        return oc.select("o_orderkey", F.col("c_mktsegment").alias("species"),
                         state_of_user("c_nationkey").alias("stateProvince"))
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return (
        oc.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.col("c_mktsegment").alias("species"), F.col("n_name").alias("stateProvince"))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation stand-in with (species, stateProvince, eventDate, year, month, day)."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    who = _customer_region(spark, sf_dir)
    return (
        li.join(who, li.l_orderkey == who.o_orderkey)
        .select(
            "species", "stateProvince",
            F.to_date("l_shipdate").alias("eventDate"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            F.dayofmonth("l_shipdate").alias("day"),
        )
    )


def _one_of(values, key: str) -> F.Column:
    """The value at position ``key % len(values)``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def serving_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in the vocabulary of the requests: species = scientific
    name at position ``custkey % 4``, region = state at ``nationkey % 15``."""
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    who = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", _one_of([s for s, _ in SPECIES_MAP.values()], "c_custkey").alias("species"),
        state_of_user("c_nationkey").alias("stateProvince"))
    return li.join(who, li.l_orderkey == who.o_orderkey).select(
        "species", "stateProvince", F.to_date("l_shipdate").alias("eventDate"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.dayofmonth("l_shipdate").alias("day"))


def serving_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recent_observations`` with the common name at ``event_id % 4``."""
    return recent_observations(spark, sf_dir).withColumn("comName", _one_of(list(SPECIES_MAP), "obs_id"))


def flag_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense variant: species = l_returnflag, stateProvince = supplier's region name."""
    li = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_returnflag", "l_shipdate"])
    supplier = table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = (
        supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    return (
        li.join(geo, li.l_suppkey == geo.s_suppkey)
        .select(
            F.col("l_returnflag").alias("species"), F.col("r_name").alias("stateProvince"),
            F.to_date("l_shipdate").alias("eventDate"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            F.dayofmonth("l_shipdate").alias("day"),
        )
    )


def daily_covariates(spark: SparkSession, sf_dir: str, by_state: bool = False) -> DataFrame:
    """Daily measures per (stateProvince, date), named like the weather payload.

    snowfall_sum is NULL on days without returned lines, so weeks whose
    values are all NULL occur (their weekly sum is 0, their mean NULL).
    """
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"])
    who = _customer_region(spark, sf_dir, by_state)
    region = "state" if by_state else "stateProvince"
    return (
        li.join(who, li.l_orderkey == who.o_orderkey)
        .groupBy(F.col("stateProvince").alias(region), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.avg("l_quantity").alias("temperature_2m_mean"),
            F.max("l_quantity").alias("temperature_2m_max"),
            F.min("l_quantity").alias("temperature_2m_min"),
            F.sum("l_discount").alias("precipitation_sum"),
            F.sum("l_tax").alias("rain_sum"),
            F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("snowfall_sum"),
            (F.max("l_extendedprice") / F.lit(1000.0)).alias("wind_speed_10m_max"),
        )
    )


def state_of_user(user_id: str) -> F.Column:
    """State at position ``user_id % 15`` of the region dimension."""
    states = state_order()
    arr = F.array(*[F.lit(s) for s in states])
    return F.element_at(arr, (F.pmod(F.col(user_id), F.lit(len(states))) + 1).cast("int"))


def recent_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent report stand-in: (obs_id, state, comName, obsDt string, howMany
    string) and the native time ``ts``."""
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return ev.select(
        F.col("event_id").alias("obs_id"),
        state_of_user("user_id").alias("state"),
        F.col("event_type").alias("comName"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("obsDt"),
        F.get_json_object("props", "$.k").alias("howMany"),
        "ts",
    )


def rough_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``serving_reports`` with counts and times as they really come: blank,
    ``x``, fractions, words; with a zone, date only, unreadable, missing."""
    base = serving_reports(spark, sf_dir)
    kind = F.col("obs_id") % 16
    odd = ["", " x ", "X", "2.7", "1e3", "abc", "5d", " 7 ", "-3", "1_000"]
    how_many = F.when(kind == 0, F.lit(None).cast("string"))
    for i, text in enumerate(odd):
        how_many = how_many.when(kind == i + 1, F.lit(text))
    minute = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    shape = F.col("obs_id") % 9
    when = (F.when(shape == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(shape == 1, F.concat(minute, F.lit(":30Z")))
            .when(shape == 2, F.concat(minute, F.lit(":30+02:00"))).when(shape == 3, F.date_format("ts", "yyyy-MM-dd"))
            .when(shape == 4, F.lit("garbage")).when(shape == 5, F.lit(None).cast("string")))
    return base.withColumn("howMany", how_many.otherwise(F.col("howMany"))).withColumn("obsDt", when.otherwise(F.col("obsDt")))


def full_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation stand-in with all 22 columns filled; the locality holds
    delimiters and quotes."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
                                           "l_linestatus", "l_shipdate"])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    # Customers meet the orders first: the lines, by far the most rows, are shuffled once.
    who = (orders.join(customer, orders.o_custkey == customer.c_custkey)
           .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))
    rows = li.join(who, li.l_orderkey == who.o_orderkey)
    line = F.col("l_linenumber").cast("string")
    return rows.select(
        F.to_date("l_shipdate").alias("eventDate"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.dayofmonth("l_shipdate").alias("day"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("countryCode"),
        F.col("n_name").alias("stateProvince"),
        F.concat(F.lit("Site "), F.col("c_custkey").cast("string"), F.lit(', "'), "o_orderstatus", F.lit('"; east')).alias("locality"),
        (F.col("n_nationkey") * 1.5 - 20.25).alias("decimalLatitude"), (-(F.col("c_custkey") % 180) - 0.75).alias("decimalLongitude"),
        F.lit("Animalia").alias("kingdom"), F.when(F.col("l_linenumber") > 1, F.lit("Chordata")).alias("phylum"), F.lit("Aves").alias("class"),
        F.col("o_orderpriority").alias("order"), F.concat("l_returnflag", "l_linestatus").alias("family"),
        F.concat(F.lit("Genus "), line).alias("genus"), F.col("c_mktsegment").alias("species"), F.lit("SPECIES").alias("taxonRank"),
        F.concat("c_mktsegment", F.lit(" "), line).alias("scientificName"),
        F.when(F.col("l_quantity") > 0, F.lit("PRESENT")).alias("occurrenceStatus"),
        F.col("l_quantity").cast("int").alias("individualCount"), F.col("l_partkey").alias("taxonKey"), F.col("l_suppkey").alias("speciesKey"))
