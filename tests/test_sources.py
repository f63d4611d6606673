import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import panel
from tessera.schemas import KEEP_COLUMNS
from tessera.session import ensure_checkpoint_dir
from tessera.sources import lake, payloads


def _root(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex[:8]}"


def test_csv_to_lake_roundtrip_and_pruning(spark):
    rows = [("a", "R1", dt.date(2020, m, 3), 2020, m, 3) for m in (2, 3, 4, 7)] + [("b", "R2", None, 2020, 3, 1)]
    obs = spark.createDataFrame(rows, "species string, stateProvince string, eventDate date, year int, month int, day int")
    root = _root(spark)
    lake.land_csv(lake.as_observation_rows(obs), f"{root}/raw")
    back = lake.build_lake(spark, f"{root}/raw", f"{root}/lake")
    assert back.count() == 4  # NULL date dropped
    assert set(back.columns) == set(KEEP_COLUMNS)
    q = back.where(F.col("month").isin(3, 4))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    part = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")]
    assert part and "month" in part[0], plan
    assert q.count() == 2
    # re-running the write replaces the same partitions (idempotent)
    lake.write_lake(lake.project_observations(lake.read_observations_csv(spark, f"{root}/raw")), f"{root}/lake")
    assert lake.read_lake(spark, f"{root}/lake").count() == 4
    c = panel.weekly_counts(lake.read_lake(spark, f"{root}/lake"), months=[3, 4])
    assert c.count() == 2


def test_payload_parse_and_missing_field(spark):
    payload = spark.createDataFrame(
        [("S", {"time": ["2024-01-01", "2024-01-02"], **{m: [1.0, None] for m in payloads.DAILY_VARS}})],
        payloads.daily_payload_schema(payloads.DAILY_VARS))
    rows = payloads.parse_daily_payload(payload).orderBy("date").collect()
    assert [r.date for r in rows] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert rows[1].rain_sum is None and rows[0].week_of_year == 1
    bad = spark.createDataFrame([("S", {"time": ["2024-01-01"]})],
                                "stateProvince string, daily struct<time:array<string>>")
    with pytest.raises(ValueError, match="Missing expected columns"):
        payloads.parse_daily_payload(bad)


def _land(spark, name, *lines):
    path = f"{_root(spark)}/{name}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


GOOD = '{"stateProvince": "S", "daily": {"time": ["2024-01-01"], ' + ", ".join(f'"{m}": [1.0]' for m in payloads.DAILY_VARS) + "}}"


@pytest.mark.parametrize("bad", [
    '{"stateProvince": "T"}',
    GOOD.replace(f'"{payloads.DAILY_VARS[0]}": [1.0], ', ""),
    GOOD.replace('["2024-01-01"]', '["2024-01-01", "2024-01-02"]'),
    GOOD.replace('"time": ["2024-01-01"], ', ""),
    '{"stateProvince": "T", "daily": ',
])
def test_incomplete_landed_payload_raises(spark, bad):
    assert payloads.parse_daily_payload(payloads.read_daily_payload(spark, _land(spark, "ok", GOOD))).count() == 1
    with pytest.raises(Exception, match="(?i)incomplete daily payload|malformed"):
        payloads.parse_daily_payload(payloads.read_daily_payload(spark, _land(spark, "bad", GOOD, bad))).collect()


def test_corrupt_report_raises(spark):
    path = _land(spark, "reports", '{"obs_id": 1, "obsDt": "2024-01-01 10:00"}', '{"obs_id": 2, ')
    with pytest.raises(Exception, match="(?i)malformed"):
        payloads.read_reports_json(spark, path).collect()


def _csv_line(**values):
    return ",".join(values.get(c, "") for c in KEEP_COLUMNS)


def test_csv_quotes_dates_and_numbers(spark):
    path = _land(spark, "csv", ",".join(KEEP_COLUMNS),
                 _csv_line(eventDate="2020-03-02T10:15:00", locality='"Smith ""Old"" Pond, north"', species="a", individualCount="3.0",
                           order="Passeriformes", **{"class": "Aves"}),
                 _csv_line(eventDate="2020-03-03 10:15:00", species="b", taxonKey="9007199254740993"),
                 _csv_line(eventDate="2020-03-04", decimalLatitude="1.5"))
    got = lake.read_observations_csv(spark, path).orderBy("eventDate").collect()
    assert [r.eventDate for r in got] == [dt.date(2020, 3, d) for d in (2, 3, 4)]
    assert (got[0].locality, got[0].species, got[0].individualCount) == ('Smith "Old" Pond, north', "a", 3)
    assert (got[0]["class"], got[0]["order"], got[1].taxonKey, got[2].decimalLatitude) == ("Aves", "Passeriformes", 2**53 + 1, 1.5)


@pytest.mark.parametrize("line", [_csv_line(eventDate="03/04/2020"), _csv_line(eventDate="2020-03-02", year="x"), "2020-03-02,2020"])
def test_bad_csv_raises(spark, line):
    path = _land(spark, "csv", ",".join(KEEP_COLUMNS), line)
    with pytest.raises(Exception, match="(?i)bad value|malformed"):
        lake.read_observations_csv(spark, path).collect()


def test_pack_and_parse_roundtrip(spark):
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), *[float(i)] * 7) for i in range(40)]
    daily = spark.createDataFrame(rows, "stateProvince string, date date, " +
                                  ", ".join(f"{m} double" for m in payloads.DAILY_VARS))
    packed = payloads.pack_daily_payload(daily)
    assert packed.count() == 2  # January and February payloads
    back = payloads.parse_daily_payload(packed).select("stateProvince", "date", *payloads.DAILY_VARS)
    assert back.exceptAll(daily).isEmpty() and daily.exceptAll(back).isEmpty()


def test_declared_table_schemas_equal_inferred(spark):
    from pyspark.sql.types import _parse_datatype_string

    from tessera.sources.tables import TABLE_SCHEMAS
    for name, ddl in TABLE_SCHEMAS.items():
        inferred = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in inferred] == \
               [(f.name, f.dataType) for f in _parse_datatype_string(ddl).fields], name


def test_preview_and_schema_rows(spark):
    from tessera.operators import profile
    from tessera.sources import tables
    obs = tables.observations(spark, "/root/testdata/sf0.001")
    assert len(profile.preview(obs).collect()) == 5
    rows = {r.column_name: (r.column_type, r.nullable) for r in profile.describe_schema(obs).collect()}
    assert rows["eventDate"][0] == "date" and rows["year"][0] == "int" and rows["species"][0] == "string"


def test_write_panel_and_table_roundtrip(spark):
    from tessera.operators import panel as P
    from tessera.plans import fixture as fx
    p = fx.fixture_panel(spark, "/root/testdata/sf0.001")
    root = _root(spark)
    P.write_panel(p, f"{root}/panel")
    back = spark.read.parquet(f"{root}/panel")
    assert back.count() == p.count() and back.exceptAll(p.select(*back.columns)).isEmpty()
    lake.write_table(back.select("species", "obs_count"), f"{root}/t", sort_cols=["species"])
    assert spark.read.parquet(f"{root}/t").count() == p.count()
