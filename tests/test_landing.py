"""Sniffed CSV, increments with a ledger, quarantine, tables at rest."""

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import covariates, profile
from tessera.plans import landing
from tessera.schemas import KEEP_COLUMNS, LAGGED_COVARIATES, WEEKLY_COVARIATES
from tessera.sources import landing as source
from tessera.sources import lake, rest, sniff, tables
from tessera.sources.landing import Landing, checked_observations

ROWS = [("a;b", "1", "2.5", "2024-01-02", "true", "x"), ("c,d", "2", "", "2024-01-03", "FALSE", "it's"), ('e "q"', "", "-3e2", "", "true", "y")]
NAMES = ["name", "n", "x", "day", "flag", "note"]


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def quoted(values, sep, quote='"'):
    return sep.join(quote + v.replace(quote, quote * 2) + quote if sep in v or quote in v else v for v in values)


@pytest.mark.parametrize(("sep", "quote"), [(",", '"'), ("\t", '"'), (";", '"'), ("|", '"'), (";", "'")])
def test_dialect(sep, quote):
    lines = [quoted(r, sep, quote) for r in [NAMES, *ROWS]]
    got_sep, got_quote, header, names = sniff.dialect_of(lines)
    assert (got_sep, header, names) == (sep, True, NAMES)
    assert got_quote == quote or quote not in "".join(lines)


def test_dialect_of_odd_files():
    assert sniff.dialect_of([]) == (",", '"', False, [])
    assert sniff.dialect_of(["1,2", "3,4"]) == (",", '"', False, ["column0", "column1"])
    assert sniff.dialect_of(["a,b", "c,d", "e,f"])[2:] == (True, ["a", "b"])
    assert sniff.dialect_of(["x,y", "x,z"])[2] is False
    assert sniff.dialect_of(["one", "2"])[2:] == (True, ["one"])


def test_files_of_several_dialects_meet(spark, tmp_path):
    for i, sep in enumerate([",", "\t", ";"]):
        order = NAMES if i != 1 else NAMES[::-1]
        rows = ROWS if i != 1 else [r[::-1] for r in ROWS]
        write(f"{tmp_path}/raw/f{i}.csv", [quoted(r, sep) for r in [order, *rows]])
    got = sniff.read_csv_sniffed(spark, f"{tmp_path}/raw")
    assert dict(got.dtypes) == {"name": "string", "n": "bigint", "x": "double", "day": "date", "flag": "boolean", "note": "string"}
    assert got.count() == 9 and sorted(r["name"] for r in got.collect()) == sorted([r[0] for r in ROWS] * 3)
    assert got.where("x = -300.0 and n is null and day is null").count() == 3


def test_types_come_from_all_rows(spark):
    rows = [(str(i), "2024-01-01", "1", "7") for i in range(500)] + [("99999999999999999999", "2024-01-01 10:30", "x", "")]
    got = sniff.sniff_types(spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(7))
    assert got == {"a": "double", "b": "timestamp_ntz", "c": "string", "d": "bigint"}
    assert sniff.sniff_types(spark.createDataFrame([(None,), ("",)], "a string")) == {"a": "string"}


def test_types_are_found_in_compiled_methods(spark, monkeypatch):
    rows = spark.range(50).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(22)])
    limits, before, first = [], spark.conf.get(session.METHOD_SETTING), type(rows).first
    monkeypatch.setattr(type(rows), "first", lambda self: (limits.append(int(spark.conf.get(session.METHOD_SETTING))), first(self))[1])
    assert set(sniff.sniff_types(rows).values()) == {"bigint"}
    assert limits == [session.COMPILED_METHOD_BYTES] and spark.conf.get(session.METHOD_SETTING) == before


def test_kinds_held_of_odd_values(spark):
    held = {"1": {"bigint", "double"}, "12345678901234567890": {"double"}, "+.5e+3": {"double"}, "1e": set(), "--1": set(), "/": set(),
            "2024-02-29": {"date", "timestamp_ntz"}, "2024-02-30": set(), "2024-01-01T10:30": {"timestamp_ntz"},
            "2024-01-01 25:00": set(), "tRue": {"boolean"}, "trues": set(), "\u0663": set(), "NaN": set(), "\t5": set()}
    rows = spark.createDataFrame([(v,) for v in held], "v string").select("v", sniff.kinds_held(F.col("v")).alias("m")).collect()
    assert {r["v"]: {k for i, k in enumerate(sniff.LATTICE) if r["m"] >> i & 1} for r in rows} == held
    assert spark.range(1).select(sniff.kinds_held(F.lit(None).cast("string"))).first()[0] is None


def test_column_profile_repeats_no_rows(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, "a", None), (2, None, None)], "x int, `y z` string, w double")
    got = profile.column_profile(rows, rows.columns)
    assert "Expand" not in plan_of(got)
    assert [tuple(r) for r in got.orderBy("column_name").collect()] == [
        ("w", "double", 0, 0, None, None), ("x", "int", 3, 2, "1", "2"), ("y z", "string", 2, 2, "a", "b")]
    assert "Expand" not in plan_of(landing.lake_columns(spark, "/root/testdata/sf0.001"))


# ---- increments ----


def observation_line(date, year, month, species="s", count="1"):
    values = {"eventDate": date, "year": str(year), "month": str(month), "species": species, "individualCount": count}
    return ",".join(values.get(c, "") for c in KEEP_COLUMNS)


HEADER = ",".join(KEEP_COLUMNS)


def test_second_run_rewrites_only_touched_folders(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", str(tmp_path)
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1), observation_line("2020-02-05", 2020, 2)])
    landing = Landing(spark, raw, root)
    first = landing.run()
    assert (first.files, first.rows, first.folders) == (1, 2, [(2020, 1), (2020, 2)])
    before = {d: sorted(os.listdir(f"{root}/lake/year=2020/{d}")) for d in ("month=1", "month=2")}
    assert landing.run().files == 0
    write(f"{raw}/b.csv", [HEADER, observation_line("2020-02-07", 2020, 2, "t")])
    second = landing.run()
    assert (second.files, second.rows, second.folders) == (1, 1, [(2020, 2)])
    assert sorted(os.listdir(f"{root}/lake/year=2020/month=1")) == before["month=1"]
    assert sorted(os.listdir(f"{root}/lake/year=2020/month=2")) != before["month=2"]
    assert sorted((r["month"], r["species"]) for r in landing.rows().collect()) == [(1, "s"), (2, "s"), (2, "t")]
    assert landing.run().folders == []


def test_replaced_file_replaces_its_rows(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", str(tmp_path)
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1), observation_line("bad", 2020, 1)])
    write(f"{raw}/b.csv", [HEADER, observation_line("2020-03-05", 2020, 3)])
    landing = Landing(spark, raw, root)
    assert landing.run().rejected == 1
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-02-05", 2020, 2, "moved")])
    os.utime(f"{raw}/a.csv", (2_000_000_000, 2_000_000_000))
    done = landing.run()
    assert done.files == 1 and done.folders == [(2020, 1), (2020, 2)]
    assert sorted((r["month"], r["species"]) for r in landing.rows().collect()) == [(2, "moved"), (3, "s")]
    assert landing.rejects().count() == 0


def test_run_cut_short_is_repeated(spark, tmp_path):
    """The lake was written, the ledger was not."""
    raw, root = f"{tmp_path}/raw", str(tmp_path)
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1)])
    Landing(spark, raw, root).run()
    again = Landing(spark, raw, root)
    again.ledger = f"{root}/lost-ledger"
    assert again.run().files == 1
    assert again.rows().count() == 1


def test_quarantine_keeps_line_and_reason(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", str(tmp_path)
    good, bad = observation_line("2020-01-05", 2020, 1), observation_line("2020-01-05", 2020, 1, count="many")
    write(f"{raw}/a.csv", [HEADER, good, bad, "only,three,fields", observation_line("", 2020, 1)])
    landing = Landing(spark, raw, root)
    done = landing.run()
    assert (done.rows, done.rejected, done.without_date) == (4, 2, 1)
    assert landing.rows().count() == 1
    rejects = {r["reason"]: r["line"] for r in landing.rejects().collect()}
    assert rejects == {"bad value in column individualCount": bad, "wrong number of fields": "only,three,fields"}


def test_only_bad_records_carry_their_line(spark, tmp_path):
    """Values as before: blanks are NULL, spaces go, dates may carry a time, integers a point."""
    good = dict(zip(KEEP_COLUMNS, [""] * len(KEEP_COLUMNS), strict=True)) | {
        "eventDate": "2020-01-05 10:00", "year": " 2020", "month": "1.0", "species": " s ", "genus": "  ", "taxonKey": "+7"}
    bad = good | {"decimalLatitude": "north", "taxonKey": "7x"}
    write(f"{tmp_path}/a.csv", [HEADER, ",".join(good.values()), ",".join(bad.values())])
    a, b = checked_observations(spark, f"{tmp_path}/a.csv").orderBy(F.col("reason").asc_nulls_first()).collect()
    assert (a["line"], a["reason"], str(a["eventDate"]), a["year"], a["month"], a["species"], a["genus"], a["taxonKey"]) == (
        None, None, "2020-01-05", 2020, 1, "s", None, 7)
    assert (b["line"], b["reason"]) == (",".join(bad.values()), "bad value in column decimalLatitude")


def test_first_delivery_is_stored_once(spark, tmp_path, monkeypatch):
    """Rows are written again before the lake only if some of them come from the lake; the checks run in compiled methods."""
    names = []

    def noted(df, name):
        names.append((name, int(spark.conf.get(session.METHOD_SETTING))))
        return session.materialize(df, name)

    monkeypatch.setattr(source, "materialize", noted)
    write(f"{tmp_path}/raw/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1)])
    one = Landing(spark, f"{tmp_path}/raw", str(tmp_path))
    one.run()
    assert "landing-folders" not in dict(names) and dict(names)["landing"] == session.COMPILED_METHOD_BYTES
    write(f"{tmp_path}/raw/b.csv", [HEADER, observation_line("2020-01-06", 2020, 1)])
    one.run()
    assert "landing-folders" in dict(names) and one.rows().count() == 2


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_run_leaves_only_its_own_tables(spark, tmp_path):
    """Neither stored steps nor shuffle files stay on disk until the driver happens to collect its garbage."""
    raw, root, scratch = f"{tmp_path}/raw", str(tmp_path), session.ensure_checkpoint_dir(spark).removeprefix("file:")
    write(f"{raw}/a.csv", [HEADER, *[observation_line(f"2020-{m:02}-05", 2020, m) for m in range(1, 13)]])
    settings = {k: spark.conf.get(k) for k in [*session.SPARE_DISK, session.METHOD_SETTING, "spark.sql.files.maxPartitionBytes"]}
    tables, shuffles = set(os.listdir(scratch)), shuffle_files(spark)
    Landing(spark, raw, root).run()
    write(f"{raw}/b.csv", [HEADER, observation_line("2020-01-07", 2020, 1)])
    Landing(spark, raw, root).run()
    assert set(os.listdir(scratch)) <= tables
    until = time.time() + 20  # they go in the background
    while shuffle_files(spark) - shuffles and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - shuffles
    assert settings == {k: spark.conf.get(k) for k in settings}
    assert Landing(spark, raw, root).rows().count() == 13


def test_tables_outside_the_block_stay(spark):
    kept = session.materialize(spark.range(3), "kept")
    with session.spare_disk(spark):
        with session.spare_disk(spark):
            inner = session.materialize(spark.range(4), "inner").inputFiles()
        outer = session.materialize(spark.range(5), "outer")
        assert outer.count() == 5 and not any(os.path.exists(f.removeprefix("file://")) for f in inner)
        files = outer.inputFiles()
    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_folders_are_written_in_batches(spark, tmp_path, monkeypatch):
    """The shuffle into the lake moves a bounded number of rows; each folder is written once a run, those without rows go."""
    monkeypatch.setattr(source, "BATCH_ROWS", 2)
    written, write_rows = [], Landing._write
    monkeypatch.setattr(Landing, "_write", lambda self, rows: (written.append(
        sorted(map(tuple, rows.select("year", "month").collect()), key=str)), write_rows(self, rows))[1])
    raw, root = f"{tmp_path}/raw", str(tmp_path)
    write(f"{raw}/a.csv", [HEADER, *[observation_line("2020-01-05", 2020, m) for m in (1, 1, 1, 2, 3, "")], observation_line("2019-04-05", "", 4)])
    write(f"{raw}/b.csv", [HEADER, observation_line("2021-05-05", 2021, 5)])
    landing = Landing(spark, raw, root)
    folders = {(None, 4), (2020, None), (2020, 1), (2020, 2), (2020, 3), (2021, 5)}
    assert set(landing.run().folders) == folders
    assert written == [[(2020, None), (None, 4)], [(2020, 1)] * 3, [(2020, 2), (2020, 3)], [(2021, 5)]]
    written.clear()
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-02-05", 2020, 2, "moved")])
    os.utime(f"{raw}/a.csv", (2_000_000_000, 2_000_000_000))
    write(f"{raw}/c.csv", [HEADER, observation_line("2021-05-06", 2021, 5, "new")])
    assert set(landing.run().folders) == folders and sum(written, []) == [(2020, 2), (2021, 5), (2021, 5)]
    assert sorted((r["year"], r["month"], r["species"]) for r in landing.rows().collect()) == [(2020, 2, "moved"), (2021, 5, "new"), (2021, 5, "s")]
    assert sorted(d for d in os.listdir(f"{root}/lake/year=2020") if d.startswith("month")) == ["month=2"]


def test_compressed_files_are_taken_in(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    write(f"{raw}/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1)])
    with gzip.open(f"{raw}/b.csv.gz", "wt") as f:
        f.write("\n".join([HEADER, observation_line("2020-01-06", 2020, 1, "t"), observation_line("bad", 2020, 1)]) + "\n")
    landing = Landing(spark, raw, str(tmp_path))
    done = landing.run()
    assert (done.files, done.rows, done.rejected) == (2, 3, 1) and landing.run().files == 0
    assert sorted(r["species"] for r in landing.rows().collect()) == ["s", "t"]
    usual = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    assert source._packing(spark, ["a.csv"]) == {} and source._packing(spark, ["a.csv", "b.csv.gz"]) == {
        "spark.sql.files.maxPartitionBytes": str(usual // source.COMPRESSION)}


def test_deliveries_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-05", 2020, 'a, "b"')], "eventDate string, year int, locality string")
    landing._deliver(rows, f"{tmp_path}/raw")
    assert {f.split(".", 1)[1] for f in os.listdir(f"{tmp_path}/raw") if f.startswith("part")} == {"csv.gz"}
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/raw", header=True, quote='"', escape='"').collect()] == [("2020-01-05", "2020", 'a, "b"')]


def test_lines_are_shuffled_once(spark):
    """Customers join the orders, not the lines."""
    plan = tables.full_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan[:plan.index("Relation [l_orderkey")].count("Join Inner") == 1 and plan.count("Join Inner") == 3


def test_quarantine_is_stored_once(spark, tmp_path, monkeypatch):
    """Bad records are written again before the quarantine only if some of them come from it; they are kept then."""
    names = []
    monkeypatch.setattr(source, "materialize", lambda df, name: (names.append(name), session.materialize(df, name))[1])
    write(f"{tmp_path}/raw/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1), observation_line("bad", 2020, 1)])
    landing = Landing(spark, f"{tmp_path}/raw", str(tmp_path))
    assert landing.run().rejected == 1 and "quarantine" not in names and landing.rejects().count() == 1
    write(f"{tmp_path}/raw/b.csv", [HEADER, observation_line("2020-01-06", 2020, 1, count="many")])
    assert landing.run().rejected == 1 and "quarantine" in names
    assert sorted(r["reason"] for r in landing.rejects().collect()) == ["bad value in column eventDate", "bad value in column individualCount"]


def test_queries_deliver_compressed_files(spark, monkeypatch):
    modes, deliver = [], landing._deliver
    monkeypatch.setattr(landing, "_deliver", lambda *a, **k: (modes.append(k.get("mode", "overwrite")), deliver(*a, **k))[1])
    n = {r["reason"]: r["n"] for r in landing.quarantine_reasons(spark, "/root/testdata/sf0.001").collect()}
    assert modes == ["overwrite"] and n["all records"] == n["all rejected"] + n["in the lake"] > n["in the lake"]
    assert n["all rejected"] == sum(v for k, v in n.items() if k.startswith("bad value"))


def test_lake_is_built_in_compiled_methods(spark, tmp_path, monkeypatch):
    limits, write_lake = [], lake.write_lake
    monkeypatch.setattr(lake, "write_lake", lambda *a: (limits.append(int(spark.conf.get(session.METHOD_SETTING))), write_lake(*a))[1])
    write(f"{tmp_path}/a.csv", [HEADER, observation_line("2020-01-05", 2020, 1, count=" 3.0 ")])
    assert lake.build_lake(spark, f"{tmp_path}/a.csv", f"{tmp_path}/lake").first()["individualCount"] == 3
    assert limits == [session.COMPILED_METHOD_BYTES]


# ---- tables at rest ----


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_table_reads_fewer_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.concat(F.lit("s"), F.lpad((F.col("id") * 7919 % 50).cast("string"), 2, "0")).alias("species"),
        (F.col("id") % 40).cast("string").alias("stateProvince"), (F.col("id") % 9 + 2010).cast("int").alias("year"),
        (F.col("id") % 52).cast("int").alias("week_of_year"), F.rand(1).alias("payload"))
    rest.write_range_table(rows, f"{tmp_path}/ranged", files=4, row_group_bytes=64 * 1024)
    import pyarrow.parquet as pq
    hit = total = 0
    for name in sorted(f for f in os.listdir(f"{tmp_path}/ranged") if f.endswith(".parquet")):
        meta = pq.ParquetFile(f"{tmp_path}/ranged/{name}").metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            total += 1
            hit += s.min <= "s07" <= s.max
    assert total >= 8 and hit <= total // 4
    back = spark.read.parquet(f"{tmp_path}/ranged").where("species = 's07'")
    assert "EqualTo(species,s07)" in plan_of(back) and back.count() == rows.where("species = 's07'").count()


def test_merge_at_rest_moves_nothing(spark):
    panel = spark.range(300).select(F.lit("a").alias("species"), (F.col("id") % 10).cast("string").alias("stateProvince"),
                                    F.lit(2020).alias("year"), (F.col("id") % 30).cast("int").alias("week_of_year"))
    weekly = spark.range(200).select((F.col("id") % 10).cast("string").alias("stateProvince"), F.lit(2020).alias("year"),
                                     F.floor(F.col("id") / 10).cast("int").alias("week_of_year"),
                                     *[F.col("id").cast("double").alias(c) for c in WEEKLY_COVARIATES + LAGGED_COVARIATES])
    merged = rest.merge_at_rest(*rest.covariates_at_rest(panel, weekly, buckets=4))
    plan = plan_of(merged)
    assert "Exchange" not in plan and "Broadcast" not in plan and "SortMergeJoin" in plan
    plain = covariates.merge_covariates(panel, weekly)
    assert merged.select(*plain.columns).exceptAll(plain).isEmpty() and merged.count() == plain.count() == 300


def test_covariates_see_what_has_landed_since(spark, tmp_path):
    panel = spark.createDataFrame([("a", "S", 2020, 1), ("a", "S", 2020, 2)], "species string, stateProvince string, year int, week_of_year int")
    path = f"{tmp_path}/weekly"

    def land(week, value):
        row = ("S", 2020, week, *[value] * 14)
        schema = "stateProvince string, year int, week_of_year int, " + ", ".join(f"{c} double" for c in WEEKLY_COVARIATES + LAGGED_COVARIATES)
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)

    def total():
        merged = covariates.merge_covariates(panel, spark.read.parquet(path))
        return merged.agg(F.sum("temp_mean_7d")).first()[0]

    land(1, 3.0)
    assert total() == 3.0
    land(2, 300.0)
    assert total() == 303.0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_footer_counts_read_no_data(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3 + 2020).cast("int").alias("year"), (F.col("id") % 2 + 1).cast("int").alias("month"), "id")
    lake.write_lake(rows, f"{tmp_path}/lake")
    got = rest.footer_profile(spark, f"{tmp_path}/lake")
    assert "PushedAggregation: [COUNT(*)]" in plan_of(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.groupBy("year", "month").count().collect()))
