"""ST1: the stream over landed files equals the batch bins, including
re-delivered and late reports."""

import uuid

from tessera.session import ensure_checkpoint_dir
from tessera.streaming import activity

RAW = "obs_id long, state string, comName string, obsDt string, howMany string"


def test_stream_equals_batch_with_repeats(spark):
    rows = []
    for i in range(200):
        day = 1 + (i % 27)
        rows.append((i, "Georgia" if i % 3 else "Florida", "x" if i % 2 else "y",
                     f"2024-01-{day:02d} {i % 24:02d}:15", str(i % 5)))
    rows.append((999, "Georgia", "x", "garbage", "3"))
    df = spark.createDataFrame(rows, RAW)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex[:8]}"
    # two deliveries overlapping on 10-20 Jan: those reports arrive twice
    for part in activity.deliveries(df, "2024-01-20 00:00:00", "2024-01-10 00:00:00"):
        part.write.mode("append").json(f"{root}/landing")
    activity.activity_bins_stream(spark, f"{root}/landing", f"{root}/sink", f"{root}/ckpt", state_partitions=4, delay="1 day",
                                  anchor="2024-01-01")
    got = spark.read.parquet(f"{root}/sink")
    max_ts = "2024-01-27 23:15:00"
    want = activity.activity_bins_batch(df, closed_before="2024-01-26 23:15:00")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).isEmpty()
    # bins end on or before the watermark: max event time minus the delay
    assert got.agg({"bin_end": "max"}).first()[0].isoformat(" ") <= max_ts


def test_two_runs_equal_batch(spark):
    """Land, run, land, run: the second delivery repeats ten days of reports,
    some of them behind the watermark, and changes no count."""
    rows = [(i, "Georgia", "x", f"2024-01-{1 + i % 27:02d} {i % 24:02d}:15", str(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, RAW)
    got = activity.run_fixture_stream(spark, df, "1 day", "2024-01-01", "2024-01-20 00:00:00",
                                      "2024-01-10 00:00:00", state_partitions=4)
    want = activity.activity_bins_batch(df, closed_before="2024-01-26 23:15:00").select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_window_offset():
    assert activity.window_offset("2024-01-01") == "4 days"
    assert activity.window_offset("1970-01-01") == "0 days"


def test_report_after_emitted_bin_is_not_counted(spark):
    """A second delivery that arrives after the watermark has closed a bin
    does not change the emitted bin (append mode: emitted bins are final)."""
    first = [(1, "Georgia", "x", "2024-01-02 10:00", "2"), (2, "Georgia", "x", "2024-01-20 10:00", "1")]
    late = [(3, "Georgia", "x", "2024-01-03 10:00", "5")]
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame(first, RAW).write.json(f"{root}/landing")
    activity.activity_bins_stream(spark, f"{root}/landing", f"{root}/sink", f"{root}/ckpt", state_partitions=4, delay="1 day",
                                  anchor="2024-01-01")
    spark.createDataFrame(late, RAW).write.mode("append").json(f"{root}/landing")
    activity.activity_bins_stream(spark, f"{root}/landing", f"{root}/sink", f"{root}/ckpt", state_partitions=4, delay="1 day",
                                  anchor="2024-01-01")
    rows = {(r.bin_start.day, r.obs_count) for r in spark.read.parquet(f"{root}/sink").collect()}
    assert (1, 2) in rows and not any(d == 1 and n != 2 for d, n in rows)


def test_bounded_micro_batches_give_same_bins(spark):
    rows = [(i, "Georgia", "x", f"2024-01-{1 + i % 20:02d} 08:00", "1") for i in range(60)]
    df = spark.createDataFrame(rows, RAW).repartition(6)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex[:8]}"
    df.orderBy("obsDt").coalesce(1).write.json(f"{root}/landing")
    activity.activity_bins_stream(spark, f"{root}/landing", f"{root}/sink", f"{root}/ckpt", state_partitions=4, delay="1 day",
                                  anchor="2024-01-01", max_files_per_trigger=1)
    cols = ["bin_start", "bin_end", "state", "comName", "obs_count"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/sink").select(*cols).collect())
    want = sorted(tuple(r) for r in activity.activity_bins_batch(df, closed_before="2024-01-19 08:00:00")
                  .select(*cols).collect())
    assert got == want and len(got) > 0
