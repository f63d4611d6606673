"""Live bins, requests with their own time, arriving requests, any measures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.dims import STATE_CONFIG, region_dim
from tessera.operators import recent, requests
from tessera.session import scratch_path
from tessera.sources import payloads
from tessera.streaming import live
from tessera.streaming.answers import answer_stream, answers

RAW = "obs_id long, state string, comName string, obsDt string, howMany string"
COLUMNS = ["state", "comName", "lag_1_obs_count", "lag_2_obs_count", "lag_3_obs_count", "rolling_4wk_max_obs_count"]


def reports(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["Georgia", "Florida", "Maine"]), rng.choice("xy"),
             f"2024-{rng.randint(1, 2):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}", rng.choice(["1", "5", "X", None]))
            for i in range(n)]


def batch(spark, rows, as_of):
    unique = list({r[0]: r for r in rows}.values())
    df = recent.recent_activity(recent.prepare_reports(spark.createDataFrame(unique, RAW)), as_of)
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_live_bins_equal_batch_after_every_delivery(spark):
    root = scratch_path(spark, "live-test")
    rows = reports()
    rows.append((9999, "Maine", "x", "garbage", "3"))
    deliveries = [[r for r in rows if r[0] % 3 == k] for k in range(3)]  # each holds early and late reports
    deliveries[2] += deliveries[0][:50]  # and some once more
    seen = []
    for k, part in enumerate(deliveries):
        spark.createDataFrame(part, RAW).write.mode("append").json(f"{root}/landing")
        live.live_bins(spark, f"{root}/landing", f"{root}/serving", f"{root}/checkpoint", state_partitions=3, delay="60 days")
        seen += part
        for as_of in ("2024-02-28 00:00:00", "2024-02-10 05:00:00"):
            got = live.activity_from_bins(live.serving_bins(spark, f"{root}/serving"), as_of).select(*COLUMNS)
            assert sorted(map(tuple, got.collect())) == batch(spark, seen, as_of), (k, as_of)
    assert len(live._folders(spark, f"{root}/serving")) <= 2


def test_upsert_is_repeatable_and_ignores_half_tables(spark):
    serving = scratch_path(spark, "serving")
    start = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([(start, "Maine", "x", 1), (start, "Maine", "y", 2)], live.SERVING_SCHEMA)
    second = spark.createDataFrame([(start, "Maine", "x", 5), (start + dt.timedelta(days=70), "Maine", "x", 7)], live.SERVING_SCHEMA)
    live.upsert(first, 0, serving, "58 DAYS")
    assert live.serving_bins(spark, serving).count() == 2
    for _ in range(2):
        live.upsert(second, 1, serving, "58 DAYS")
        assert [tuple(r)[1:] for r in live.serving_bins(spark, serving).collect()] == [("Maine", "x", 7)]  # the old bins are out of reach
    first.write.parquet(f"{serving}/v=2")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{serving}/v=2/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert live.serving_bins(spark, serving).count() == 1


AS_OFS = ["2024-01-02 00:00:00", "2024-01-20 13:07:30", "2024-02-11 00:00:00", "2024-03-20 23:59:59"]


def test_requests_see_their_own_time(spark):
    rows = reports(900, 3) + [(5000, "Georgia", "x", None, "1"), (5001, "Georgia", "x", "2024-01-20 13:07", "40"), (5002, "Georgia", "x", "2024-01-13 13:07:30", "50")]
    reps = recent.prepare_reports(spark.createDataFrame(rows, RAW))
    asked = [(s, e, a) for s in ("Georgia", "Florida", "Maine") for e in "xyz" for a in AS_OFS] + [("Georgia", "x", AS_OFS[0])]
    req = spark.createDataFrame(asked, "state string, comName string, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))
    got = requests.features_at(req, reps, region_dim(spark)).collect()
    assert len(got) == len(set(asked))
    parsed = [(s, e, dt.datetime.fromisoformat(t), 1 if n in ("X", None) else int(n)) for _, s, e, t, n in rows if t]

    def total(s, e, now, k):
        lo, hi = now - dt.timedelta(days=7 * k), now - dt.timedelta(days=7 * (k - 1))
        return float(sum(n for a, b, t, n in parsed if a == s and b == e and lo <= t < hi))

    for r in got:
        bins = [total(r.state, r.comName, r.as_of, k) for k in range(1, 5)]
        assert [r.lag_1_obs_count, r.lag_2_obs_count, r.lag_3_obs_count] == bins[:3], r
        assert r.rolling_4wk_max_obs_count == max(bins)
        south = STATE_CONFIG[r.state][3]
        assert r.south_corridor_obs_last_7d == sum(total(s, r.comName, r.as_of, 1) for s in south)
        assert r.week_of_year == r.as_of.isocalendar().week


def test_request_plan_has_no_cartesian_product(spark):
    reps = recent.prepare_reports(spark.createDataFrame(reports(50), RAW))
    req = spark.createDataFrame([("Maine", "x", dt.datetime(2024, 1, 9))], "state string, comName string, as_of timestamp_ntz")
    plan = requests.features_at(req, reps, region_dim(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unknown_region_of_a_request_raises(spark):
    reps = recent.prepare_reports(spark.createDataFrame(reports(5), RAW))
    req = spark.createDataFrame([("Delaware", "x", dt.datetime(2024, 1, 9))], "state string, comName string, as_of timestamp_ntz")
    with pytest.raises(Exception, match="Unsupported state: Delaware"):
        requests.corridor_at(req, reps, region_dim(spark)).collect()


def test_pipeline_model_answers_a_stream(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from tessera.operators.score import model_probability

    feats = spark.createDataFrame([(s, e, float(i), float(i % 3)) for i, (s, e) in enumerate((s, e) for s in ("Maine", "Georgia") for e in "wxyz")],
                                  "state string, comName string, a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(labelCol="label")]).fit(
        feats.withColumn("label", (F.col("a") > 3).cast("double")))
    root = scratch_path(spark, "answers-test")
    feats = feats.repartition(2)
    for part in (0, 1):
        spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate((s, e) for s in ("Maine", "Georgia") for e in "wxyz") if i % 2 == part],
                              "request_id long, state string, comName string").write.mode("append").json(f"{root}/in")
        answer_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", feats, lambda df: model_probability(model, df))
    got = answers(spark, f"{root}/out").select("state", "comName", "probability_present", "prediction")
    want = model_probability(model, feats).select(*got.columns)
    assert got.count() == 8 and got.exceptAll(want).isEmpty()


def test_any_measures(spark, tmp_path):
    good = {"stateProvince": "Maine", "daily": {"time": ["2024-01-01", "2024-01-02"], "rain_sum": [1.0, None], "dust": [7, 8]}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(good) + "\n")
    got = sorted(map(str, payloads.read_any_measures(spark, str(path)).collect()))
    want = [("Maine", dt.date(2024, 1, 1), "dust", 7.0), ("Maine", dt.date(2024, 1, 2), "dust", 8.0),
            ("Maine", dt.date(2024, 1, 1), "rain_sum", 1.0), ("Maine", dt.date(2024, 1, 2), "rain_sum", None)]
    assert len(got) == 4
    assert sorted(tuple(r) for r in payloads.read_any_measures(spark, str(path)).fillna(-1.0).collect()) == sorted((a, b, c, -1.0 if d is None else d) for a, b, c, d in want)
    for bad in ({"stateProvince": "Maine", "daily": {"rain_sum": [1.0]}}, {"stateProvince": "Maine", "daily": {"time": ["2024-01-01"], "rain_sum": [1.0, 2.0]}}):
        path.write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="incomplete daily payload of Maine"):
            payloads.read_any_measures(spark, str(path)).collect()
