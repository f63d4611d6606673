import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import counts, rules
from tessera.functions.calendar import calendar_year, iso_week


# What each reported count must become.  A blank, an X and anything that is no
# number count as one report; decimals lose their fraction.
COUNTS = {
    None: 1, "": 1, " x ": 1, "X": 1, "abc": 1, "5d": 1, "5f": 1, "nan": 1, "inf": 1, "infinity": 1, "0x10": 1,
    "1__0": 1, "_1": 1,
    "5": 5, " 7 ": 7, "+4": 4, "-3": -3, " \t9\n": 9, "1_000": 1000,
    "2.7": 2, "-2.7": -2, ".5": 0, "5.": 5, "1e3": 1000, "1E2": 100,
}


def test_normalize_count_edges(spark):
    df = spark.createDataFrame([(v,) for v in COUNTS], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", counts.normalize_count("v").alias("n")).collect()}
    assert got == COUNTS


def test_normalize_count_numeric_input(spark):
    df = spark.createDataFrame([(2.9,), (-1.5,), (None,), (7.0,)], "v double")
    assert [r[0] for r in df.select(counts.normalize_count("v")).collect()] == [2, -1, 1, 7]


def test_lenient_timestamp(spark):
    df = spark.createDataFrame([("2024-01-05 14:30",), ("bad",), ("2024-01-05",), (None,),
                                ("2024-01-05T14:30:00+05:00",)], "v string")
    got = [r[0] for r in df.select(counts.lenient_timestamp("v")).collect()]
    assert got[0] == dt.datetime(2024, 1, 5, 14, 30)
    assert got[1] is None and got[3] is None
    assert got[2] == dt.datetime(2024, 1, 5)
    assert got[4] == dt.datetime(2024, 1, 5, 14, 30)


def test_iso_week_matches_python_every_day(spark):
    start, end = dt.date(1990, 1, 1), dt.date(2030, 12, 31)
    df = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"))
    got = {r["d"]: (r["y"], r["w"]) for r in df.select("d", calendar_year("d").alias("y"), iso_week("d").alias("w")).collect()}
    assert len(got) == (end - start).days + 1
    for d, (y, w) in got.items():
        assert y == d.year and w == d.isocalendar()[1]


def test_calendar_year_iso_week_quirk(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2018, 12, 31),), (dt.date(2016, 3, 1),)], "d date")
    got = [(r[0], r[1]) for r in df.select(calendar_year("d"), iso_week("d")).collect()]
    assert got == [(2017, 52), (2018, 1), (2016, 9)]


@pytest.mark.parametrize("p,band", [(0.0, "Low likelihood"), (0.2999, "Low likelihood"), (0.30, "Emerging signal"),
                                    (0.5999, "Emerging signal"), (0.60, "Likely present"), (0.7999, "Likely present"),
                                    (0.80, "Strong presence signal"), (1.0, "Strong presence signal")])
def test_bands(spark, p, band):
    assert spark.range(1).select(rules.interpret_probability(F.lit(p))).first()[0] == band


def test_arrival_and_northern_rules(spark):
    rows = [
        (0.55, 0.0, 0.0, "Likely present now"),
        (0.45, 0.0, 0.0, "Likely within 1–2 weeks"),
        (0.35, 1.0, 0.0, "Possible arrival within 2–3 weeks"),
        (0.35, 0.0, 2.0, "Possible arrival within 2–3 weeks"),
        (0.35, 0.0, 0.0, "No strong arrival signal yet"),
        (0.10, 3.0, 0.0, "Possible arrival within 3–4 weeks"),
        (0.10, 0.0, 9.0, "No strong arrival signal yet"),
    ]
    df = spark.createDataFrame(rows, "p double, corr double, loc double, want string")
    out = df.select(rules.arrival_window("p", "corr", "loc").alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)
    df = spark.createDataFrame([("Maine", 0.85, 4.0), ("Maine", 0.85, 5.0), ("Massachusetts", 0.9, 0.0),
                                ("Vermont", 0.79, 0.0)], "s string, p double, loc double")
    out = df.select(rules.adjusted_interpretation("s", "p", "loc").alias("a"),
                    rules.migration_warning("s", "p", "loc").alias("w")).collect()
    assert [r.a for r in out] == ["Emerging signal", None, None, None]
    assert out[0].w.startswith("Caution") and out[1].w is None


def test_unit_conversions(spark):
    r = spark.range(1).select(rules.c_to_f(F.lit(100.0)), rules.mm_to_in(F.lit(25.4)), rules.kmh_to_mph(F.lit(10.0))).first()
    assert r[0] == 212.0 and r[1] == 1.0 and abs(r[2] - 6.21371) < 1e-12


def test_display_text(spark):
    r = spark.range(1).select(rules.percent_text(F.lit(0.4567)), rules.fixed_text(F.lit(12345.678), 0)).first()
    assert r[0] == "45.7%" and r[1] == "12,346"


def test_normalize_count_random_strings(spark):
    """Property: strings that are numbers by this grammar count as their whole
    part if that fits 64 bits; all others count as one report."""
    import re
    from decimal import Decimal

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    digits = r"\d+(?:_\d+)*"
    alphabet = st.sampled_from(list("0123456789._eE+- xXdfn\t"))
    texts = st.lists(st.text(alphabet, min_size=0, max_size=8), min_size=200, max_size=200)

    @settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(texts)
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = [r[0] for r in df.select(counts.normalize_count("v")).collect()]
        for v, n in zip(values, got, strict=True):
            number = re.fullmatch(rf"[+-]?({digits}\.?({digits})?|\.{digits})([eE][+-]?{digits})?", v.strip())
            whole = int(Decimal(v.strip().replace("_", ""))) if number else 1
            assert n == (whole if abs(whole) < 2**63 else 1), v

    check()
