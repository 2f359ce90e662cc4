import datetime as dt

import pytest
from pyspark.sql import functions as F

from headwater.constants import ALIASES, CATCHMENT_RADIUS_KM, REGISTRY
from headwater.functions import clean, geo, numeric, risk
from headwater.functions.registry import feature_map
from headwater import schemas

NAN = float("nan")


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_aliases_collapse_spelling(spark):
    names = ["Magat Dam", " magat ", "MAGAT", "la  mesa\n dam", "Elsewhere  Lake"]
    got = column(spark, names, "string", lambda c: clean.canonical(c, ALIASES))
    assert got == ["Magat", "Magat", "Magat", "La Mesa", "Elsewhere Lake"]


def test_numbers_and_markers(spark):
    texts = ["1,234.50", " 7 ", "-", "--", "N/A", "n/a", "", "-51.87", "n.d.", None, "NaN"]
    assert column(spark, texts, "string", clean.number) == [1234.5, 7.0, None, None, None, None, None, -51.87, None, None, None]


@pytest.mark.parametrize("text, seen, want", [
    ("Aug-07", "2026-08-07 13:40:00", dt.date(2026, 8, 7)),
    ("Dec-31", "2027-01-01 08:00:00", dt.date(2026, 12, 31)),
    ("Jan-02", "2027-01-01 08:00:00", dt.date(2027, 1, 2)),
    ("Jan-03", "2027-01-01 08:00:00", dt.date(2026, 1, 3)),
    ("Feb-29", "2027-03-01 08:00:00", None),
    ("noise", "2027-03-01 08:00:00", None),
])
def test_year_of_a_month_and_day(spark, text, seen, want):
    df = spark.createDataFrame([(text, seen)], "t string, s string")
    day = clean.month_day_to_date(F.col("t"), F.col("s").cast("timestamp_ntz"))
    assert df.select(day).first()[0] == want


def test_clock_or_midnight(spark):
    df = spark.createDataFrame([("08:00 am",), ("8:30 PM",), ("noon",), (None,)], "t string")
    got = [r[0] for r in df.select(clean.at_clock(F.lit("2026-08-07").cast("date"), F.col("t"))).collect()]
    assert got == [dt.datetime(2026, 8, 7, 8, 0), dt.datetime(2026, 8, 7, 20, 30), dt.datetime(2026, 8, 7), dt.datetime(2026, 8, 7)]


def test_quiet_status_contains_the_alert_text(spark):
    assert column(spark, ["Flood Watch", " Non-Flood Watch", "NON-flood watch"], "string", clean.is_alert) == [True, False, False]
    assert column(spark, ["Angat Sub-basin", "Agno"], "string", clean.alert_kind) == ["dam_sub_basin", "river_basin"]


def test_zero_reference_blanks_its_deviation(spark):
    rows = [(0.0, 286.8), (210.0, -51.9), (None, 3.0)]
    df = spark.createDataFrame(rows, "ref double, dev double")
    got = [tuple(r) for r in clean.blank_undefined_reference(df, {"ref": "dev"}).collect()]
    assert got == [(None, None), (210.0, -51.9), (None, None)]


def test_nan_becomes_null_also_in_arrays(spark):
    df = spark.createDataFrame([(NAN, [1.0, NAN])], "v double, a array<double>")
    assert tuple(clean.nan_free(df).first()) == (None, [1.0, None])


@pytest.mark.parametrize("levels, high, rule, want", [
    ([158.0, 159.0], 210.0, 180.79, "Normal"),
    ([181.0, 182.0], 210.0, 180.79, "Watch"),
    ([209.0, 211.0], 210.0, 180.79, "Spill Watch"),
    ([286.8], NAN, NAN, "Not rated"),
    ([79.4], 80.15, NAN, "Normal"),
    ([80.2], 80.15, None, "Spill Watch"),
    ([], 80.15, 70.0, "Not rated"),
    ([NAN, None], 80.15, 70.0, "Not rated"),
])
def test_risk_classes(spark, levels, high, rule, want):
    df = spark.createDataFrame([(levels, high, rule)], "l array<double>, h double, r double")
    label = risk.risk_of_levels(F.col("l"), F.col("h"), F.col("r"))
    assert df.select(label).first()[0] == want
    assert df.select(risk.risk_note(label)).first()[0]


def test_guards(spark):
    assert column(spark, [1.5, NAN, float("inf"), float("-inf"), None], "double", numeric.finite_or_zero) == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert column(spark, [0.49, 0.5, None], "double", numeric.at_least_half) == [0, 1, None]
    assert column(spark, [7.0, -9.0, 1.0, None], "double", numeric.clip) == [5.0, -5.0, 1.0, None]


def test_missing_features_are_omitted_not_zeroed(spark):
    df = spark.createDataFrame([("Angat", 3, 200.0, None, NAN)], "dam string, horizon int, rwl_m double, rain_7d double, rule_curve_m double")
    got = df.select(feature_map(["rwl_m", "rain_7d", "rule_curve_m"])).first()[0]
    assert got == {"rwl_m": 200.0, "dam=Angat": 1.0, "horizon": 3.0}


def test_catchment_points(spark):
    import math

    points = geo.catchment_points(spark.createDataFrame(list(REGISTRY), schemas.REGISTRY)).collect()
    assert len(points) == 5 * len(REGISTRY)
    for name, lat, lon, _ in REGISTRY:
        own = sorted((p for p in points if p.dam == name), key=lambda p: p.point)
        assert (own[0].lat, own[0].lon) == (lat, lon)
        for p in own[1:]:
            dy, dx = (p.lat - lat) * 111.32, (p.lon - lon) * 111.32 * math.cos(math.radians(lat))
            assert math.hypot(dx, dy) == pytest.approx(CATCHMENT_RADIUS_KM, rel=0.02)
