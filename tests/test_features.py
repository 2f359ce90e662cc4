import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headwater.operators import alerts, keys, rain, series, targets
from headwater.plans import features
from headwater.plans.roles import events_table
from headwater.sources import views

DAY = dt.date(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def frame(spark, values, name="rwl_m", dam="Angat"):
    rows = [(dam, day(n), v) for n, v in values]
    return spark.createDataFrame(rows, f"dam string, date date, {name} double")


def test_first_reading_of_the_day(spark):
    rows = [("a", dt.datetime(2026, 1, 1, 20), 2.0), ("a", dt.datetime(2026, 1, 1, 8), 1.0), ("a", dt.datetime(2026, 1, 2, 9), 3.0)]
    got = series.daily_first(spark.createDataFrame(rows, "dam string, obs_datetime timestamp_ntz, rwl_m double")).orderBy("date").collect()
    assert [(r.date, r.rwl_m) for r in got] == [(day(0), 1.0), (day(1), 3.0)]


def test_change_needs_the_previous_calendar_day(spark):
    daily = frame(spark, [(0, 100.0), (1, 101.5), (3, 104.0), (4, 103.0), (5, 102.0)])
    got = {r.date: r.dev_24h_m for r in series.consecutive_change(daily).collect()}
    assert got == {day(0): None, day(1): 1.5, day(3): None, day(4): -1.0, day(5): -1.0}


def test_rolling_windows_against_pandas(spark):
    rng = np.random.default_rng(3)
    values = [(n, None if rng.random() < 0.2 else float(n * n % 17)) for n in range(60)]
    df = rain.weather_features(frame(spark, values, "precipitation_sum"))
    got = df.orderBy("date").toPandas()
    s = pd.Series([v for _, v in values], dtype=float)
    for n in (1, 3, 7, 14, 30):
        want = s.rolling(n, min_periods=1).sum()
        np.testing.assert_allclose(got[f"rain_{n}d"].astype(float), want)
    for n in (3, 7):
        want = [s[i + 1:i + 1 + n].sum(min_count=1) for i in range(60)]
        np.testing.assert_allclose(got[f"rain_next_{n}d"].astype(float), want)


def test_shift_then_roll_option(spark):
    values = [(n, float(n + 1)) for n in range(20)]
    df = series.forward_sums(frame(spark, values, "precipitation_sum"), "precipitation_sum", short_head=True)
    got = df.orderBy("date").toPandas()
    s = pd.Series([v for _, v in values])
    for n in (3, 7):
        np.testing.assert_allclose(got[f"rain_next_{n}d"].astype(float), s.shift(-n).rolling(n, min_periods=1).sum())


@pytest.mark.parametrize("flags, want, want_from_one", [
    ([1, 1, 0, 1, 1, 0], [0, 1, 0, 1, 2, 0], [1, 2, 0, 1, 2, 0]),
    ([0, 1, 1], [0, 1, 2], [0, 1, 2]),
])
def test_streak(spark, flags, want, want_from_one):
    df = spark.createDataFrame([("b", day(i), bool(f)) for i, f in enumerate(flags)], "basin string, date date, f boolean")
    assert [r.streak for r in series.streak(df, "f", "basin").orderBy("date").collect()] == want
    assert [r.streak for r in series.streak(df, "f", "basin", leading_from_one=True).orderBy("date").collect()] == want_from_one


def test_rolling_mean_needs_a_minimum(spark):
    df = frame(spark, [(n, float(n) if n != 2 else None) for n in range(8)])
    got = [r.roll_rwl_m for r in series.rolling_mean(df, ["rwl_m"], 4, 3, ["dam"]).orderBy("date").collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(4 / 3) and got[7] == pytest.approx(5.5)


def test_target_lands_exactly_h_days_out(spark):
    table = targets.horizon_targets(frame(spark, [(0, 10.0), (1, 11.0), (3, 14.0), (7, 20.0)]))
    got = {(r.date, r.horizon): r.target_delta for r in targets.labelled(table).collect()}
    assert got == {(day(0), 1): 1.0, (day(0), 3): 4.0, (day(0), 7): 10.0, (day(1), 2): 3.0, (day(1), 6): 9.0, (day(3), 4): 6.0}
    assert table.count() == 28


def leads(spark, rows):
    return spark.createDataFrame(rows, "dam string, date date, lead int, rain_mm double")


def test_leads_are_summed_on_the_diagonal(spark):
    rows = [("Angat", day(d), lead, float(lead * 10 + d)) for lead in range(1, 8) for d in range(1, 8)]
    got = rain.lead_windows(leads(spark, rows)).filter(F.col("date") == F.lit(DAY)).collect()
    assert len(got) == 1
    assert got[0].fc_rain_next_3d == 11 + 22 + 33
    assert got[0].fc_rain_next_7d == sum(11 * k for k in range(1, 8))


def test_incomplete_windows_vanish(spark):
    assert rain.lead_windows(leads(spark, [("Angat", day(1), 1, 5.0)])).count() == 0
    three = [("Angat", day(k), k, 1.0) for k in (1, 2, 3)]
    row = rain.lead_windows(leads(spark, three)).first()
    assert row.fc_rain_next_3d == 3.0 and row.fc_rain_next_7d is None


def test_provenance_follows_the_long_window_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0, None), (1.0, 2.0, None, 8.0)],
                               "rain_next_3d double, rain_next_7d double, fc_rain_next_3d double, fc_rain_next_7d double")
    a, b = rain.prefer_forecast(df).collect()
    assert (a.fcst_source, a.rain_next_3d, a.rain_next_7d, a.era5_rain_next_3d) == ("era5_proxy", 9.0, 2.0, 1.0)
    assert (b.fcst_source, b.rain_next_3d, b.rain_next_7d) == ("forecast", 1.0, 8.0)


def test_duplicate_weather_key_fails(spark):
    left, right = frame(spark, [(0, 1.0)]), frame(spark, [(0, 2.0), (0, 3.0)], "rain")
    with pytest.raises(Exception, match="duplicate key"):
        keys.join_one_to_one(left, right, ["dam", "date"]).collect()
    assert keys.join_one_to_one(left, frame(spark, [(0, 2.0)], "rain"), ["dam", "date"]).first().rain == 2.0


def test_table_key_is_unique(spark, folder):
    table = events_table(spark, folder)
    assert table.count() == table.select("dam", "date", "horizon").distinct().count()


def test_later_rows_do_not_change_earlier_features(spark, folder):
    """Levels and weather after a day are perturbed; features at it must not move."""
    cut = F.lit("2024-01-15").cast("date")
    later = F.col("date") > cut

    def build(shift):
        move = lambda df, c: df.withColumn(c, F.when(later, F.col(c) + shift).otherwise(F.col(c)))
        return features.base_table(
            move(views.daily(spark, folder), "rwl_m"), move(views.weather(spark, folder), "temperature_2m_mean"),
            views.forecasts(spark, folder), views.alerts(spark, folder)).drop("ahead").filter(F.col("date") <= cut)

    assert build(0.0).exceptAll(build(50.0)).count() == 0


def test_alert_status_gates(spark):
    def gate(n_days, on):
        rows = [("Agno", "river_basin", day(i), i % 3 == 0 if on else False) for i in range(n_days)]
        states = spark.createDataFrame(rows, "basin string, kind string, date date, on_watch boolean")
        return alerts.status_gate(states, alerts.alert_targets(alerts.alert_features(states))).first()

    assert gate(4, True).status == "not enough history yet"
    assert gate(40, False).status == "not enough flood-watch days to learn from"
    full = gate(40, True)
    assert full.status == "scored" and full.days_collected == 40 and full.basins == 1
    assert gate(0, True).status == "no data"


def test_confusion_without_events_has_no_recall(spark):
    rows = [(1, 0, 0, 0), (1, 0, 1, 0), (2, 1, 1, 0), (2, 0, 0, 0)]
    df = spark.createDataFrame(rows, "horizon int, actual int, pred int, persistence int")
    one, two = alerts.confusion(df).orderBy("horizon").collect()
    assert one.model_recall is None and one.model_precision == 0.0 and one.beats_baseline is False
    assert two.model_recall == 1.0 and two.persistence_recall == 0.0 and two.beats_baseline is True
