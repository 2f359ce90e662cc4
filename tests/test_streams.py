"""Streams over several micro-batches against the batch operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import drift
from headwater.session import materialise
from headwater.sources.files import read_partitions
from headwater.streaming import operators as streams
from headwater.streaming.sources import drain, follow, use_rocksdb

DAY = dt.date(2026, 1, 1)


def land(spark, path, parts, schema):
    """One file per part, in order; then a stream of one file per batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return follow(spark, path, files_per_batch=1)


def test_first_seen_across_batches(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    parts = [[("x", at(8), 1.0), ("y", at(8), 5.0)], [("x", at(8), 2.0), ("x", at(9), 3.0)], [("y", at(8), 6.0)]]
    stream = land(spark, str(tmp_path / "in"), parts, "dam string, obs_datetime timestamp_ntz, rwl_m double")
    got = {(r.dam, r.obs_datetime.hour): r.rwl_m for r in drain(streams.first_seen(stream, ["dam", "obs_datetime"]), "t").collect()}
    assert got == {("x", 8): 1.0, ("y", 8): 5.0, ("x", 9): 3.0}


def test_forecasts_wait_for_their_day(spark, tmp_path):
    book = "dam string, issue_date date, target_date date, horizon int, issue_rwl_m double, pred_delta double"
    forecasts, seen = [], []
    for n in range(12):
        forecasts.append([("x", DAY + dt.timedelta(n), DAY + dt.timedelta(n + h), h, 100.0 + n, 1.0) for h in (1, 3)])
        # Day 5 is never observed.
        seen.append([("x", DAY + dt.timedelta(n), 100.0 + n)] if n != 5 else [("y", DAY + dt.timedelta(n), 1.0)])
    scored = streams.score_due(land(spark, str(tmp_path / "f"), forecasts, book),
                               land(spark, str(tmp_path / "o"), seen, "dam string, date date, rwl_m double"), late="2 days")
    got = drain(scored, "t").collect()
    landed = {(r.issue_date, r.horizon): r.abs_err_model for r in got if r.landed}
    want = {(DAY + dt.timedelta(n), h): abs(h - 1.0) for n in range(12) for h in (1, 3) if n + h < 12 and n + h != 5}
    assert landed == want
    assert {(r.target_date) for r in got if not r.landed} == {DAY + dt.timedelta(5)}
    assert len(got) == len({(r.issue_date, r.horizon) for r in got})


def test_drift_state_survives_batches(spark, tmp_path):
    use_rocksdb(spark)
    errors = [("a", 1, DAY + dt.timedelta(n), 0.3 if n < 60 else 4.0) for n in range(120)] + \
             [("b", 2, DAY + dt.timedelta(n), 0.3 + 0.01 * (n % 3)) for n in range(120)]
    parts = [[e for e in errors if k * 30 <= (e[2] - DAY).days < (k + 1) * 30] for k in range(4)]
    schema = "dam string, horizon int, target_date date, abs_err_model double"
    stream = drain(streams.drift_events(land(spark, str(tmp_path / "e"), parts, schema)), "t")
    batch = drift.drift_events(spark.createDataFrame(errors, schema))
    key = lambda df: sorted((r.dam, r.horizon, r.detected_at) for r in df.collect())
    assert key(stream) == key(batch) != []


def test_running_stats(spark, tmp_path):
    use_rocksdb(spark)
    rng = np.random.default_rng(1)
    values = rng.normal(3, 2, 90)
    rows = [("x", float(v), DAY + dt.timedelta(i)) for i, v in enumerate(values)]
    stream = land(spark, str(tmp_path / "l"), [rows[:10], rows[10:50], rows[50:]], "dam string, actual_delta double, label_date date")
    out = str(tmp_path / "out")
    streams.running_stats(stream).writeStream.outputMode("update").foreachBatch(
        lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).orderBy("n").collect()
    assert [r.n for r in got] == [10, 50, 90]
    for r in got:
        assert r.mean == pytest.approx(values[:r.n].mean()) and r.sd == pytest.approx(values[:r.n].std())


def test_upserts_follow_source_rank(spark, tmp_path):
    schema = "dam string, date date, rain_mm double, source string, seq int"
    row = lambda d, v, s, q: ("x", DAY + dt.timedelta(d), v, s, q)
    parts = [[row(0, 1.0, "forecast", 1), row(1, 1.0, "archive", 1)], [row(0, 2.0, "archive", 2), row(1, 9.0, "forecast", 2)],
             [row(0, 8.0, "forecast", 3), row(40, 4.0, "forecast", 3)], [row(40, 5.0, "forecast", 4)]]
    stream = land(spark, str(tmp_path / "w"), parts, schema)
    out = str(tmp_path / "out")
    order = [F.col("source") == "archive", F.col("seq")]
    streams.upsert_stream(stream, out, str(tmp_path / "c"), ["dam", "date"], order, "date").awaitTermination()
    got = {(r.date - DAY).days: r.rain_mm for r in read_partitions(spark, out, stream.schema).collect()}
    assert got == {0: 2.0, 1: 1.0, 40: 5.0}


def test_late_readings_go_to_the_side_and_are_settled(spark, tmp_path):
    use_rocksdb(spark)
    at = lambda d, h, m=0: dt.datetime(2026, 1, d, h, m)
    row = lambda dam, d, h, v, m=0: (dam, at(d, h), at(d, h, m), v)
    parts = [[row("x", 1, 8, 1.0, 9), row("x", 1, 8, 2.0, 3), row("y", 1, 8, 5.0)], [row("x", 9, 8, 3.0), row("x", 1, 8, 7.0)],
             [row("x", 1, 8, 8.0), row("x", 2, 8, 4.0, 5), row("x", 2, 8, 6.0, 1), row("x", 9, 8, 9.0), row("y", 2, 8, 1.0)]]
    stream = land(spark, str(tmp_path / "in"), parts, "dam string, hour timestamp_ntz, seen timestamp_ntz, v double")
    found = streams.first_seen_or_late(stream, "dam", "hour", "seen", "2 days", salts=1)
    streams.stored_batches(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    # The second batch may still tell that x has the first day's key; the third is eight days behind.
    assert sorted((r.dam, r.hour.day, r.v) for r in stored.filter("late").collect()) == [("x", 1, 8.0), ("x", 2, 6.0)]
    settled = streams.settle(stored, ["dam", "hour"], "seen").collect()
    assert sorted((r.dam, r.hour.day, r.v) for r in settled) == [("x", 1, 2.0), ("x", 2, 6.0), ("x", 9, 3.0), ("y", 1, 5.0), ("y", 2, 1.0)]


def test_drift_windows_in_steps_equal_the_whole_log(spark):
    rng = np.random.default_rng(4)
    errors = [("a", 1, DAY + dt.timedelta(n), float(rng.exponential(0.3 if n % 90 < 45 else 3))) for n in range(200)]
    errors += [("b", 2, DAY + dt.timedelta(n), 0.3) for n in range(40)] + [("c", 1, DAY, None), ("a", 2, DAY, float("nan"))]
    schema = "dam string, horizon int, target_date date, abs_err_model double"
    state, events = None, []
    for begin in range(0, 200, 25):
        part = [e for e in errors if begin <= (e[2] - DAY).days < begin + 25]
        step = materialise(drift.drift_step(state, spark.createDataFrame(part, schema)), "step")
        state, events = step.drop("events"), events + drift.events_of(step).collect()
    whole = drift.drift_events(spark.createDataFrame(errors, schema)).collect()
    assert sorted(map(tuple, events)) == sorted(map(tuple, whole)) != []
    assert state.count() == 2


def test_daily_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda d, h: dt.datetime(2026, 1, d, h)
    parts = [[(at(1, 1), True), (at(1, 5), False)], [(at(2, 3), True)], [(at(1, 9), True)], [(at(4, 1), False)]]
    stream = land(spark, str(tmp_path / "a"), parts, "scraped_at timestamp_ntz, on_watch boolean")
    got = {r.date.day: (r.readings, r.alerts) for r in drain(streams.daily_alerts(stream), "t").collect()}
    assert got == {1: (3, 2), 2: (1, 1)}


class _Handle:
    """One state, kept in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_one_state_serves_many_entities():
    import numpy as np
    import pandas as pd
    rng, late = np.random.default_rng(5), 10
    processor = streams.FirstSeenProcessor(["dam", "n"], "dam", late)
    processor.init(_Handle())
    seen, newest = {}, {}
    for batch in range(4):
        rows = pd.DataFrame({"dam": [f"d{i}" for i in rng.integers(0, 30, 400)], "salt__": rng.integers(0, 2, 400), "at__": rng.integers(0, 40, 400) + 5 * batch,
                             "order__": rng.permutation(400), "n": np.arange(400)})
        (found,) = processor.handleInputRows((0,), iter([rows[:150], rows[150:]]), None)
        want, behind, before = set(), set(), dict(newest)
        for r in rows.sort_values("order__").itertuples():
            who = r.dam, r.salt__
            is_late = who in before and r.at__ < before[who] - late
            known = behind if is_late else seen.setdefault(who, set())
            key = (who, r.at__) if is_late else r.at__
            if key not in known:
                known.add(key)
                want.add((r.dam, r.n, is_late))
            newest[who] = max(newest.get(who, 0), r.at__)
        seen = {who: {k for k in keys if k >= newest[who] - late} for who, keys in seen.items()}
        assert set(found.itertuples(index=False, name=None)) == want


def test_one_state_serves_many_series():
    import datetime as dt

    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(6)
    values = {(f"d{i}", h): np.r_[rng.normal(1, 0.1, 40), rng.normal(6, 0.1, 40)] for i in range(12) for h in (1, 2)}
    processor, found = streams.DriftProcessor(0.2), set()
    processor.init(_Handle())
    for part in (slice(0, 30), slice(30, 80)):
        rows = pd.DataFrame([(d, h, dt.date(2026, 1, 1) + dt.timedelta(at), float(v)) for (d, h), series in values.items()
                             for at, v in list(enumerate(series))[part]], columns=["dam", "horizon", "target_date", "abs_err_model"]).sample(frac=1, random_state=1)
        (hits,) = processor.handleInputRows((0,), iter([rows]), None)
        found |= set(zip(hits["dam"], hits["horizon"], hits["detected_at"]))
    want = {(d, h, dt.date(2026, 1, 1) + dt.timedelta(at)) for (d, h), series in values.items() for at in drift.replay(series, 0.2)}
    assert found == want and want
