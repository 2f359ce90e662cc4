import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from headwater import schemas
from headwater.operators import drift, ledger, scoreboard, search
from headwater.operators.alerts import latest_day
from headwater.plans import tick
from headwater.plans.backtest import predictions
from headwater.plans.roles import events_table
from headwater.sources import views
from headwater.session import materialise
from headwater.sources.files import read_table

D1, D2, D9 = dt.date(2026, 1, 1), dt.date(2026, 1, 2), dt.date(2026, 1, 9)


def entry(**over):
    row = {"issue_date": D1, "target_date": D2, "dam": "Angat", "horizon": 1, "issue_rwl_m": 100.0, "pred_delta": 1.0,
           "features": {"rwl_m": 100.0, "rain_7d": 20.0}, "baseline_inputs": {"dev_24h_m": 0.5, "horizon": 1.0}}
    row.update(over)
    return tuple(row[f.name] for f in schemas.LEDGER)


@pytest.fixture
def actuals(spark):
    return spark.createDataFrame([("Angat", D1, 100.0), ("Angat", D2, 101.5)], "dam string, date date, rwl_m double")


def test_scored_against_the_named_day(spark, actuals):
    got = ledger.score_due(spark.createDataFrame([entry()], schemas.LEDGER), None, actuals).collect()
    assert len(got) == 1
    assert (got[0].actual_delta, got[0].abs_err_model, got[0].abs_err_persistence, got[0].abs_err_drift) == (1.5, 0.5, 1.5, 1.0)


def test_scored_once(spark, actuals):
    book = spark.createDataFrame([entry(), entry(horizon=8, target_date=D9)], schemas.LEDGER)
    errors = ledger.score_due(book, None, actuals)
    assert ledger.score_due(book, errors, actuals).count() == 0
    waiting = ledger.open_forecasts(book, errors).collect()
    assert [r.target_date for r in waiting] == [D9]


def test_missing_change_falls_back_to_persistence(spark, actuals):
    book = spark.createDataFrame([entry(baseline_inputs={"horizon": 1.0})], schemas.LEDGER)
    assert ledger.score_due(book, None, actuals).first().abs_err_drift == 1.5


def test_unknown_level_leaves_a_forecast_open(spark):
    unknown = spark.createDataFrame([("Angat", D2, None)], "dam string, date date, rwl_m double")
    assert ledger.score_due(spark.createDataFrame([entry()], schemas.LEDGER), None, unknown).count() == 0


def test_json_round_trip(spark):
    book = spark.createDataFrame([entry(), entry(horizon=2, baseline_inputs={"horizon": 2.0})], schemas.LEDGER)
    back = ledger.ledger_from_json(ledger.ledger_json(book))
    assert sorted(map(str, back.collect())) == sorted(map(str, book.collect()))


def board(spark, rows):
    errors = []
    for horizon, n, model, persistence, naive in rows:
        errors += [(horizon, model, persistence, naive)] * n
    df = spark.createDataFrame(errors, "horizon int, abs_err_model double, abs_err_persistence double, abs_err_drift double")
    return scoreboard.scoreboard(df)


def test_gate_and_ties(spark):
    got = {r.horizon: r for r in scoreboard.with_verdicts(board(spark, [
        (1, 200, 0.3, 0.4, 0.5), (2, 199, 0.3, 0.4, 0.4), (3, 200, 0.4, 0.4, 0.4), (4, 50, 0.9, 0.8, 0.7)])).collect()}
    assert got[1].beats_baseline and got[1].verdict == "model wins"
    assert not got[2].beats_baseline and got[2].verdict == "ahead, needs 1 more" and got[2].best_baseline == "persistence"
    assert not got[3].beats_baseline and got[3].verdict == "baseline wins"
    assert got[4].verdict == "behind, needs 150 more" and got[4].best_baseline == "drift"


def test_claims(spark):
    full = scoreboard.rollup(board(spark, [(1, 200, 0.1, 0.4, 0.5), (2, 201, 0.1, 0.4, 0.5)])).first()
    assert full.claim == "all horizons certified" and full.certified == [1, 2]
    counting = scoreboard.rollup(board(spark, [(1, 200, 0.1, 0.4, 0.5), (2, 150, 0.1, 0.4, 0.5), (3, 180, 0.1, 0.4, 0.5)])).first()
    assert counting.claim == "ahead everywhere, still counting" and counting.next_needs == 20 and counting.provisional == [2, 3]
    losing = scoreboard.rollup(board(spark, [(1, 200, 0.1, 0.4, 0.5), (2, 200, 0.6, 0.4, 0.5)])).first()
    assert losing.claim == "ahead at some horizons" and losing.losing == [2]


def test_ratio_is_capped_where_an_error_is_not_finite(spark):
    rows = [("m", "dev", 1, float("inf"), 1.0, 2.0), ("m", "dev", 2, 0.5, 1.0, 2.0), ("m", "holdout", 1, 9.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, split string, horizon int, abs_err_model double, abs_err_persistence double, abs_err_drift double")
    per, overall = search.config_scores(df, config=["model"])
    ratios = {(r.split, r.horizon): (r.ratio, r.wins) for r in per.collect()}
    assert ratios == {("dev", 1): (3.0, False), ("dev", 2): (0.5, True), ("holdout", 1): (3.0, False)}
    dev = overall.filter("split = 'dev'").first()
    assert dev.mae is None and dev.n_wins == 1 and dev.mean_ratio == 1.75 and dev.worst_ratio == 3.0
    wide = search.dev_and_holdout(overall, config=["model"]).first()
    assert wide.slippage == 1.25


def test_grids(spark):
    models = [f"m{i}" for i in range(34)]
    assert search.coarse_grid(spark, models).count() == 34 * 2 * 4 * 2 * 2
    assert search.fine_grid(spark, models[:6]).count() == 6 * 4 * 4 * 2 * 2 * 5
    assert search.blend_grid(spark, models[:4]).count() == 4 * 2 * 4 * 2 * 2 * 4 * 2 + 4 * 2 * 4 * 2 * 2
    grid = search.coarse_grid(spark, ["a"])
    assert search.not_yet_done(grid, grid.filter("shrink = 1.0")).count() == grid.count() // 2


def test_holdout_never_decides_the_rank(spark):
    rows = [("a", 0.8, 5, 0.1), ("b", 0.7, 4, 9.0), ("c", 0.7, 6, 5.0)]
    wide = spark.createDataFrame(rows, "model string, dev_mean_ratio double, dev_n_wins int, holdout_mean_ratio double")
    assert [r.model for r in search.top_configs(wide, 3, ["model"]).collect()] == ["c", "b", "a"]
    assert search.most_wins(wide, ["model"]).first().model == "c"
    assert [r.model for r in search.leading_families(wide, 2, ["model"]).collect()] == ["b", "c"]


def test_adaptive_window_finds_a_shift_and_ignores_noise():
    quiet = [0.3 + 0.05 * math.sin(i) for i in range(200)]
    assert list(drift.replay(quiet)) == []
    hits = drift.replay(quiet + [2.0 + v for v in quiet])
    assert hits and 200 <= hits[0] < 215
    window = drift.AdaptiveWindow()
    for v in quiet * 20:
        window.add(v)
    assert len(window.buckets) < 70 and window.n == sum(b[0] for b in window.buckets)


def test_drift_events_per_series(spark):
    rows = [("a", 1, D1 + dt.timedelta(i), 0.3 if i < 40 else 4.0) for i in range(80)]
    rows += [("b", 1, D1 + dt.timedelta(i), 0.3) for i in range(80)]
    df = spark.createDataFrame(rows, "dam string, horizon int, target_date date, abs_err_model double")
    got = drift.drift_events(df).collect()
    assert {r.dam for r in got} == {"a"} and min(r.detected_at for r in got) >= D1 + dt.timedelta(40)
    shifted = drift.mean_shift(df).filter("shifted").collect()
    assert {r.dam for r in shifted} == {"a"}


def test_a_run_twice_adds_nothing(spark, folder, tmp_path):
    store = tick.Store(str(tmp_path / "loop"))
    cut = F.lit("2024-01-20").cast("date")
    table, daily = events_table(spark, folder), views.daily(spark, folder)
    registry, states = views.registry(spark, folder), views.alerts(spark, folder)
    early = table.filter(F.col("date") <= cut)
    for _ in range(2):
        tick.run(spark, store, early, daily.filter(F.col("date") <= cut), registry, states, F.lit("2024-01-21").cast("date"))
    book = read_table(spark, store.ledger, schemas.LEDGER)
    issued = book.count()
    assert issued and issued == book.select(*schemas.LEDGER_KEY).distinct().count()
    assert read_table(spark, store.errors, schemas.ERROR_LOG, optional=True).count() == 0
    for _ in range(2):
        tick.run(spark, store, table, daily, registry, states, F.lit("2024-02-01").cast("date"))
    errors = read_table(spark, store.errors, schemas.ERROR_LOG)
    due = read_table(spark, store.ledger, schemas.LEDGER).join(daily.select("dam", F.col("date").alias("target_date")), ["dam", "target_date"])
    assert errors.count() == due.count() > 0
    assert errors.count() == errors.select(*schemas.LEDGER_KEY).distinct().count()
    sections = {r.section for r in spark.read.parquet(store.published).select("section").distinct().collect()}
    assert {"dams", "metrics", "learning_curve", "freshness"} <= sections
    learned = tick.learned_rows(book, errors, ["rwl_m", "rain_7d"])
    assert learned.count() == errors.join(book, list(schemas.LEDGER_KEY)).count()


def test_the_loop_learns_from_what_forecasts_saw(spark, folder, tmp_path):
    store = tick.Store(str(tmp_path / "loop"))
    cut = F.lit("2024-01-20").cast("date")
    table = materialise(events_table(spark, folder), "table")
    daily = views.daily(spark, folder).select("dam", "date", "rwl_m")
    known = F.when(F.date_add("date", F.col("horizon").cast("int")) <= cut, F.col("target_delta"))
    early = table.filter(F.col("date") <= cut).withColumn("target_delta", known)

    def sums():
        return spark.read.schema(schemas.SUMS).parquet(store.learned).groupBy("cell").agg(F.sum("part").alias("s")).orderBy("cell").collect()

    def predicted(t):
        return {(r.dam, r.horizon): r.model for r in tick.forecast(spark, store, t).collect()}

    tick.warm_start(spark, store, early)
    # The first run's model is the backtest's on that day.
    first = predicted(early)
    want = {(r.dam, r.horizon): r.model for r in latest_day(predictions(early)).collect()}
    assert first.keys() == want.keys() and all(first[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    tick.issue(spark, store, tick.forecast(spark, store, early))
    tick.warm_start(spark, store, table)  # reduces nothing anew
    scored, _ = tick.score(spark, store, daily)
    n = scored.count()
    # The last cell counts rows: one for each landed forecast.
    assert n > 0 and sums()[-1].s == n and predicted(early) != first
    after = [r.s for r in sums()]
    tick.score(spark, store, daily)
    assert [r.s for r in sums()] == after
    # A forecast reads the newest day and the sums alone.
    newest = early.agg(F.max("date")).scalar()
    assert predicted(early.filter(F.col("date") == newest)) == predicted(early)
    # A correction of the table's past changes nothing that was learned.
    now = predicted(early)
    spoilt = early.withColumn("rain_7d", F.when(F.col("date") < early.agg(F.max("date")).scalar(), 1e6).otherwise(F.col("rain_7d")))
    tick.warm_start(spark, store, spoilt)
    assert predicted(spoilt) == now


def test_a_run_that_stops_before_the_log_learns_once(spark, folder, tmp_path, monkeypatch):
    store = tick.Store(str(tmp_path / "loop"))
    book = spark.createDataFrame([entry()], schemas.LEDGER)
    seen = spark.createDataFrame([("Angat", D2, 101.5)], "dam string, date date, rwl_m double")
    tick.append(book, store.ledger)
    with monkeypatch.context() as broken:
        broken.setattr(tick, "append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tick.score(spark, store, seen)
    tick.score(spark, store, seen)
    learned = spark.read.schema(schemas.SUMS).parquet(store.learned)
    assert learned.orderBy(F.desc("cell")).first().part == 1.0


def test_scratch_results_are_removed(spark, tmp_path, monkeypatch):
    import os

    from headwater import session

    monkeypatch.setattr(session, "work_folder", lambda _, label: f"{tmp_path}/{label}")
    kept = session.materialise(spark.range(3).toDF("x"), "kept")
    with session.scratch(spark):
        outer = session.materialise(kept, "outer")
        with session.scratch(spark):
            assert session.materialise(outer, "inner").count() == 3
        assert not os.path.exists(f"{tmp_path}/inner") and outer.count() == 3
    assert not os.path.exists(f"{tmp_path}/outer") and kept.count() == 3
