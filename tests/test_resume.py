"""A backtest carried on day by day against the one over the whole table."""

import pytest
from pyspark.sql import functions as F

from headwater.plans import backtest
from headwater.plans.roles import events_table
from headwater.session import materialise

KEYS = ("dam", "date", "horizon")


def as_known(table, cut):
    """The table as it stood on a day: no later rows, no later labels."""
    day = F.lit(cut).cast("date")
    known = F.when(F.date_add("date", F.col("horizon").cast("int")) <= day, F.col("target_delta"))
    return table.filter(F.col("date") <= day).withColumn("target_delta", known)


def errors(df):
    return {tuple(r[k] for k in KEYS): (r.model, r.abs_err_model, r.abs_err_drift) for r in df.collect()}


def test_runs_together_equal_one_backtest(spark, folder, tmp_path, monkeypatch):
    table = materialise(events_table(spark, folder), "table")
    progress = backtest.Progress(str(tmp_path / "run"))
    found = {}
    for cut in ("2024-01-12", "2024-01-13", "2024-01-20"):
        found |= errors(backtest.resume(progress, as_known(table, cut)))
    # A run that stops before it notes its day is made again.
    with monkeypatch.context() as broken:
        broken.setattr(backtest, "errors_of", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            backtest.resume(progress, table)
    found |= errors(backtest.resume(progress, table))
    newest = table.agg(F.max("date")).first()[0]
    whole = errors(backtest.backtest(as_known(table, str(newest))))
    assert found.keys() == whole.keys()
    bad = {k: (found[k], v) for k, v in whole.items() if found[k] != pytest.approx(v, abs=1e-6, rel=1e-6)}
    assert not bad
    assert backtest.resume(progress, table).count() == 0


def test_a_later_run_reads_the_last_days(spark, folder, tmp_path):
    """What lies further back than a horizon may be gone."""
    table = materialise(events_table(spark, folder), "table")
    one, two = (backtest.Progress(str(tmp_path / n)) for n in "ab")
    for progress in (one, two):
        backtest.resume(progress, as_known(table, "2024-01-20"))
    near = table.filter(F.col("date") > F.lit("2024-01-13").cast("date"))
    assert errors(backtest.resume(one, as_known(near, "2024-01-21"))) == errors(backtest.resume(two, as_known(table, "2024-01-21"))) != {}
