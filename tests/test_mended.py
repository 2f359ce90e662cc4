"""Inputs that once failed or gave wrong values."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from headwater.functions import numeric
from headwater.functions.registry import BASELINES
from headwater.operators import scoreboard
from headwater.operators.drift import drift_events
from headwater.plans import search
from headwater.sources import files, incremental
from headwater.streaming import operators
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

RAIN = StructType([StructField("dam", StringType()), StructField("date", DateType()), StructField("lead", IntegerType()),
                   StructField("rain_mm", DoubleType()), StructField("source", StringType())])


def test_csv_columns_go_by_name(spark, tmp_path):
    path = str(tmp_path / "rain.csv")
    (tmp_path / "rain.csv").write_text("lead,dam,date,rain_mm,extra\n3,Angat,2024-01-02,4.5,x\nmany,Ipo,2024-01-03,,y\n")
    rows = files.read_table(spark, path, RAIN, "csv").orderBy("dam").collect()
    assert [tuple(r) for r in rows] == [("Angat", dt.date(2024, 1, 2), 3, 4.5, None), ("Ipo", dt.date(2024, 1, 3), None, None, None)]
    assert [(r.dam, r.lead) for r in files.unreadable_csv(spark, path, RAIN).collect()] == [("Ipo", "many")]
    assert files.read_table(spark, str(tmp_path / "none.csv"), RAIN, "csv", optional=True).count() == 0


def test_empty_ranges_ask_for_nothing(spark):
    spans = spark.sql("SELECT 'a' AS dam, date'2024-03-01' AS start_date, date'2023-12-01' AS end_date")
    assert incremental.by_year(spans).count() == 0 and incremental.by_days(spans, 10).count() == 0


def test_append_runs_once_and_keeps_rows(spark, tmp_path):
    path, df = str(tmp_path / "log"), spark.range(3)
    for some in (df, df.limit(0), df):
        files.append(some, path)
    assert spark.read.parquet(path).count() == 6


def test_labels_without_a_value_leave_statistics_alone(spark, tmp_path):
    batches = [[1.0, None], [float("nan")], [3.0]]
    for i, values in enumerate(batches):
        rows = pd.DataFrame({"dam": "a", "actual_delta": values, "label_date": dt.date(2024, 1, 1 + i)})
        spark.createDataFrame(rows, "dam string, actual_delta double, label_date date").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("dam string, actual_delta double, label_date date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = operators.running_stats(stream).writeStream.outputMode("update").format("memory").queryName("mended_stats")
    query = found.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("mended_stats").orderBy(F.desc("n")).first()
    assert (last.n, last.mean, last.sd) == (2, 2.0, 1.0)


def test_errors_without_a_value_are_no_drift(spark):
    rows = [("a", 1, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate([0.1, None, float("nan"), 0.1])]
    assert drift_events(spark.createDataFrame(rows, "dam string, horizon int, target_date date, abs_err_model double")).count() == 0


def test_search_gives_estimators_every_pool(spark, monkeypatch):
    """Trees once pooled all rows only, and other poolings failed."""
    asked = []

    def errors(table, models, grid, **_):
        asked.append((models, tuple(grid["poolings"])))
        raise ValueError("x" * 900)

    monkeypatch.setattr(search, "_errors", errors)
    try:
        search.staged_search(spark.range(1), ("mean", "forest10"))
    except ValueError as error:
        assert "no configuration" in str(error)
    assert asked == [((m,), tuple(search.POOLINGS)) for m in ("mean", "forest10")]


def test_means_on_a_tie_round_alike_in_any_order(spark):
    # Their mean is 61.75875, or the double below or above it, by the order of the sum.
    values = [34.57, 22.09, 67.77, 83.93, 93.29, 35.04, 88.36, 69.02]
    names = ("model", *BASELINES)
    for some in (values, values[::-1]):
        frame = pd.DataFrame({"horizon": 1, **{f"abs_err_{n}": some for n in names}})
        row = scoreboard.scoreboard(spark.createDataFrame(frame).coalesce(1)).first()
        assert [row[f"mae_{n}"] for n in names] == [61.7588] * len(names)
        curve = spark.createDataFrame(frame.assign(target_date=dt.date(2024, 1, 5))).coalesce(1)
        curve = scoreboard.learning_curve(curve, "target_date").select(numeric.published("abs_err_model"))
        assert curve.first()[0] == 61.7588
