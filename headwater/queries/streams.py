"""Streams run over the given tables until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions.clean import is_alert
from headwater.queries.common import (
    CHANGE, DAILY, REVERSION, TARGETS, query_set, reversion_errors, reversion_table, rounded, with_ctes,
)
from headwater.session import work_folder
from headwater.sources import views
from headwater.sources.files import read_partitions
from headwater.streaming import operators as streams
from headwater.streaming.sources import drain, follow, use_rocksdb

QUERIES, ORACLES, register = query_set()


def _written(df, label):
    """A derived table as files to follow, and its schema."""
    spark = df.sparkSession
    folder = work_folder(spark, label)
    df.write.parquet(folder)
    return follow(spark, folder, df.schema)


def _in_parts(df, label, *parts):
    """A derived table as files to follow one a batch, each of the rows that its condition picks."""
    spark = df.sparkSession
    folder = work_folder(spark, label)
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return follow(spark, folder, df.schema, files_per_batch=1)


@register("stream_first_seen", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, ts, value,
  event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-08' AS late FROM events)
SELECT dam, hour, ts, value FROM r QUALIFY row_number() OVER (PARTITION BY dam, hour ORDER BY late, ts) = 1""")
def stream_first_seen(spark, folder):
    """First readings over three batches, the last one weeks late; late ones count where nothing came before."""
    use_rocksdb(spark)
    readings = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").cast("string").alias("dam"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "value", "event_id")
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    stream = _in_parts(readings, "readings", ~late & early, ~late & ~early, late)
    out, state = work_folder(spark, "first-seen"), work_folder(spark, "first-seen-state")
    found = streams.first_seen_or_late(stream, "dam", "hour", "ts")
    streams.stored_batches(found, out, state).awaitTermination()
    stored = spark.read.schema(found.schema).parquet(out)
    return streams.settle(stored, ["dam", "hour"], "ts").select("dam", "hour", "ts", "value")


@register("stream_score_due", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)}
SELECT r.dam, r.date AS issue_date, r.label_date AS target_date, r.horizon, target_delta IS NOT NULL AS landed,
  round(target_delta, 6) AS actual_delta, round(abs(model - target_delta), 6) AS abs_err_model FROM reversion r
WHERE target_delta IS NOT NULL OR label_date <= (SELECT max(date) - 2 FROM daily)""")
def stream_score_due(spark, folder):
    """Landed forecasts with their error, and those that can no longer land: the
    watermark, two days behind the newest day, counts rows at it as late."""
    issued = reversion_table(spark, folder).select(
        "dam", F.col("date").alias("issue_date"), F.col("label_date").alias("target_date"), "horizon",
        F.col("rwl_m").alias("issue_rwl_m"), F.col("model").alias("pred_delta"))
    seen = views.daily(spark, folder).select("dam", "date", "rwl_m")
    scored = streams.score_due(_written(issued, "issued"), _written(seen, "observed"))
    return rounded(drain(scored, "scored").select("dam", "issue_date", "target_date", "horizon", "landed", "actual_delta", "abs_err_model"))


@register("stream_daily_alerts", """
SELECT CAST(ts AS DATE) AS date, count(*) AS readings, count(*) FILTER (event_type = 'error') AS alerts,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM events
GROUP BY 1 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_daily_alerts(spark, folder):
    status = F.when(F.col("event_type") == "error", "Flood Watch").otherwise("Non-Flood Watch")
    readings = follow(spark, f"{folder}/events.parquet").select(F.col("ts").alias("scraped_at"), is_alert(status).alias("on_watch"))
    return rounded(drain(streams.daily_alerts(readings), "daily-alerts"))


@register("stream_drift")
def stream_drift(spark, folder):
    use_rocksdb(spark)
    errors = reversion_errors(spark, folder).select("dam", "horizon", F.col("label_date").alias("target_date"), "abs_err_model")
    return drain(streams.drift_events(_written(errors, "errors"), 0.2), "drift")


@register("stream_running_stats", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT dam, count(*) AS n, round(sum(target_delta), 4) AS total, round(stddev_pop(target_delta), 6) AS sd, max(label_date) AS upto
FROM targets WHERE target_delta IS NOT NULL GROUP BY dam""")
def stream_running_stats(spark, folder):
    use_rocksdb(spark)
    labels = reversion_errors(spark, folder).select("dam", F.col("actual").alias("actual_delta"), "label_date")
    stats = streams.running_stats(_written(labels, "labels"))
    spark = stats.sparkSession
    # Each batch updates a dam's row; the last one counts.
    out, state = work_folder(spark, "stats"), work_folder(spark, "stats-state")
    query = stats.writeStream.outputMode("update").foreachBatch(
        lambda batch, _: batch.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    latest = spark.read.schema(stats.schema).parquet(out).groupBy("dam").agg(F.max_by(F.struct("*"), "n").alias("r"))
    total = F.round(F.col("r.mean") * F.col("r.n"), 4).alias("total")
    return latest.select("dam", "r.n", total, F.round("r.sd", 6).alias("sd"), "r.upto")


@register("stream_upsert", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, value AS rain_mm,
  CASE WHEN event_type IN ('view', 'click') THEN 'archive' ELSE 'forecast' END AS source, ts AS ingest_seq FROM events)
SELECT dam, date, rain_mm, source FROM r
QUALIFY row_number() OVER (PARTITION BY dam, date ORDER BY (source = 'archive') DESC, ingest_seq DESC) = 1""")
def stream_upsert(spark, folder):
    """Upserts of four batches into daily partitions, in no order of time."""
    source = F.when(F.col("event_type").isin("view", "click"), "archive").otherwise("forecast")
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").cast("string").alias("dam"), F.to_date("ts").alias("date"), F.col("value").alias("rain_mm"),
        source.alias("source"), F.col("ts").alias("ingest_seq"), F.col("event_id").alias("number"))
    stream = _in_parts(rows, "rain", *[F.col("number") % 4 == k for k in (2, 0, 3, 1)]).drop("number")
    out, state = work_folder(spark, "upserted"), work_folder(spark, "upserted-state")
    streams.upsert_stream(stream, out, state, ["dam", "date"], [(F.col("source") == "archive"), F.col("ingest_seq")], "date").awaitTermination()
    return read_partitions(spark, out, stream.schema).select("dam", "date", "rain_mm", "source")
