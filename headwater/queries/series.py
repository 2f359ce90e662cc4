"""Daily collapse, windows, streaks and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import keys, series
from headwater.queries.common import (
    DAILY, WEATHER, query_set, rounded, with_ctes,
)
from headwater.sources import views

QUERIES, ORACLES, register = query_set()

RAIN = ("rain_1d", "rain_3d", "rain_7d", "rain_14d", "rain_30d")


@register("daily_first", """
SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, value AS rwl_m
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) = 1""")
def daily_first(spark, folder):
    return series.daily_first(views.readings(spark, folder).select("dam", "obs_datetime", "rwl_m"))


@register("consecutive_change", f"""{with_ctes(DAILY)},
lagged AS (SELECT dam, date, rwl_m, lag(rwl_m) OVER w AS prev_rwl_m, lag(date) OVER w AS prev_date
           FROM daily WINDOW w AS (PARTITION BY dam ORDER BY date))
SELECT dam, date, rwl_m, prev_rwl_m, prev_date,
  round(CASE WHEN date - prev_date = 1 THEN rwl_m - prev_rwl_m END, 6) AS dev_24h_m FROM lagged""")
def consecutive_change(spark, folder):
    daily = series.daily_first(views.readings(spark, folder).select("dam", "obs_datetime", "rwl_m"))
    return rounded(series.consecutive_change(series.with_previous_reading(daily)))


@register("rolling_back", f"""{with_ctes(WEATHER)}
SELECT w.dam, w.date, {", ".join(
    f"round((SELECT sum(b.precipitation_sum) FROM weather b WHERE b.dam = w.dam AND b.date BETWEEN w.date - {n - 1} AND w.date), 6) AS rain_{n}d"
    for n in (1, 3, 7, 14, 30))} FROM weather w""")
def rolling_back(spark, folder):
    rolled = series.backward_sums(views.weather(spark, folder), "precipitation_sum")
    return rounded(rolled.select("dam", "date", *RAIN))


@register("rolling_forward", f"""{with_ctes(WEATHER)}
SELECT w.dam, w.date, {", ".join(
    f"round((SELECT sum(b.precipitation_sum) FROM weather b WHERE b.dam = w.dam AND b.date BETWEEN w.date + 1 AND w.date + {n}), 6) AS rain_next_{n}d"
    for n in (3, 7))} FROM weather w""")
def rolling_forward(spark, folder):
    rolled = series.forward_sums(views.weather(spark, folder), "precipitation_sum")
    return rounded(rolled.select("dam", "date", "rain_next_3d", "rain_next_7d"))


@register("rolling_forward_short_head", f"""{with_ctes(WEATHER)},
ahead AS (SELECT dam, date, lead(precipitation_sum, 3) OVER w AS a3, lead(precipitation_sum, 7) OVER w AS a7
          FROM weather WINDOW w AS (PARTITION BY dam ORDER BY date))
SELECT dam, date,
  round(sum(a3) OVER (PARTITION BY dam ORDER BY date ROWS 2 PRECEDING), 6) AS rain_next_3d,
  round(sum(a7) OVER (PARTITION BY dam ORDER BY date ROWS 6 PRECEDING), 6) AS rain_next_7d
FROM ahead""")
def rolling_forward_short_head(spark, folder):
    rolled = series.forward_sums(views.weather(spark, folder), "precipitation_sum", short_head=True)
    return rounded(rolled.select("dam", "date", "rain_next_3d", "rain_next_7d"))


@register("rolling_mean_min", """
WITH daily AS (SELECT o_orderpriority AS dam, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS rwl_m
               FROM orders GROUP BY 1, 2)
SELECT dam, date, round(rwl_m, 6) AS rwl_m,
  round(CASE WHEN count(rwl_m) OVER w >= 5 THEN avg(rwl_m) OVER w END, 6) AS roll_rwl_m
FROM daily WINDOW w AS (PARTITION BY dam ORDER BY date ROWS 19 PRECEDING)""")
def rolling_mean_min(spark, folder):
    daily = views.order_series(spark, folder)
    return rounded(series.rolling_mean(daily, ["rwl_m"], 20, 5, ["dam"]))


_STREAK_SQL = """
WITH alerts AS (SELECT CAST(user_id AS VARCHAR) AS basin, CAST(ts AS DATE) AS date,
                  bool_or(event_type = 'error') AS on_watch FROM events GROUP BY 1, 2),
islands AS (SELECT *, sum(CASE WHEN on_watch THEN 0 ELSE 1 END) OVER (PARTITION BY basin ORDER BY date) AS island FROM alerts)
SELECT basin, date, on_watch,
  CAST(row_number() OVER (PARTITION BY basin, island ORDER BY date) - 1 AS BIGINT) AS streak FROM islands"""


@register("streak", _STREAK_SQL)
def streak(spark, folder):
    flags = views.table(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("basin"), F.to_date("ts").alias("date")
    ).agg(F.max(F.col("event_type") == "error").alias("on_watch"))
    return series.streak(flags, "on_watch", "basin")


def _hourly_readings(spark, folder):
    """Readings keyed (dam, hour), so that keys repeat."""
    return views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("dam"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("obs_datetime"),
        F.col("value").alias("rwl_m"), F.col("ts").alias("scraped_at"), "event_type",
    )


@register("first_seen_upsert", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dam, date_trunc('hour', ts) AS obs_datetime, value AS rwl_m,
             ts AS scraped_at, event_type FROM events),
stored AS (SELECT DISTINCT dam, obs_datetime FROM r WHERE event_type IN ('view', 'click'))
SELECT dam, CAST(obs_datetime AS TIMESTAMP) AS obs_datetime, rwl_m, scraped_at FROM r
WHERE event_type NOT IN ('view', 'click') AND (dam, obs_datetime) NOT IN (SELECT (dam, obs_datetime) FROM stored)
QUALIFY row_number() OVER (PARTITION BY dam, obs_datetime ORDER BY scraped_at) = 1""")
def first_seen_upsert(spark, folder):
    rows = _hourly_readings(spark, folder)
    archived = F.col("event_type").isin("view", "click")
    return keys.first_seen(
        rows.filter(archived).drop("event_type"), rows.filter(~archived).drop("event_type"),
        ["dam", "obs_datetime"], "scraped_at",
    )


@register("last_seen_upsert", """
SELECT 'Basin ' || user_id || CASE WHEN user_id % 10 = 0 THEN ' Sub-basin' ELSE '' END AS basin,
  CAST(ts AS DATE) AS date,
  CASE WHEN event_type = 'error' THEN 'Flood Watch' ELSE 'Non-Flood Watch' END AS status, ts AS scraped_at
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC) = 1""")
def last_seen_upsert(spark, folder):
    rows = views.alert_readings(spark, folder).select("basin", "date", "status", "scraped_at")
    morning = F.hour("scraped_at") < 12
    return keys.last_reading(rows.filter(morning), rows.filter(~morning), ["basin", "date"])


@register("priority_upsert", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, value AS rain_mm,
  CASE WHEN event_type IN ('view', 'click') THEN 'archive' ELSE 'forecast' END AS source, ts AS ingest_seq FROM events)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dam, date ORDER BY (source = 'archive') DESC, ingest_seq DESC) = 1""")
def priority_upsert(spark, folder):
    source = F.when(F.col("event_type").isin("view", "click"), "archive").otherwise("forecast")
    rows = views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("dam"), F.to_date("ts").alias("date"),
        F.col("value").alias("rain_mm"), source.alias("source"), F.col("ts").alias("ingest_seq"),
    )
    return keys.upsert(None, rows, ["dam", "date"], [(F.col("source") == "archive"), F.col("ingest_seq")])


@register("latest_lead_upsert", """
SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, CAST(hour(ts) // 4 + 1 AS INTEGER) AS lead, value AS rain_mm,
  ts AS ingest_seq
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), hour(ts) // 4 ORDER BY ts DESC) = 1""")
def latest_lead_upsert(spark, folder):
    rows = views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("dam"), F.to_date("ts").alias("date"),
        (F.floor(F.hour("ts") / 4) + 1).cast("int").alias("lead"), F.col("value").alias("rain_mm"),
        F.col("ts").alias("ingest_seq"),
    )
    purchases = F.col("rain_mm") > 50
    return keys.last_reading(rows.filter(purchases), rows.filter(~purchases), ["dam", "date", "lead"], "ingest_seq")


@register("union_sources", """
SELECT CAST(user_id AS VARCHAR) AS dam, ts AS obs_datetime, value AS rwl_m,
  CASE WHEN event_type = 'purchase' THEN 'wayback' ELSE 'live' END AS source,
  CASE WHEN event_type <> 'purchase' THEN event_id END AS capture_id FROM events""")
def union_sources(spark, folder):
    events = views.table(spark, folder, "events")
    columns = [F.col("user_id").cast("string").alias("dam"), F.col("ts").alias("obs_datetime"),
               F.col("value").alias("rwl_m")]
    archived = events.filter("event_type = 'purchase'").select(*columns, F.lit("wayback").alias("source"))
    live = events.filter("event_type <> 'purchase'").select(
        *columns, F.lit("live").alias("source"), F.col("event_id").alias("capture_id"))
    return keys.stack(live, archived)


@register("skip_recovered", """
WITH snaps AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS dam, date_trunc('hour', ts) AS h FROM events),
done AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS dam, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'signup')
SELECT dam, CAST(h AS TIMESTAMP) AS captured_at FROM (SELECT * FROM snaps EXCEPT SELECT * FROM done)""")
def skip_recovered(spark, folder):
    rows = _hourly_readings(spark, folder).withColumnRenamed("obs_datetime", "captured_at")
    snapshots = rows.select("dam", "captured_at").distinct()
    recovered = rows.filter(F.col("event_type") == "signup").select("dam", "captured_at")
    return keys.missing_from(snapshots, recovered, ["dam", "captured_at"])


@register("one_actual", f"""{with_ctes(DAILY)} SELECT dam, date, rwl_m FROM daily""")
def one_actual(spark, folder):
    from headwater.operators.ledger import one_actual as collapse
    from headwater.queries.common import reversion_table

    return collapse(reversion_table(spark, folder))
