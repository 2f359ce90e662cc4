"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.functions.registry import with_errors
from headwater.operators.series import consecutive_change, rows_of
from headwater.operators.targets import horizon_targets, with_label_date
from headwater.sources import views

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, places) for c in doubles}) if doubles else df


def sql_round(*columns: str, places: int = PLACES) -> str:
    """Select list of rounded columns; 'a.b' keeps the name b."""
    return ", ".join(f"round({c}, {places}) AS {c.split('.')[-1]}" for c in columns)


def reversion_table(spark: SparkSession, folder: str) -> DataFrame:
    """Targets with a forecast plain SQL can state: back to the mean level so far."""
    daily = consecutive_change(views.daily(spark, folder))
    so_far = rows_of("dam").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("model", F.avg("rwl_m").over(so_far) - F.col("rwl_m"))
    return with_label_date(horizon_targets(daily))


def reversion_errors(spark: SparkSession, folder: str) -> DataFrame:
    table = reversion_table(spark, folder).filter(F.col("target_delta").isNotNull())
    return with_errors(table.withColumn("actual", F.col("target_delta")))


def query_set():
    """Two dicts and a decorator that fills them."""
    queries, oracles = {}, {}

    def register(name: str, sql: str | None = None):
        def keep(function):
            queries[name] = function
            if sql is not None:
                oracles[name] = sql
            return function

        return keep

    return queries, oracles, register


REFS = """refs AS (
  SELECT CAST(user_id AS VARCHAR) AS dam,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE avg(value) + 1.5 * stddev_pop(value) END AS nhwl_m,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE avg(value) + 0.5 * stddev_pop(value) END AS rule_curve_m
  FROM events GROUP BY user_id)"""

DAILY = """daily AS (
  SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date,
    arg_min(value, ts) AS rwl_m,
    arg_min(CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE), ts) AS inflow_cms
  FROM events GROUP BY 1, 2)"""

CHANGE = """changed AS (
  SELECT d.*, d.rwl_m - p.rwl_m AS dev_24h_m
  FROM daily d LEFT JOIN daily p ON p.dam = d.dam AND p.date = d.date - 1)"""

TARGETS = """targets AS (
  SELECT c.*, CAST(h.horizon AS INTEGER) AS horizon, f.rwl_m AS rwl_future,
    f.rwl_m - c.rwl_m AS target_delta, c.date + CAST(h.horizon AS INTEGER) AS label_date
  FROM changed c CROSS JOIN range(1, 8) h(horizon)
  LEFT JOIN daily f ON f.dam = c.dam AND f.date = c.date + CAST(h.horizon AS INTEGER))"""

REVERSION = """reversion AS (
  SELECT t.*, m.mean_so_far - t.rwl_m AS model FROM targets t
  JOIN (SELECT a.dam, a.date, avg(b.rwl_m) AS mean_so_far FROM daily a
        JOIN daily b ON b.dam = a.dam AND b.date <= a.date GROUP BY 1, 2) m USING (dam, date))"""

ERRORS = """errors AS (
  SELECT dam, date, horizon, label_date, model, dev_24h_m, target_delta AS actual,
    coalesce(dev_24h_m * horizon, 0) AS drift,
    abs(model - target_delta) AS abs_err_model, abs(target_delta) AS abs_err_persistence,
    abs(coalesce(dev_24h_m * horizon, 0) - target_delta) AS abs_err_drift
  FROM reversion WHERE target_delta IS NOT NULL)"""

WEATHER = """observed AS (
  SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date,
    sum(value) FILTER (event_type IN ('view', 'click')) AS precipitation_sum,
    avg(value) AS temperature_2m_mean, max(value) AS temperature_2m_max,
    avg(CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE)) AS relative_humidity_2m_mean,
    min(value) AS et0_fao_evapotranspiration
  FROM events GROUP BY 1, 2),
calendar AS (
  SELECT dam, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM observed GROUP BY dam),
weather AS (SELECT * FROM calendar LEFT JOIN observed USING (dam, date))"""

FORECASTS = """forecasts AS (
  SELECT d.dam, d.date + CAST(l.lead AS INTEGER) AS date, CAST(l.lead AS INTEGER) AS lead,
    d.rwl_m / (l.lead + 1) AS rain_mm
  FROM daily d, range(1, 8) l(lead)
  WHERE l.lead <= floor(d.inflow_cms / 10) + 1)"""

LEAD_WINDOWS = """lead_windows AS (
  SELECT coalesce(a.dam, b.dam) AS dam, coalesce(a.date, b.date) AS date, fc_rain_next_3d, fc_rain_next_7d
  FROM (SELECT dam, date - lead AS date, sum(rain_mm) AS fc_rain_next_3d FROM forecasts WHERE lead <= 3
        GROUP BY 1, 2 HAVING count(DISTINCT lead) = 3) a
  FULL JOIN (SELECT dam, date - lead AS date, sum(rain_mm) AS fc_rain_next_7d FROM forecasts WHERE lead <= 7
        GROUP BY 1, 2 HAVING count(DISTINCT lead) = 7) b ON a.dam = b.dam AND a.date = b.date)"""

ALERTS = """alerts AS (
  SELECT 'Basin ' || user_id || CASE WHEN user_id % 10 = 0 THEN ' Sub-basin' ELSE '' END AS basin,
    CASE WHEN user_id % 10 = 0 THEN 'dam_sub_basin' ELSE 'river_basin' END AS kind,
    CAST(ts AS DATE) AS date, bool_or(event_type = 'error') AS on_watch, max(ts) AS scraped_at
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

REGISTRY = """registry AS (
  SELECT CAST(c_custkey AS VARCHAR) AS dam, CAST(n_nationkey * 2.5 - 30 AS DOUBLE) AS lat, CAST(n_nationkey * 10.0 - 120 AS DOUBLE) AS lon,
    n_name AS basin
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ROLLED_WEATHER = """rolled AS (
  SELECT *,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS 0 PRECEDING) AS rain_1d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS 2 PRECEDING) AS rain_3d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS 6 PRECEDING) AS rain_7d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS 13 PRECEDING) AS rain_14d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS 29 PRECEDING) AS rain_30d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rain_next_3d,
    sum(precipitation_sum) OVER (PARTITION BY dam ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS rain_next_7d
  FROM weather)"""

BASE = """base AS (
  SELECT c.*, c.inflow_cms / 2 AS outflow_cms, r.nhwl_m, r.rule_curve_m,
    c.rwl_m - r.nhwl_m AS dev_nhwl_m, c.rwl_m - r.rule_curve_m AS dev_rule_curve_m,
    w.* EXCLUDE (dam, date, rain_next_3d, rain_next_7d),
    w.rain_next_3d AS era5_rain_next_3d, w.rain_next_7d AS era5_rain_next_7d,
    coalesce(l.fc_rain_next_3d, w.rain_next_3d) AS rain_next_3d,
    coalesce(l.fc_rain_next_7d, w.rain_next_7d) AS rain_next_7d,
    l.fc_rain_next_3d, l.fc_rain_next_7d,
    CASE WHEN l.fc_rain_next_7d IS NOT NULL THEN 'forecast' ELSE 'era5_proxy' END AS fcst_source,
    a.basins_on_watch,
    sin(2 * pi() * dayofyear(c.date) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(c.date) / 365.25) AS doy_cos
  FROM changed c LEFT JOIN refs r USING (dam) LEFT JOIN rolled w ON w.dam = c.dam AND w.date = c.date
  LEFT JOIN lead_windows l ON l.dam = c.dam AND l.date = c.date
  LEFT JOIN (SELECT date, count(*) FILTER (on_watch) AS basins_on_watch FROM alerts
             WHERE kind = 'river_basin' GROUP BY date) a ON a.date = c.date)"""

MODEL_TABLE = """model_table AS (
  SELECT b.*, CAST(h.horizon AS INTEGER) AS horizon, f.rwl_m AS rwl_future,
    f.rwl_m - b.rwl_m AS target_delta, b.date + CAST(h.horizon AS INTEGER) AS label_date
  FROM base b CROSS JOIN range(1, 8) h(horizon)
  LEFT JOIN daily f ON f.dam = b.dam AND f.date = b.date + CAST(h.horizon AS INTEGER))"""

FEATURE_CTES = (REFS, DAILY, CHANGE, WEATHER, ROLLED_WEATHER, FORECASTS, LEAD_WINDOWS, ALERTS, BASE, MODEL_TABLE)
ERROR_CTES = (DAILY, CHANGE, TARGETS, REVERSION, ERRORS)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
