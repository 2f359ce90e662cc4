"""Feature assembly: joins, lead windows, targets, the modelling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions.registry import feature_columns, feature_map, with_interactions, with_stacked_baseline
from headwater.operators import alerts, rain, series, targets
from headwater.operators.keys import join_one_to_one
from headwater.operators.search import split_tag
from headwater.plans.features import table_quality
from headwater.plans.roles import events_table
from headwater.queries.common import (
    ALERTS, CHANGE, DAILY, FEATURE_CTES, FORECASTS, LEAD_WINDOWS, REGISTRY, TARGETS, WEATHER,
    query_set, rounded, sql_round, with_ctes,
)
from headwater.sources import views

QUERIES, ORACLES, register = query_set()

MEASURES = (
    "rwl_m", "dev_24h_m", "nhwl_m", "dev_nhwl_m", "rule_curve_m", "dev_rule_curve_m", "inflow_cms", "outflow_cms",
    "precipitation_sum", "temperature_2m_mean", "temperature_2m_max", "relative_humidity_2m_mean",
    "et0_fao_evapotranspiration", "rain_1d", "rain_3d", "rain_7d", "rain_14d", "rain_30d", "rain_next_3d",
    "rain_next_7d", "era5_rain_next_3d", "era5_rain_next_7d", "fc_rain_next_3d", "fc_rain_next_7d",
    "doy_sin", "doy_cos", "rwl_future", "target_delta",
)


@register("feature_table", f"""{with_ctes(*FEATURE_CTES)}
SELECT dam, date, horizon, fcst_source, basins_on_watch, {sql_round(*MEASURES)} FROM model_table""")
def feature_table(spark, folder):
    return rounded(events_table(spark, folder)).select(
        "dam", "date", "horizon", "fcst_source", "basins_on_watch", *MEASURES)


@register("feature_table_registered", f"""{with_ctes(REGISTRY, *FEATURE_CTES)}
SELECT dam, date, horizon, fcst_source, {sql_round("rwl_m", "rain_7d", "rain_next_3d", "target_delta")} FROM model_table
WHERE dam IN (SELECT dam FROM registry) AND target_delta IS NOT NULL""")
def feature_table_registered(spark, folder):
    known = targets.labelled(events_table(spark, folder, registered=True))
    return rounded(known.select("dam", "date", "horizon", "fcst_source", "rwl_m", "rain_7d", "rain_next_3d", "target_delta"))


@register("table_qa", f"""{with_ctes(*FEATURE_CTES)}
SELECT horizon, count(*) AS n_rows, count(target_delta) AS labelled,
  count(*) FILTER (precipitation_sum IS NULL) AS without_weather FROM model_table GROUP BY horizon""")
def table_qa(spark, folder):
    return table_quality(events_table(spark, folder))


@register("weather_join", f"""{with_ctes(DAILY, WEATHER)}
SELECT d.dam, d.date, d.rwl_m, {sql_round("w.precipitation_sum", "w.temperature_2m_mean")}
FROM daily d LEFT JOIN weather w ON w.dam = d.dam AND w.date = d.date""")
def weather_join(spark, folder):
    weather = views.weather(spark, folder).select("dam", "date", "precipitation_sum", "temperature_2m_mean")
    return rounded(join_one_to_one(views.daily(spark, folder).select("dam", "date", "rwl_m"), weather, ["dam", "date"]))


@register("lead_rain_complete", f"""{with_ctes(DAILY, FORECASTS, LEAD_WINDOWS)}
SELECT dam, date, {sql_round("fc_rain_next_3d", "fc_rain_next_7d")} FROM lead_windows""")
def lead_rain_complete(spark, folder):
    return rounded(rain.lead_windows(views.forecasts(spark, folder)))


@register("coalesce_forecast", f"""{with_ctes(*FEATURE_CTES)}
SELECT dam, date, fcst_source, {sql_round("rain_next_3d", "rain_next_7d", "era5_rain_next_3d", "era5_rain_next_7d")} FROM base""")
def coalesce_forecast(spark, folder):
    daily = views.daily(spark, folder).select("dam", "date")
    observed = rain.weather_features(views.weather(spark, folder)).select("dam", "date", "rain_next_3d", "rain_next_7d")
    joined = daily.join(observed, ["dam", "date"], "left").join(
        rain.lead_windows(views.forecasts(spark, folder)), ["dam", "date"], "left")
    return rounded(rain.prefer_forecast(joined).drop("fc_rain_next_3d", "fc_rain_next_7d"))


@register("horizon_target", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT dam, date, horizon, label_date, {sql_round("rwl_m", "rwl_future", "target_delta")} FROM targets""")
def horizon_target(spark, folder):
    daily = views.daily(spark, folder).select("dam", "date", "rwl_m")
    return rounded(targets.with_label_date(targets.horizon_targets(daily)))


@register("labelled", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT horizon, count(*) AS n, round(sum(target_delta), 4) AS total FROM targets WHERE target_delta IS NOT NULL GROUP BY horizon""")
def labelled(spark, folder):
    table = targets.labelled(targets.horizon_targets(views.daily(spark, folder).select("dam", "date", "rwl_m")))
    return table.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("target_delta"), 4).alias("total"))


@register("order_targets", """
WITH daily AS (SELECT o_orderpriority AS dam, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS rwl_m FROM orders GROUP BY 1, 2)
SELECT d.dam, d.date, CAST(h.horizon AS INTEGER) AS horizon, round(d.rwl_m, 4) AS rwl_m, round(f.rwl_m, 4) AS rwl_future,
  round(f.rwl_m - d.rwl_m, 4) AS target_delta
FROM daily d CROSS JOIN range(1, 8) h(horizon) LEFT JOIN daily f ON f.dam = d.dam AND f.date = d.date + CAST(h.horizon AS INTEGER)""")
def order_targets(spark, folder):
    return rounded(targets.horizon_targets(views.order_series(spark, folder)), 4)


@register("alert_target", f"""{with_ctes(ALERTS)},
rivers AS (SELECT * FROM alerts WHERE kind = 'river_basin')
SELECT a.basin, a.date, CAST(h.horizon AS INTEGER) AS horizon, a.on_watch, CAST(f.on_watch AS INTEGER) AS target
FROM rivers a CROSS JOIN range(1, 4) h(horizon) JOIN rivers f ON f.basin = a.basin AND f.date = a.date + CAST(h.horizon AS INTEGER)""")
def alert_target(spark, folder):
    table = alerts.alert_targets(alerts.alert_features(views.alerts(spark, folder)))
    return table.select("basin", "date", "horizon", "on_watch", "target")


@register("alert_features", f"""{with_ctes(ALERTS)},
rivers AS (SELECT *, CAST(on_watch AS DOUBLE) AS watch_today FROM alerts WHERE kind = 'river_basin'),
islands AS (SELECT *, sum(CASE WHEN on_watch THEN 0 ELSE 1 END) OVER (PARTITION BY basin ORDER BY date) AS island FROM rivers)
SELECT i.basin, i.date, i.watch_today,
  round(avg(i.watch_today) OVER (PARTITION BY i.basin ORDER BY i.date ROWS 2 PRECEDING), 6) AS watch_3d,
  round(avg(i.watch_today) OVER (PARTITION BY i.basin ORDER BY i.date ROWS 6 PRECEDING), 6) AS watch_7d,
  CAST(row_number() OVER (PARTITION BY i.basin, island ORDER BY i.date) - 1 AS BIGINT) AS streak,
  round(n.national_share, 6) AS national_share
FROM islands i JOIN (SELECT date, avg(watch_today) AS national_share FROM rivers GROUP BY date) n ON n.date = i.date""")
def alert_features(spark, folder):
    table = alerts.alert_features(views.alerts(spark, folder))
    return rounded(table.select("basin", "date", "watch_today", "watch_3d", "watch_7d", "streak", "national_share"))


@register("daily_alert_count", f"""{with_ctes(ALERTS)}
SELECT date, count(*) FILTER (on_watch) AS basins_on_watch FROM alerts WHERE kind = 'river_basin' GROUP BY date""")
def daily_alert_count(spark, folder):
    return alerts.daily_alert_count(views.alerts(spark, folder))


@register("national_share", f"""{with_ctes(ALERTS)}
SELECT basin, a.date, on_watch, round(s.national_share, 6) AS national_share FROM alerts a
JOIN (SELECT date, avg(CASE WHEN on_watch THEN 1.0 ELSE 0.0 END) AS national_share FROM alerts GROUP BY date) s ON s.date = a.date""")
def national_share(spark, folder):
    states = views.alerts(spark, folder).select("basin", "date", "on_watch")
    return rounded(alerts.attach_daily(states, alerts.national_share(states)))


@register("feature_map", f"""{with_ctes(*FEATURE_CTES)},
long AS (UNPIVOT (SELECT dam, date, horizon, rwl_m, dev_24h_m, dev_rule_curve_m, dev_nhwl_m, rain_1d, rain_3d, rain_7d,
  rain_14d, rain_30d, rain_next_3d, rain_next_7d, temperature_2m_mean, et0_fao_evapotranspiration, doy_sin, doy_cos FROM model_table)
  ON COLUMNS(* EXCLUDE (dam, date, horizon)) INTO NAME feature VALUE v)
SELECT dam, date, horizon, CAST(count(*) + 2 AS INTEGER) AS n_features, round(sum(v) + 1 + horizon, 4) AS total
FROM long GROUP BY dam, date, horizon""")
def feature_maps(spark, folder):
    table = events_table(spark, folder).select("dam", "date", "horizon", feature_map().alias("features"))
    total = F.aggregate(F.map_values("features"), F.lit(0.0), lambda acc, v: acc + v)
    return table.select("dam", "date", "horizon", F.size("features").alias("n_features"), F.round(total, 4).alias("total"))


@register("interactions", f"""{with_ctes(*FEATURE_CTES)}
SELECT dam, date, horizon, round(rain_next_3d * horizon, 6) AS rain_next_3d_x_h, round(rain_next_7d * horizon, 6) AS rain_next_7d_x_h,
  round(rain_next_7d * ln(1 + rain_30d), 6) AS wetness_x_fcst, round(coalesce(dev_24h_m * horizon, 0), 6) AS base_drift FROM model_table""")
def interactions(spark, folder):
    table = with_stacked_baseline(with_interactions(events_table(spark, folder)))
    return rounded(table.select("dam", "date", "horizon", "rain_next_3d_x_h", "rain_next_7d_x_h", "wetness_x_fcst", "base_drift"))


@register("feature_sets", f"""{with_ctes(*FEATURE_CTES)}
SELECT horizon, count(*) AS n, count(dev_24h_m) + count(rain_3d) + count(rain_next_3d) + count(rain_next_7d) AS tiny_known,
  count(dev_24h_m) + count(dev_rule_curve_m) + count(rain_1d) + count(rain_3d) + count(rain_7d) + count(rain_next_3d)
    + count(rain_next_7d) + count(doy_sin) + count(doy_cos) AS lean_known
FROM model_table GROUP BY horizon""")
def feature_sets(spark, folder):
    def known(name):
        return sum((F.count(c) for c in feature_columns(name)), F.lit(0))

    return events_table(spark, folder).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), known("tiny").cast("long").alias("tiny_known"), known("lean").cast("long").alias("lean_known"))


@register("split_tag", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT horizon, CASE WHEN date >= DATE '2024-01-21' THEN 'holdout' ELSE 'dev' END AS split, count(*) AS n, count(target_delta) AS labelled
FROM targets GROUP BY 1, 2""")
def split_tags(spark, folder):
    table = targets.horizon_targets(views.daily(spark, folder).select("dam", "date", "rwl_m"))
    return split_tag(table, "2024-01-21").groupBy("horizon", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count("target_delta").alias("labelled"))


@register("hourly_to_daily", """
SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, CAST(hour(ts) // 4 + 1 AS INTEGER) AS lead,
  round(sum(value) FILTER (event_type <> 'error'), 4) AS rain_mm
FROM events GROUP BY 1, 2, 3 HAVING sum(value) FILTER (event_type <> 'error') IS NOT NULL""")
def hourly_to_daily(spark, folder):
    hourly = views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("dam"), F.col("ts").alias("time"),
        (F.floor(F.hour("ts") / 4) + 1).cast("int").alias("lead"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("rain_mm"))
    return rounded(rain.hourly_to_daily(hourly), 4)


@register("point_mean", """
SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, round(avg(value), 6) AS precipitation_sum,
  round(avg(event_id), 4) AS temperature_2m_mean, CAST(count(DISTINCT event_type) AS INTEGER) AS n_points
FROM events GROUP BY 1, 2""")
def point_mean(spark, folder):
    points = views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("dam"), F.to_date("ts").alias("date"), F.col("event_type").alias("point"),
        F.col("value").alias("precipitation_sum"), F.col("event_id").alias("temperature_2m_mean"))
    means = rain.point_mean(points, ("precipitation_sum", "temperature_2m_mean"))
    return means.withColumns({
        "precipitation_sum": F.round("precipitation_sum", 6), "temperature_2m_mean": F.round("temperature_2m_mean", 4)})


@register("densified_levels", f"""{with_ctes(DAILY)},
calendar AS (SELECT dam, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY dam)
SELECT dam, date, rwl_m FROM calendar LEFT JOIN daily USING (dam, date)""")
def densified_levels(spark, folder):
    return series.densify(views.daily(spark, folder).select("dam", "date", "rwl_m"))


@register("sorted_targets", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT date, dam, horizon, round(target_delta, 6) AS target_delta FROM targets WHERE target_delta IS NOT NULL ORDER BY date, dam, horizon""")
def sorted_targets(spark, folder):
    table = targets.labelled(targets.horizon_targets(views.daily(spark, folder).select("dam", "date", "rwl_m")))
    return rounded(table.select("date", "dam", "horizon", "target_delta")).orderBy("date", "dam", "horizon")
