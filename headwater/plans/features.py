"""The modelling table: one row per entity, issue date and horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.numeric import seasonal
from headwater.operators.alerts import attach_daily, daily_alert_count
from headwater.operators.keys import assert_unique
from headwater.operators.rain import lead_windows, prefer_forecast, weather_features
from headwater.operators.series import consecutive_change
from headwater.operators.targets import fan_out, future_levels


def base_table(daily: DataFrame, weather: DataFrame, forecasts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Features per entity and issue date, before the horizons fan out.

    `daily` holds one level per entity and day and keys each source by
    (dam, date). Levels and weather are windowed by entity first; their join and
    the one with the forecasts then reuse that partitioning.
    """
    levels = future_levels(consecutive_change(daily))
    rain = weather_features(assert_unique(weather, ["dam", "date"], "weather"))
    table = levels.join(rain, ["dam", "date"], "left")
    table = prefer_forecast(table.join(lead_windows(forecasts), ["dam", "date"], "left"))
    table = attach_daily(table, daily_alert_count(alerts))
    sin, cos = seasonal(F.col("date"))
    return table.withColumns({"doy_sin": sin, "doy_cos": cos})


def modelling_table(daily: DataFrame, weather: DataFrame, forecasts: DataFrame, alerts: DataFrame,
                    registry: DataFrame | None = None) -> DataFrame:
    """The full table, restricted to known entities where a registry is given."""
    table = base_table(daily, weather, forecasts, alerts)
    if registry is not None:
        table = table.join(registry.select("dam"), "dam", "left_semi")
    return fan_out(table)


def table_quality(table: DataFrame) -> DataFrame:
    """Row counts per horizon: all, labelled, and without weather."""
    return table.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("target_delta").alias("labelled"),
        F.count_if(F.col("precipitation_sum").isNull()).alias("without_weather"),
    )
