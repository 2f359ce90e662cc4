"""The modelling table over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.plans.features import modelling_table
from headwater.sources import views


def events_table(spark: SparkSession, folder: str, registered: bool = False) -> DataFrame:
    daily, weather, forecasts, alerts = views.roles_of(views.event_days(spark, folder))
    return modelling_table(daily, weather, forecasts, alerts, views.registry(spark, folder) if registered else None)
