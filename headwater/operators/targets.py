"""Horizon fan-out and time-shifted targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.constants import HORIZONS
from headwater.operators.series import value_at


def future_levels(daily: DataFrame, horizons: Sequence[int] = HORIZONS, value: str = "rwl_m") -> DataFrame:
    """Add an array with the level `h` calendar days ahead for every horizon.

    All horizons ride on the shuffle of the entity windows; rows multiply only
    afterwards, when no further shuffle needs them.
    """
    ahead = [
        F.struct(F.lit(h).alias("horizon"), value_at(value, h).alias("rwl_future")) for h in horizons
    ]
    return daily.withColumn("ahead", F.array(*ahead))


def fan_out(df: DataFrame, value: str = "rwl_m") -> DataFrame:
    """One row per horizon, with target level and target change."""
    return (
        df.withColumn("_at", F.explode("ahead"))
        .drop("ahead")
        .withColumn("horizon", F.col("_at.horizon"))
        .withColumn("rwl_future", F.col("_at.rwl_future"))
        .drop("_at")
        .withColumn("target_delta", F.col("rwl_future") - F.col(value))
    )


def horizon_targets(daily: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return fan_out(future_levels(daily, horizons))


def labelled(table: DataFrame) -> DataFrame:
    return table.filter(F.col("target_delta").isNotNull())


def with_label_date(table: DataFrame) -> DataFrame:
    """The day on which a row's target becomes known."""
    return table.withColumn("label_date", F.date_add("date", F.col("horizon").cast("int")))
