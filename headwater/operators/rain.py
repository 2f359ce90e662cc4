"""Weather and lead-time rain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.constants import DAILY_VARIABLES, FORWARD_WINDOWS
from headwater.operators.series import backward_sums, forward_sums


def point_mean(points: DataFrame, variables: Sequence[str] = DAILY_VARIABLES) -> DataFrame:
    """Mean over an entity's sampled points per day, and how many there were."""
    return points.groupBy("dam", "date").agg(
        *[F.avg(v).alias(v) for v in variables],
        F.count_distinct("point").cast("int").alias("n_points"),
    )


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """Sum (dam, time, lead, rain_mm) per day; days without any value vanish."""
    return (
        hourly.groupBy("dam", F.to_date("time").alias("date"), "lead")
        .agg(F.sum("rain_mm").alias("rain_mm"))
        .filter(F.col("rain_mm").isNotNull())
    )


def weather_features(weather: DataFrame) -> DataFrame:
    """Rain already fallen and rain still to come, per entity and day."""
    fallen = backward_sums(weather, "precipitation_sum")
    return forward_sums(fallen, "precipitation_sum")


def lead_windows(forecasts: DataFrame, windows: Sequence[int] = FORWARD_WINDOWS) -> DataFrame:
    """Rain forecast for the days after each issue date, complete windows only.

    Both windows come from one aggregate. Distinct leads are bits of an integer,
    which keeps the aggregate partial before the shuffle.
    """
    issued = forecasts.withColumn("issue", F.date_sub("date", F.col("lead").cast("int")))
    aggregates = []
    for n in windows:
        inside = F.col("lead") <= n
        bit = F.expr(f"CASE WHEN lead <= {n} THEN shiftleft(1, CAST(lead AS INT)) ELSE 0 END")
        total = F.sum(F.when(inside, F.col("rain_mm")))
        complete = F.bit_count(F.bit_or(bit)) == n
        aggregates.append(F.when(complete, total).alias(f"fc_rain_next_{n}d"))
    columns = [f"fc_rain_next_{n}d" for n in windows]
    return (
        issued.groupBy("dam", F.col("issue").alias("date"))
        .agg(*aggregates)
        .filter(F.coalesce(*columns).isNotNull())
    )


def prefer_forecast(df: DataFrame, windows: Sequence[int] = FORWARD_WINDOWS) -> DataFrame:
    """Use forecast rain where it exists and keep the observed copy.

    Each window falls back on its own, while the provenance flag follows the
    longest window alone.
    """
    longest = F.col(f"fc_rain_next_{max(windows)}d")
    out = {"fcst_source": F.when(longest.isNotNull(), "forecast").otherwise("era5_proxy")}
    for n in windows:
        observed = F.col(f"rain_next_{n}d")
        out[f"era5_rain_next_{n}d"] = observed
        out[f"rain_next_{n}d"] = F.coalesce(F.col(f"fc_rain_next_{n}d"), observed)
    return df.withColumns(out)
