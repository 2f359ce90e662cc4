"""Nested service payloads to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import DAILY_VARIABLES, LEADS
from headwater.operators.rain import hourly_to_daily

DAILY_SCHEMA = (
    "array<struct<daily: struct<time: array<string>, "
    + ", ".join(f"{v}: array<double>" for v in DAILY_VARIABLES) + ">>>"
)
HOURLY_SCHEMA = (
    "struct<hourly: struct<time: array<string>, "
    + ", ".join(f"precipitation_previous_day{n}: array<double>" for n in LEADS) + ">>"
)


def _zipped(struct: str, names) -> Column:
    """Rows of parallel arrays; an array the payload lacks yields NULLs."""
    empty = F.array().cast("array<double>")
    return F.explode(F.arrays_zip(
        F.col(f"{struct}.time").alias("time"),
        *[F.coalesce(F.col(f"{struct}.{n}"), empty).alias(n) for n in names]))


def weather_rows(payloads: DataFrame) -> DataFrame:
    """(dam, source, payload) to daily means over the sampled points.

    A payload is a list with one struct of arrays per point, or a single one.
    """
    text = F.trim("payload")
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    points = payloads.withColumn("_p", F.from_json(listed, DAILY_SCHEMA)).withColumn("n_points", F.size("_p"))
    series = points.select("dam", "source", "n_points", F.explode("_p.daily").alias("d"))
    days = series.select("dam", "source", "n_points", _zipped("d", DAILY_VARIABLES).alias("at"))
    rows = days.select("dam", "source", "n_points", F.to_date("at.time").alias("date"),
                       *[F.col(f"at.{v}").alias(v) for v in DAILY_VARIABLES])
    return rows.groupBy("dam", "date", "source").agg(
        *[F.avg(v).alias(v) for v in DAILY_VARIABLES], F.max("n_points").alias("n_points"))


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """(dam, payload) with one hourly array per lead to (dam, date, lead, rain_mm)."""
    names = [f"precipitation_previous_day{n}" for n in LEADS]
    hours = payloads.withColumn("_h", F.from_json("payload", HOURLY_SCHEMA)["hourly"]).select(
        "dam", _zipped("_h", names).alias("at"))
    wide = hours.select("dam", F.to_timestamp_ntz("at.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("time"),
                        *[F.col(f"at.{n}").alias(n) for n in names])
    long = wide.unpivot(["dam", "time"], names, "variable", "rain_mm")
    lead = F.regexp_extract("variable", r"(\d+)$", 1).cast("int")
    return hourly_to_daily(long.withColumn("lead", lead))


def snapshot_index(listings: DataFrame) -> DataFrame:
    """(site, payload) listings, a header and then stamps, to one stamp per day."""
    rows = listings.select("site", F.posexplode(F.from_json("payload", "array<array<string>>")).alias("pos", "row"))
    stamps = rows.filter("pos > 0").select(
        "site", F.to_timestamp_ntz(F.col("row")[0], F.lit("yyyyMMddHHmmss")).alias("captured_at"))
    return stamps.groupBy("site", F.to_date("captured_at").alias("date")).agg(F.min("captured_at").alias("captured_at"))
