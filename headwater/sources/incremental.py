"""What to read next: trailing ranges and request plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import FORECAST_CHUNK_DAYS, WEATHER_ARCHIVE_LAG_DAYS, WEATHER_TRAILING_DAYS


def trailing(df: DataFrame, days: int, date: str = "date") -> DataFrame:
    """Rows of the last days; the bound is a scalar subquery, so a table that is
    partitioned by date is pruned by it."""
    return df.filter(F.col(date) >= df.agg(F.date_sub(F.max(date), days)).scalar())


def next_range(stored: DataFrame | None, trailing_days: int, backfill_from: Column, until: Column,
               entities: DataFrame, date: str = "date") -> DataFrame:
    """The date range to request per entity.

    With a store, the trailing days before its newest date, never before the
    start of the backfill; without one, the full history.
    """
    if stored is None:
        start = backfill_from
    else:
        newest = stored.agg(F.date_sub(F.max(date), trailing_days)).scalar()
        start = F.greatest(backfill_from, F.coalesce(newest, backfill_from))
    return entities.select("dam", start.alias("start_date"), until.alias("end_date"))


def archive_range(entities: DataFrame, today: Column, backfill_from: Column, stored: bool) -> DataFrame:
    """The archive's range to request per entity, up to the newest day that it has.

    Entities that are stored ask for the trailing days again, in which provisional
    rows are replaced as the archive catches up; the others for the full history.
    """
    start = F.date_sub(today, WEATHER_TRAILING_DAYS) if stored else backfill_from
    return entities.select(
        "dam", start.alias("start_date"), F.date_sub(today, WEATHER_ARCHIVE_LAG_DAYS).alias("end_date"))


def by_year(spans: DataFrame) -> DataFrame:
    """Split each (start_date, end_date) at calendar years; an empty range gives none."""
    first = F.make_date(F.year("start_date"), F.lit(1), F.lit(1))
    january = F.explode(F.when(
        F.col("start_date") <= F.col("end_date"), F.sequence(first, F.col("end_date"), F.expr("interval 1 year"))))
    years = spans.withColumn("_jan", january)
    december = F.make_date(F.year("_jan"), F.lit(12), F.lit(31))
    return years.select(
        "dam", F.greatest("start_date", "_jan").alias("start_date"), F.least("end_date", december).alias("end_date")
    )


def by_days(spans: DataFrame, days: int = FORECAST_CHUNK_DAYS) -> DataFrame:
    """Split each (start_date, end_date) into ranges of a number of days; an empty range gives none."""
    step = F.make_dt_interval(F.lit(days))
    starts = F.when(F.col("start_date") <= F.col("end_date"), F.sequence(F.col("start_date"), F.col("end_date"), step))
    chunks = spans.withColumn("_s", F.explode(starts))
    return chunks.select(
        "dam", F.col("_s").alias("start_date"), F.least("end_date", F.date_add("_s", days - 1)).alias("end_date")
    )
