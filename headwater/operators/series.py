"""Windows over one entity's series.

Series are daily before any window sees them, so the rows of an entity, and with
them each window partition, are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.constants import BACKWARD_WINDOWS, CURVE_WINDOW, FORWARD_WINDOWS


def rows_of(entity: str | Sequence[str], order: str = "date"):
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(order)


def daily_first(observations: DataFrame, entity: str = "dam", stamp: str = "obs_datetime") -> DataFrame:
    """One row per entity and day: its earliest reading.

    (entity, stamp) is the key of the observations, so the stamp decides alone.
    Each value has its own primitive min_by: the plan stays a hash aggregate
    with map-side reduction, where a struct would force a sort of all readings.
    """
    values = [c for c in observations.columns if c not in (entity, stamp)]
    return (
        observations.groupBy(entity, F.to_date(stamp).alias("date"))
        .agg(*[F.min_by(c, stamp).alias(c) for c in values])
    )


def value_at(column: str, days: int, entity: str = "dam", date: str = "date") -> Column:
    """The value exactly `days` calendar days away, NULL if unobserved.

    A range frame of one day over a table that is unique per (entity, date): it
    shares the shuffle and sort of every other window on the entity, where a
    self join would shuffle the table once more.
    """
    by_day = Window.partitionBy(entity).orderBy(F.unix_date(date).cast("long"))
    return F.max(column).over(by_day.rangeBetween(days, days))


def consecutive_change(daily: DataFrame, value: str = "rwl_m", name: str = "dev_24h_m") -> DataFrame:
    """Change from the previous calendar day, only where that day was observed."""
    return daily.withColumn(name, F.col(value) - value_at(value, -1))


def with_previous_reading(daily: DataFrame, value: str = "rwl_m") -> DataFrame:
    """Previous observed value and its date, however long ago."""
    w = rows_of("dam")
    return daily.withColumns(
        {f"prev_{value}": F.lag(value).over(w), "prev_date": F.lag("date").over(w)}
    )


def backward_sums(df: DataFrame, value: str, windows: Sequence[int] = BACKWARD_WINDOWS,
                  prefix: str = "rain", entity: str = "dam") -> DataFrame:
    """Sums over the last n rows including the current one."""
    w = rows_of(entity)
    return df.withColumns(
        {f"{prefix}_{n}d": F.sum(value).over(w.rowsBetween(-(n - 1), 0)) for n in windows}
    )


def forward_sums(df: DataFrame, value: str, windows: Sequence[int] = FORWARD_WINDOWS,
                 prefix: str = "rain_next", entity: str = "dam", short_head: bool = False) -> DataFrame:
    """Sums over the next n rows, the current one excluded.

    `short_head` reproduces a shift-then-roll: the first n-1 rows of an entity
    see only the far end of their window.
    """
    w = rows_of(entity)
    if not short_head:
        return df.withColumns(
            {f"{prefix}_{n}d": F.sum(value).over(w.rowsBetween(1, n)) for n in windows}
        )
    for n in windows:
        df = df.withColumn("_ahead", F.lead(value, n).over(w))
        df = df.withColumn(f"{prefix}_{n}d", F.sum("_ahead").over(w.rowsBetween(-(n - 1), 0)))
    return df.drop("_ahead")


def rolling_mean(df: DataFrame, columns: Sequence[str], window: int = CURVE_WINDOW, minimum: int = 1,
                 partition: Sequence[str] = (), order: str = "date", prefix: str = "roll_") -> DataFrame:
    """Rolling means over rows, NULL below a minimum of known values.

    Without a partition the input must already be one row per date.
    """
    keys = [F.col(c) for c in partition] or [F.lit(1)]
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumns(
        {f"{prefix}{c}": F.when(F.count(c).over(frame) >= minimum, F.avg(c).over(frame)) for c in columns}
    )


def streak(df: DataFrame, flag: str, entity: str, name: str = "streak", leading_from_one: bool = False) -> DataFrame:
    """Rows since the flag was last false.

    A series that starts true counts from 0, and from 1 with the option; a run
    after a false row always counts from 1.
    """
    w = rows_of(entity)
    numbered = df.withColumn("_row", F.row_number().over(w).cast("long"))
    last_false = F.max(F.when(~F.col(flag), F.col("_row"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.coalesce(last_false, F.lit(0 if leading_from_one else 1))
    return numbered.withColumn(name, F.col("_row") - start).drop("_row")


def densify(df: DataFrame, entity: str = "dam", date: str = "date") -> DataFrame:
    """A row for every day between an entity's first and last, values NULL in gaps."""
    span = df.groupBy(entity).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    calendar = span.select(entity, F.explode(F.sequence("_from", "_to")).alias(date))
    return calendar.join(df, [entity, date], "left")
