"""Column expressions that clean scraped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import MISSING_MARKERS
from headwater.operators.keys import assert_unique


def tidy(text: Column) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """Canonical entity name; labels without an alias keep their tidy form."""
    clean = tidy(name)
    pairs = [F.lit(part) for pair in aliases.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(clean)), clean)


def canonical_by_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """The same lookup against an alias table (label, canonical) of any size.

    A label that occurs twice there fails the job instead of repeating rows.
    """
    keyed = df.withColumn("_label", F.lower(tidy(F.col(column))))
    known = aliases.select(F.lower(tidy("label")).alias("_label"), F.col("canonical").alias("_name"))
    known = assert_unique(known.filter("_label is not null"), ["_label"], "aliases")
    return (
        keyed.join(known, "_label", "left")
        .withColumn(column, F.coalesce("_name", tidy(F.col(column))))
        .drop("_label", "_name")
    )


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def nan_free(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, also inside arrays of them."""
    out = {}
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            out[field.name] = nan_to_null(F.col(field.name))
        elif kind in ("array<double>", "array<float>"):
            out[field.name] = F.transform(field.name, nan_to_null)
    return df.withColumns(out) if out else df


def number(text: Column) -> Column:
    """Text to double; markers, blanks and unreadable text become NULL."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~bare.isin(*MISSING_MARKERS), nan_to_null(bare.try_cast("double")))


def zero_to_null(reference: Column) -> Column:
    """A reference elevation of zero means that none is defined."""
    return F.when(reference != 0, reference)


def blank_undefined_reference(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Null every zero reference, and the deviation measured against it."""
    out = {}
    for reference, deviation in pairs.items():
        defined = F.coalesce(F.col(reference) != 0, F.lit(False))
        out[reference] = F.when(defined, F.col(reference))
        out[deviation] = F.when(defined, F.col(deviation))
    return df.withColumns(out)


def month_day_to_date(month_day: Column, seen_at: Column) -> Column:
    """'Aug-07' and the time it was seen to a date.

    The year is that of the sighting, or the one before if the date would
    otherwise lie more than a day ahead of it. Unreadable text gives NULL.
    """
    stamped = F.concat(F.trim(month_day), F.lit("-"), F.year(seen_at).cast("string"))
    day = F.try_to_timestamp(stamped, F.lit("MMM-d-yyyy")).cast("date")
    ahead = day.cast("timestamp_ntz") > seen_at.cast("timestamp_ntz") + F.expr("interval 1 day")
    return F.when(ahead, F.add_months(day, -12)).otherwise(day)


def at_clock(day: Column, clock: Column) -> Column:
    """Date plus a clock text such as '08:00 am'; midnight if unreadable."""
    parsed = F.try_to_timestamp(F.upper(F.trim(clock)), F.lit("h:mm a"))
    hour, minute = F.coalesce(F.hour(parsed), F.lit(0)), F.coalesce(F.minute(parsed), F.lit(0))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def is_alert(status: Column) -> Column:
    """The quiet status contains the alert text, so test the prefix instead."""
    return ~F.lower(F.trim(status)).startswith("non")


def alert_kind(name: Column) -> Column:
    return F.when(F.lower(name).contains("sub-basin"), "dam_sub_basin").otherwise("river_basin")


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search, false for NULL."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def to_day(stamp: Column) -> Column:
    return F.to_date(stamp)


def iso_minute(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm")


def iso_second(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
