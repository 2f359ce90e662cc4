"""Risk classes and out-of-range flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwater.constants import NORMAL, NOT_RATED, RISK_NOTES, SPILL_WATCH, WATCH
from headwater.functions.clean import nan_to_null


def risk_of_peak(peak: Column, high_water: Column, rule_curve: Column) -> Column:
    """Class of the highest forecast level; a missing reference cannot be crossed."""
    peak, high_water, rule_curve = (nan_to_null(c) for c in (peak, high_water, rule_curve))
    return (
        F.when(peak.isNull(), NOT_RATED)
        .when(peak >= high_water, SPILL_WATCH)
        .when(peak >= rule_curve, WATCH)
        .when(high_water.isNull() & rule_curve.isNull(), NOT_RATED)
        .otherwise(NORMAL)
    )


def risk_of_levels(levels: Column, high_water: Column, rule_curve: Column) -> Column:
    """The same from an array of forecast levels, which may hold gaps."""
    usable = F.filter(levels, lambda v: v.isNotNull() & ~F.isnan(v))
    return risk_of_peak(F.array_max(usable), high_water, rule_curve)


def risk_note(label: Column) -> Column:
    pairs = [F.lit(part) for pair in RISK_NOTES.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), label)


def beyond(value: Column, largest_seen: Column) -> Column:
    """True if a value exceeds everything seen so far; false without a past."""
    return F.coalesce(value > largest_seen, F.lit(False))
