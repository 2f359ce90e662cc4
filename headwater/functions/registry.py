"""Extension points: named column factories for baselines and feature sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import BASE_FEATURES, FEATURE_SETS

Factory = Callable[[], Column]

BASELINES: dict[str, Factory] = {}


def baseline(name: str):
    """Register a naive forecast; registration order breaks ties."""

    def register(factory: Factory) -> Factory:
        BASELINES[name] = factory
        return factory

    return register


@baseline("persistence")
def _persistence() -> Column:
    return F.lit(0.0)


@baseline("drift")
def _drift() -> Column:
    # An unknown change falls back to no change, for the forecast and for its
    # error alike, so that every contender is scored on the same rows.
    return F.coalesce(F.col("dev_24h_m") * F.col("horizon"), F.lit(0.0))


def with_baselines(df: DataFrame) -> DataFrame:
    return df.withColumns({name: make() for name, make in BASELINES.items()})


def with_errors(df: DataFrame, prediction: str = "model", actual: str = "actual") -> DataFrame:
    """Absolute errors of the model and of every baseline."""
    errors = {"abs_err_model": F.abs(F.col(prediction) - F.col(actual))}
    for name, make in BASELINES.items():
        errors[f"abs_err_{name}"] = F.abs(make() - F.col(actual))
    return df.withColumns(errors)


def feature_columns(name: str = "base", interactions: bool = False, stack: bool = False) -> list[str]:
    """Column names of a feature set, with its optional extras."""
    columns = list(FEATURE_SETS[name])
    if interactions:
        columns += ["rain_next_3d_x_h", "rain_next_7d_x_h", "wetness_x_fcst"]
    if stack:
        columns.append("base_drift")
    return columns


def with_interactions(df: DataFrame) -> DataFrame:
    """Products a linear model cannot form; NULL where an input is missing."""
    return df.withColumns(
        {
            "rain_next_3d_x_h": F.col("rain_next_3d") * F.col("horizon"),
            "rain_next_7d_x_h": F.col("rain_next_7d") * F.col("horizon"),
            "wetness_x_fcst": F.col("rain_next_7d") * F.log1p("rain_30d"),
        }
    )


def with_stacked_baseline(df: DataFrame) -> DataFrame:
    """Hand the learner the naive answer as an input."""
    return df.withColumn("base_drift", BASELINES["drift"]())


def feature_map(columns: Sequence[str] = BASE_FEATURES) -> Column:
    """The features a forecast saw, as a map without the missing ones.

    The entity is a flag of its own and the horizon a number.
    """
    names = [F.lit(c) for c in columns] + [F.concat(F.lit("dam="), F.col("dam")), F.lit("horizon")]
    values = [F.col(c).cast("double") for c in columns] + [F.lit(1.0), F.col("horizon").cast("double")]
    known = F.map_from_arrays(F.array(*names), F.array(*values))
    return F.map_filter(known, lambda _, v: v.isNotNull() & ~F.isnan(v))
