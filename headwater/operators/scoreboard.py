"""Errors to scoreboards, curves and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import CURVE_MIN_BACKTEST, CURVE_WINDOW, MIN_SCORED
from headwater.functions.numeric import published
from headwater.functions.registry import BASELINES
from headwater.operators.series import rolling_mean


def best_baseline(prefix: str = "mae_") -> Column:
    """Smallest baseline error as (mae, ordinal, name); ties go to the one
    registered first."""
    entries = [
        F.struct(F.col(f"{prefix}{name}").alias("mae"), F.lit(i).alias("ordinal"), F.lit(name).alias("name"))
        for i, name in enumerate(BASELINES)
    ]
    return F.array_min(F.filter(F.array(*entries), lambda e: e.mae.isNotNull()))


def scoreboard(errors: DataFrame, gate: int = MIN_SCORED, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Mean absolute errors per horizon, and whether the model may claim a win.

    A win needs the sample gate and a strictly smaller error than the best
    baseline.
    """
    names = ["model", *BASELINES]
    table = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"abs_err_{n}").alias(f"mae_{n}") for n in names]
    )
    rounded = table.withColumns({f"mae_{n}": published(f"mae_{n}") for n in names})
    best = rounded.withColumn("_best", best_baseline())
    enough = F.col("n") >= gate
    return (
        best.withColumns(
            {
                "enough_data": enough,
                "min_scored": F.lit(gate).cast("long"),
                "best_baseline": F.col("_best.name"),
                "mae_best_baseline": F.col("_best.mae"),
            }
        )
        .withColumn("beats_baseline", enough & (F.col("mae_model") < F.col("mae_best_baseline")))
        .drop("_best")
    )


def by_source(errors: DataFrame) -> DataFrame:
    """Error and count per provenance of the forward rain."""
    return errors.groupBy("fcst_source").agg(
        F.avg("abs_err_model").alias("mae_model"), F.count(F.lit(1)).alias("n")
    )


def learning_curve(errors: DataFrame, date: str = "date", window: int = CURVE_WINDOW,
                   minimum: int = CURVE_MIN_BACKTEST) -> DataFrame:
    """Daily mean errors and their rolling means.

    The window without a partition sees one row per calendar day only.
    """
    columns = ["abs_err_model", "abs_err_persistence"]
    daily = errors.groupBy(date).agg(*[F.avg(c).alias(c) for c in columns])
    return rolling_mean(daily, columns, window, minimum, order=date)


def with_verdicts(board: DataFrame) -> DataFrame:
    """A sentence per horizon that follows from the counts."""
    ahead = F.col("mae_model") < F.col("mae_best_baseline")
    need = (F.col("min_scored") - F.col("n")).cast("string")
    verdict = (
        F.when(F.col("enough_data") & ahead, "model wins")
        .when(F.col("enough_data"), "baseline wins")
        .when(ahead, F.concat(F.lit("ahead, needs "), need, F.lit(" more")))
        .otherwise(F.concat(F.lit("behind, needs "), need, F.lit(" more")))
    )
    return board.withColumns({"ahead": ahead, "verdict": verdict})


def rollup(board: DataFrame) -> DataFrame:
    """Which horizons are certified, provisional or lost, and what may be claimed.

    A board holds one row per horizon, so the lists stay short.
    """
    judged = with_verdicts(board)
    ahead, enough = F.col("ahead"), F.col("enough_data")

    def horizons(condition: Column, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("horizon")))).alias(name)

    lists = judged.agg(
        horizons(ahead & enough, "certified"),
        horizons(ahead, "ahead_all"),
        horizons(ahead & ~enough, "provisional"),
        horizons(~ahead, "losing"),
        horizons(F.col("beats_baseline"), "winning"),
        horizons(~enough, "thin"),
        F.min(F.when(ahead & ~enough, F.col("min_scored") - F.col("n"))).alias("next_needs"),
        F.count(F.lit(1)).alias("n_horizons"),
    )
    claim = (
        F.when(F.size("certified") == F.col("n_horizons"), "all horizons certified")
        .when((F.size("ahead_all") > 0) & (F.size("losing") == 0), "ahead everywhere, still counting")
        .otherwise("ahead at some horizons")
    )
    return lists.withColumn("claim", claim)


def fallback_curve(live: DataFrame, backtest: DataFrame) -> DataFrame:
    """The live curve if it has any row, else the backtest's."""
    columns = [
        "target_date", "abs_err_model", "abs_err_persistence",
        "roll_abs_err_model", "roll_abs_err_persistence",
    ]
    both = live.select(*columns, F.lit(1).alias("priority")).unionByName(
        backtest.withColumnRenamed("date", "target_date").select(*columns, F.lit(0).alias("priority"))
    )
    best = both.agg(F.max("priority")).scalar()
    return both.filter(F.col("priority") == best).drop("priority")
