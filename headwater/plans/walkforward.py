"""Walk-forward learners: trees refitted at each calendar block, alert chances for every day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import ALERT_FEATURES, FOREST_SEED, FOREST_TREES
from headwater.functions.numeric import at_least_half, finite_or_zero
from headwater.operators.causal import scaled_target, unscaled
from headwater.operators.reweighted import STEPS, logistic
from headwater.operators.trees import Trees, walk
from headwater.session import materialise

# Families of the search by name.
ESTIMATORS: dict[str, Trees] = {
    "tree": Trees(seed=FOREST_SEED),
    "boosted": Trees(depth=4, rates=(1.0,) + (0.1,) * 19, seed=FOREST_SEED),
    "forest": Trees(FOREST_TREES, share=1 / 3, drawn=True, seed=FOREST_SEED),
    "forest10": Trees(10, share=1 / 3, drawn=True, seed=FOREST_SEED),
}


def month_start(date: str = "date") -> Column:
    return F.trunc(date, "month")


def week_start(date: str = "date") -> Column:
    return F.trunc(date, "week")


def walk_forward(table: DataFrame, features: Sequence[str], estimator: str = "forest", block: Column | None = None,
                 scaled: bool = True, name: str = "model", pooling: str = "all",
                 keys: Sequence[str] = ("dam", "date", "horizon"), written: bool = False) -> DataFrame:
    """Add predictions of trees refitted at the start of every block, in any pooling.

    The horizon is one of the inputs. Blocks without two known labels predict no change.
    written: the table is read from files, and need not be written for its second reading.
    """
    rows = table if written else materialise(table, "walk-forward")
    block = month_start() if block is None else block
    grown = walk(rows, [*features, "horizon"], keys, ESTIMATORS[estimator], pooling, scaled_target(scaled), block)
    value = unscaled(F.col("_trees")) if scaled else F.col("_trees")
    return rows.join(grown, list(keys), "left").withColumn(name, finite_or_zero(value)).drop("_trees")


def alert_forecasts(targets: DataFrame, features: Sequence[str] = ALERT_FEATURES, pooling: str = "none",
                    penalty: float = 1.0, steps: int = STEPS) -> DataFrame:
    """Alert probabilities per basin, day and horizon, and today's state as the naive rival.

    A logistic regression for each basin and horizon, or with `pooling` "dam" for all
    basins of a horizon, "horizon" for all horizons of a basin, "all" for all of both, on
    the labels known at each day. Without any the chance is 0.
    """
    rows = targets.withColumnRenamed("basin", "dam").withColumn("label_date", F.date_add("date", F.col("horizon").cast("int")))
    inputs = [*features, "horizon"] if pooling in ("horizon", "all") else list(features)
    scored = logistic(rows, inputs, "target", pooling, penalty, steps).withColumn("prob", F.round(F.coalesce("prob", F.lit(0.0)), 9))
    return scored.select(
        F.col("dam").alias("basin"), "date", "horizon", F.col("target").alias("actual"), "prob",
        at_least_half(F.col("prob")).alias("pred"), F.col("on_watch").cast("int").alias("persistence"))
