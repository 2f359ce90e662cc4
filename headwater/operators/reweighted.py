"""Robust and logistic regression as repeated weighted ridge passes, for all dates at once.

Each pass is the expanding ridge of `operators.ridge`: one reduction of the rows to cross
products, running sums over dates, one small solve per (pool, date). A row enters the
next pass with a weight, and for the logistic a working target, that follow from its own
forecast in the former pass. That forecast knew no later label than the row's
issue date, so no pass learns from the future, and none costs more than the first,
however many dates are fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.numeric import clip, finite_or_zero
from headwater.operators.causal import label_prefix, pool_key
from headwater.operators.ridge import ridge
from headwater.session import materialise

HUBER_WIDTH = 1.35  # mean absolute errors beyond which a label's pull stops growing
STEPS = 3
STEEPEST = 6.0  # bound of the linear predictor at which the logistic is linearised


def huber(table: DataFrame, features: Sequence[str], pooling: str = "all", penalty: float = 1.0, scaled: bool = True,
          steps: int = STEPS, width: float = HUBER_WIDTH, name: str = "model") -> DataFrame:
    """Add the prediction of a ridge on which labels far from their forecast pull less.

    A label that missed its forecast of the former pass by more than `width` times the
    mean absolute miss of its pool, as known when it came in, weighs less in proportion.
    """
    rows = materialise(table, "huber").withColumn("_weight", F.lit(1.0))
    for step in range(steps):
        fitted = ridge(rows, features, pooling, penalty, scaled, name="_fit", weight=F.col("_weight"))
        if step == steps - 1:
            return fitted.withColumnRenamed("_fit", name).drop("_weight")
        unit = F.coalesce(F.col("scale"), F.lit(1.0)) if scaled else F.lit(1.0)
        missed = materialise(fitted.withColumns({"_miss": F.abs(F.col("target_delta") - F.col("_fit")) / unit, "_of": pool_key(pooling)}), "huber-pass")
        past = label_prefix(missed, ["_of"], {"_n": F.lit(1.0), "_sum": F.col("_miss")})
        past = past.withColumnRenamed("date", "label_date").withColumn("_usual", F.try_divide("_sum", "_n")).select("_of", "label_date", "_usual")
        share = F.try_divide(F.lit(width) * F.col("_usual"), "_miss")
        weight = F.when(F.col("_miss") > F.lit(width) * F.col("_usual"), share).otherwise(1.0)
        rows = missed.join(past, ["_of", "label_date"], "left").withColumn("_weight", weight).select(*table.columns, "_weight")
    raise ValueError("at least one step")


def _working(rows: DataFrame, fit: Column) -> DataFrame:
    """Target and weight of the next pass: the logistic made straight at `fit`."""
    at = clip(fit, STEEPEST)
    chance = 1.0 / (1.0 + F.exp(-at))
    # Four times the variance, so that an undecided label weighs 1.
    bend = chance * (1.0 - chance)
    return rows.withColumns({"_weight": 4.0 * bend, "target_delta": at + (F.col("_label") - chance) / bend})


def logistic(table: DataFrame, features: Sequence[str], label: str, pooling: str = "dam", penalty: float = 1.0,
             steps: int = STEPS, name: str = "prob") -> DataFrame:
    """Add the chance that `label` (0 or 1) comes true, by Newton steps for all dates at once.

    The table needs dam, date, horizon and label_date. NULL where fewer than two labels,
    by weight, were known.
    """
    kept = [c for c in table.columns if c != "target_delta"]
    rows = materialise(table.withColumn("_label", F.col(label).cast("double")).select(*kept, "_label"), "logistic")
    rows = _working(rows, F.lit(0.0))
    for step in range(steps):
        fitted = ridge(rows, features, pooling, penalty, scaled=False, name="_fit", weight=F.col("_weight"), keep_null=True)
        if step < steps - 1:
            fitted = materialise(fitted.drop("target_delta", "_weight"), "logistic-pass")
            rows = _working(fitted, finite_or_zero(F.col("_fit"))).drop("_fit")
    chance = 1.0 / (1.0 + F.exp(-clip(F.col("_fit"), 30.0)))
    return fitted.withColumn(name, chance).select(*kept, name)
