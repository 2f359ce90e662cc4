"""Delayed prequential evaluation: predict, wait for the label, then learn.

All rows of an issue date are predicted from labels known on that date, and no
earlier row has seen more. The live loop works the same way, so the two errors
measure the same thing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headwater.constants import BASE_FEATURES
from headwater.functions.registry import with_baselines, with_errors
from headwater.operators import ridge as ridges
from headwater.operators.causal import target_moments, target_scale, with_target_scale
from headwater.operators.ridge import ridge
from headwater.operators.targets import labelled, with_label_date
from headwater.session import materialise, scratch

HORIZON = 7  # days that a label comes in after its forecast, at most
RESULT = ("date", "dam", "horizon", "fcst_source", "actual", "model")


def entity_effect(rows: DataFrame, strength: float = 5.0) -> DataFrame:
    """The dam's past mean target, shrunk by its sample size, as a feature.

    It takes the place of one flag per dam, which would add a column for each.
    """
    shrunk = F.col("label_mean") * F.col("label_n") / (F.col("label_n") + F.lit(strength))
    return rows.withColumn("dam_effect", shrunk / F.coalesce(F.col("scale"), F.lit(1.0)))


def prepared(table: DataFrame, search: bool = False) -> DataFrame:
    """Rows with label date, target scale and entity effect."""
    rows = with_target_scale(with_label_date(table), search)
    return entity_effect(rows)


def predictions(table: DataFrame, features: Sequence[str] = BASE_FEATURES, pooling: str = "all",
                penalty: float = 1.0, scaled: bool = True) -> DataFrame:
    """The pooled model's prediction for every row, labelled or not."""
    rows = prepared(table)
    inputs = [*features, "dam_effect", "horizon"]
    return ridge(rows, inputs, pooling, penalty, scaled)


def backtest(table: DataFrame, features: Sequence[str] = BASE_FEATURES, pooling: str = "all",
             penalty: float = 1.0, scaled: bool = True) -> DataFrame:
    """One row per labelled forecast: prediction, baselines and errors."""
    scored = labelled(predictions(table, features, pooling, penalty, scaled))
    return errors_of(scored)


@dataclass(frozen=True)
class Progress:
    """Where a backtest that is carried on day by day keeps its sums, predictions and errors."""

    root: str

    def at(self, table: str, day: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if day is None else f"/upto={day}")


PROGRESS = "day int"
PREDICTED = "dam string, date date, horizon int, fcst_source string, dev_24h_m double, scale double, dam_effect double, model double"
MOMENTS = "dam string, past_n double, past_sum double, past_sq double"
BLOCKS = "pool string, cell int, part double"


def resume(progress: Progress, table: DataFrame, features: Sequence[str] = BASE_FEATURES, penalty: float = 1.0) -> DataFrame:
    """Carry a pooled backtest on to the table's newest day; returns the errors of this run.

    A run reads the stored sums of its last one and the rows of the days since, with
    those before them whose labels came in meanwhile: `HORIZON` days. All runs together
    give the errors of `backtest` over the whole table, if labels come in on their days.
    What a run stores is named by its newest day, and the day is noted last: a run that
    stops half way is made again, in the same folders.
    """
    with scratch(table.sparkSession):
        return _resume(progress, table, features, penalty)


def _resume(progress: Progress, table: DataFrame, features: Sequence[str], penalty: float) -> DataFrame:
    spark = table.sparkSession
    last = _last(spark, progress)
    day = lambda c: F.unix_date(F.col(c))
    rows = with_label_date(table if last is None else table.filter(F.col("date") > F.date_from_unix_date(F.lit(last - HORIZON))))
    newest = rows.agg(F.max(day("date"))).first()[0]
    if newest is None or last is not None and newest <= last:
        return spark.createDataFrame([], _errors_schema(spark))
    oldest = -(1 << 30) if last is None else last
    new = F.col("target_delta").isNotNull() & (day("label_date") <= newest) & (day("label_date") > oldest)
    rows = materialise(rows, "days")
    before = None
    if last is not None:
        before = spark.read.schema(MOMENTS).parquet(progress.at("moments", last)).withColumn("date", F.date_from_unix_date(F.lit(last)))
    moments = materialise(target_moments(rows, new, before), "moments")
    inputs = [*features, "dam_effect", "horizon"]
    fresh = rows.filter(day("date") > oldest)
    fresh = entity_effect(fresh.join(target_scale(rows, past=moments), ["dam", "date"], "left"))
    full = fresh
    if last is not None:
        # Rows of earlier runs keep the scale and effect of their own day.
        made = spark.read.schema(PREDICTED).parquet(progress.at("predictions")).filter(day("date") > oldest - HORIZON)
        # Not those of a run to this day that stopped half way.
        made = made.filter(day("date") <= oldest)
        earlier = rows.join(made.select("dam", "date", "horizon", "scale", "dam_effect"), ["dam", "date", "horizon"])
        full = fresh.unionByName(earlier, allowMissingColumns=True)
    # Labels of earlier runs are in the sums; a row of such a date may only lend its late label.
    ready = ridges.ready_rows(full.withColumn("target_delta", F.when(new, F.col("target_delta"))), inputs)
    blocks = ridges.cross_product_blocks(ready, inputs).filter(F.col("day") > oldest)
    if last is not None:
        stored = spark.read.schema(BLOCKS).parquet(progress.at("sums", last)).withColumn("day", F.lit(last))
        blocks = ridges.add_blocks(blocks.unionByName(stored.select(*blocks.columns)))
    blocks = materialise(blocks.filter(F.col("day") <= newest), "blocks")
    models = ridges.variant_models(blocks, inputs, [(penalty, None)]).drop("variant")
    predicted = ridges.with_models(fresh, F.lit("all"), models, inputs).select(*[f.name for f in _schema(PREDICTED)])
    predicted.write.mode("overwrite").parquet(progress.at("predictions", newest))
    _newest(moments, ["dam"], MOMENTS).write.mode("overwrite").parquet(progress.at("moments", newest))
    blocks.groupBy("pool", "cell").agg(F.sum("part").alias("part")).write.mode("overwrite").parquet(progress.at("sums", newest))
    # Labels that came in since meet the forecast that was made on their own day.
    made = spark.read.schema(PREDICTED).parquet(progress.at("predictions")).filter(day("date") > oldest - HORIZON)
    landed = rows.filter(new).select("dam", "date", "horizon", "target_delta")
    errors = errors_of(made.join(landed, ["dam", "date", "horizon"]))
    errors.write.mode("overwrite").parquet(progress.at("errors", newest))
    spark.createDataFrame([(newest,)], PROGRESS).coalesce(1).write.mode("append").parquet(progress.at("days"))
    return spark.read.schema(errors.schema).parquet(progress.at("errors", newest))


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _errors_schema(spark) -> StructType:
    return errors_of(spark.createDataFrame([], PREDICTED + ", target_delta double")).schema


def _last(spark, progress: Progress) -> int | None:
    try:
        return spark.read.schema(PROGRESS).parquet(progress.at("days")).agg(F.max("day")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest(prefix: DataFrame, keys: Sequence[str], ddl: str) -> DataFrame:
    """The last row of each key's running sums. They only grow with the count, so the largest count is the last."""
    names = [f.name for f in _schema(ddl) if f.name not in keys]
    return prefix.groupBy(*keys).agg(*[F.max_by(n, F.unix_date("date")).alias(n) for n in names])


def errors_of(scored: DataFrame, prediction: str = "model") -> DataFrame:
    return with_errors(with_baselines(scored.withColumn("actual", F.col("target_delta"))), prediction)
