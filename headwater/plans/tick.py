"""One run of the live loop: score what is due, learn from it, issue, publish.

The learner is a sum of cross products: those of the history, reduced once, and
those of every forecast that has landed since, made of the inputs it was issued
with. A run reads the sums and its new rows, never the history's rows again, and
later corrections of the table don't reach what was learned. The targets' moments by
dam, which scale them, and the windows of the drift detectors are kept likewise.

Tables only grow, so a run may be repeated or may stop half way: the next one adds
what is missing and nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater import schemas
from headwater.constants import BASE_FEATURES, FLAT_SD
from headwater.functions.numeric import population_sd
from headwater.operators import ledger as ledgers
from headwater.operators import ridge
from headwater.operators.alerts import latest_day
from headwater.operators.drift import STATE, drift_step, events_of
from headwater.operators.keys import missing_from
from headwater.operators.targets import with_label_date
from headwater.plans.backtest import entity_effect, prepared
from headwater.plans.publish import dashboard
from headwater.session import materialise, scratch
from headwater.sources.files import append, read_current, read_table, replace_table

INPUTS = (*BASE_FEATURES, "dam_effect", "horizon")
# What the ledger keeps of a forecast beside its horizon, to learn from it later.
STORED = (*BASE_FEATURES, "dam_effect", "scale")
PENALTY = 1.0


@dataclass(frozen=True)
class Store:
    """Where the loop keeps its tables."""

    root: str

    @property
    def ledger(self) -> str:
        return f"{self.root}/predictions"

    @property
    def errors(self) -> str:
        return f"{self.root}/error_log"

    @property
    def drift(self) -> str:
        return f"{self.root}/drift_events"

    @property
    def history(self) -> str:
        return f"{self.root}/history"

    @property
    def learned(self) -> str:
        return f"{self.root}/learned"

    @property
    def moments(self) -> str:
        return f"{self.root}/moments"

    @property
    def windows(self) -> str:
        return f"{self.root}/drift_windows"

    @property
    def published(self) -> str:
        return f"{self.root}/published"


def sums_of(rows: DataFrame) -> DataFrame:
    """The rows' cross products, one sum per cell whatever their days."""
    blocks = ridge.cross_product_blocks(ridge.ready_rows(rows, INPUTS), INPUTS)
    return blocks.groupBy("pool", "cell").agg(F.sum("part").alias("part"))


def moments_of(labels: DataFrame) -> DataFrame:
    """(dam, n, total, squares) of known target changes: they add up, and give a dam's scale."""
    y = F.col("target_delta")
    return labels.filter(y.isNotNull()).groupBy("dam").agg(
        F.count(y).cast("double").alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares"))


def warm_start(spark: SparkSession, store: Store, table: DataFrame) -> None:
    """Reduce the labels known on the table's newest day, unless an earlier run did."""
    if read_current(spark, store.history, schemas.SUMS).isEmpty():
        newest = table.agg(F.max("date")).scalar()
        past = with_label_date(table).filter(F.col("label_date") <= newest)
        # The moments first: the sums say that both are there.
        moments_of(past).write.mode("overwrite").parquet(f"{store.moments}/batch=history")
        replace_table(sums_of(prepared(table).filter(F.col("label_date") <= newest)), store.history)


def score(spark: SparkSession, store: Store, actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Learn from forecasts that have landed, then log their errors and new drift events.

    Returns the errors and the events of this run. What is learned goes to a folder
    named by the log's length: a run that stops before it logs the errors leaves the
    length as it was, and the next one writes that folder anew.
    """
    ledger = read_table(spark, store.ledger, schemas.LEDGER, optional=True)
    errors = read_table(spark, store.errors, schemas.ERROR_LOG, optional=True)
    due = materialise(ledgers.score_due(ledger, errors, actuals), "due")
    logged, landed = errors.count(), due.count()
    sums_of(learned_rows(ledger, due, STORED)).write.mode("overwrite").parquet(f"{store.learned}/batch={logged}")
    moments_of(due.withColumnRenamed("actual_delta", "target_delta")).write.mode("overwrite").parquet(f"{store.moments}/batch={logged}")
    # The detectors' windows as of a log of some length: this run's errors alone are added.
    step = materialise(drift_step(_windows(spark, store, errors, logged), due), "drift")
    step.drop("events").write.mode("overwrite").parquet(f"{store.windows}/upto={logged + landed}")
    known = read_table(spark, store.drift, schemas.DRIFT_LOG, optional=True)
    drifted = materialise(missing_from(events_of(step), known, ["dam", "horizon", "detected_at"]), "drift")
    # Events before errors: a run that stops in between finds and skips them next time.
    append(drifted, store.drift)
    append(due, store.errors)
    return due, drifted


def _windows(spark: SparkSession, store: Store, errors: DataFrame, logged: int) -> DataFrame | None:
    """The windows that a log of `logged` errors left, made anew from the log where they are missing."""
    if not logged:
        return None
    try:
        return spark.read.schema(STATE).parquet(f"{store.windows}/upto={logged}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return drift_step(None, errors).drop("events")


def learned_rows(ledger: DataFrame, errors: DataFrame, features) -> DataFrame:
    """Training rows from the ledger: the inputs a forecast saw and its outcome."""
    outcome = errors.select("dam", F.col("issue_date").alias("date"), "horizon", F.col("actual_delta").alias("target_delta"),
                            F.col("target_date").alias("label_date"))
    return ledgers.stored_inputs(ledger, features).join(outcome, ["dam", "date", "horizon"])


def with_known_scale(spark: SparkSession, store: Store, rows: DataFrame) -> DataFrame:
    """Rows with the count, mean and spread of their dam's labels so far, from the stored moments."""
    stored = spark.read.schema("dam string, n double, total double, squares double").parquet(store.moments)
    known = stored.groupBy("dam").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    sd = population_sd(F.col("n"), F.col("total"), F.col("squares"))
    scale = known.select("dam", F.col("n").cast("long").alias("label_n"), F.try_divide("total", "n").alias("label_mean"),
                         F.when((F.col("n") >= 2) & (sd > FLAT_SD), sd).alias("scale"))
    return rows.join(scale, "dam", "left")


def forecast(spark: SparkSession, store: Store, table: DataFrame, per_dam: bool = False) -> DataFrame:
    """The latest day's rows with the prediction of the learner as it stands."""
    history = read_current(spark, store.history, schemas.SUMS)
    learned = read_table(spark, store.learned, schemas.SUMS, optional=True)
    blocks = ridge.add_blocks(history.unionByName(learned.select(history.columns)).withColumn("day", F.lit(0)))
    models = ridge.models_of(blocks, INPUTS, PENALTY).drop("pool", "day")
    rows = entity_effect(with_known_scale(spark, store, latest_day(with_label_date(table), per=["dam"] if per_dam else ())))
    # The one pool has one model, or none before anything was learned.
    return ridge.predicted(rows.join(models, F.lit(True), "left"), INPUTS)


def issue(spark: SparkSession, store: Store, current: DataFrame) -> None:
    """Append the forecasts, unless they were issued before."""
    ledger = read_table(spark, store.ledger, schemas.LEDGER, optional=True)
    rows = ledgers.ledger_rows(current, F.col("model"), STORED)
    append(ledgers.issue_new(rows, ledger), store.ledger)


def run(spark: SparkSession, store: Store, table: DataFrame, daily: DataFrame, registry: DataFrame, alerts: DataFrame,
        as_of: Column, backtest: DataFrame | None = None, alert_scores: DataFrame | None = None, per_dam: bool = False) -> None:
    """One whole run. `backtest` and `alert_scores` are published beside the live errors.

    Its intermediate results go with it; the store keeps what the next run reads.
    """
    with scratch(spark):
        _run(spark, store, table, daily, registry, alerts, as_of, backtest, alert_scores, per_dam)


def _run(spark, store, table, daily, registry, alerts, as_of, backtest, alert_scores, per_dam) -> None:
    warm_start(spark, store, table)
    scored, drifted = score(spark, store, ledgers.one_actual(daily))
    current = materialise(forecast(spark, store, table, per_dam), "forecasts")
    issue(spark, store, current)
    predicted = table.join(current.select("dam", "date", "horizon", "model"), ["dam", "date", "horizon"], "left")
    errors = read_table(spark, store.errors, schemas.ERROR_LOG, optional=True)
    view = dashboard(predicted, daily, registry, alerts, errors, F.col("model"), as_of, backtest, alert_scores, scored, drifted)
    view.write.mode("overwrite").partitionBy("section").parquet(store.published)
