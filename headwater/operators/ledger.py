"""The append-only forecast ledger and its deferred scores.

Nothing is ever updated: a forecast is open as long as the error log has no row
with its key, so a crash between two writes loses nothing and a rerun adds only
what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import BASE_FEATURES, HISTORY_DAYS
from headwater.functions.registry import BASELINES, feature_map
from headwater.operators.keys import missing_from
from headwater.schemas import LEDGER_KEY

ERROR_COLUMNS = (
    "issue_date", "target_date", "dam", "horizon", "pred_delta", "actual_delta",
    "abs_err_model", *[f"abs_err_{name}" for name in BASELINES],
)


def ledger_rows(forecasts: DataFrame, prediction: Column, features: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """Ledger entries with the very features and baseline inputs they saw."""
    inputs = F.create_map(
        F.lit("dev_24h_m"), F.col("dev_24h_m"), F.lit("horizon"), F.col("horizon").cast("double")
    )
    return forecasts.select(
        F.col("date").alias("issue_date"),
        F.date_add("date", F.col("horizon").cast("int")).alias("target_date"),
        "dam", "horizon", F.col("rwl_m").alias("issue_rwl_m"),
        prediction.alias("pred_delta"),
        feature_map(features).alias("features"),
        F.map_filter(inputs, lambda _, v: v.isNotNull()).alias("baseline_inputs"),
    )


def issue_new(rows: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Entries whose key is not in the ledger yet."""
    return rows if ledger is None else missing_from(rows, ledger, LEDGER_KEY)


def open_forecasts(ledger: DataFrame, errors: DataFrame | None) -> DataFrame:
    return ledger if errors is None else missing_from(ledger, errors, LEDGER_KEY)


def score_due(ledger: DataFrame, errors: DataFrame | None, actuals: DataFrame) -> DataFrame:
    """Error rows of open forecasts whose target day has been observed.

    `actuals` is one level per (dam, date). Forecasts still waiting do not match
    and stay open. Baselines are computed from the inputs stored at issue time.
    """
    seen = actuals.filter(F.col("rwl_m").isNotNull()).select(
        "dam", F.col("date").alias("target_date"), F.col("rwl_m").alias("_actual")
    )
    due = open_forecasts(ledger, errors).join(seen, ["dam", "target_date"])
    scored = due.withColumns(
        {
            "actual_delta": F.col("_actual") - F.col("issue_rwl_m"),
            "dev_24h_m": F.try_element_at("baseline_inputs", F.lit("dev_24h_m")),
        }
    )
    gap = {"abs_err_model": F.abs(F.col("pred_delta") - F.col("actual_delta"))}
    for name, make in BASELINES.items():
        gap[f"abs_err_{name}"] = F.abs(make() - F.col("actual_delta"))
    return scored.withColumns(gap).select(*ERROR_COLUMNS)


def stored_inputs(ledger: DataFrame, features: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """Features as columns again, to learn from what a forecast actually saw."""
    return ledger.select(
        F.col("issue_date").alias("date"), "dam", "horizon",
        *[F.try_element_at("features", F.lit(f)).alias(f) for f in features],
    )


def ledger_json(ledger: DataFrame) -> DataFrame:
    """Maps as JSON text, for sinks without nested types."""
    return ledger.withColumns(
        {"features": F.to_json("features"), "baseline_inputs": F.to_json("baseline_inputs")}
    )


def ledger_from_json(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns(
        {c: F.from_json(c, "map<string,double>") for c in ("features", "baseline_inputs")}
    )


def past_extremes(table: DataFrame, per: Sequence[str], value: str, name: str) -> DataFrame:
    """Largest value per group before the latest day of the table."""
    newest = table.agg(F.max("date")).scalar()
    return table.filter(F.col("date") < newest).groupBy(*per).agg(F.max(value).alias(name))


def recent_history(daily: DataFrame, days: int = HISTORY_DAYS, value: str = "rwl_m") -> DataFrame:
    """The last calendar days of each dam as an ordered array.

    One level per (dam, day): an array holds at most days + 1 entries.
    """
    start = daily.agg(F.date_sub(F.max("date"), days)).scalar()
    recent = daily.filter((F.col("date") >= start) & F.col(value).isNotNull())
    point = F.struct("date", F.round(value, 3).alias(value))
    return recent.groupBy("dam").agg(F.sort_array(F.collect_list(point)).alias("observed"))


def freshness(daily: DataFrame, as_of: Column, stale_after: int = 2) -> DataFrame:
    """Newest observation, its age in days, and whether that is stale."""
    newest = daily.agg(F.max("date").alias("latest_observation"))
    age = F.datediff(as_of, F.col("latest_observation"))
    return newest.withColumns({"data_age_days": age, "stale": age > stale_after})


def one_actual(observed: DataFrame) -> DataFrame:
    """One level per (dam, date) out of a table that repeats it per horizon."""
    return observed.select("dam", "date", "rwl_m").dropDuplicates(["dam", "date"])


