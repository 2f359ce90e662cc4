"""The published view: dams, alerts, scores, curve and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.constants import CURVE_MIN_LIVE, DISCLAIMER
from headwater.functions import risk
from headwater.functions.clean import nan_to_null
from headwater.functions.numeric import published
from headwater.operators.alerts import alert_board, confusion, latest_day, status_gate
from headwater.operators.ledger import freshness, past_extremes, recent_history
from headwater.operators.scoreboard import by_source, fallback_curve, learning_curve, scoreboard

RAIN = ("rain_7d", "rain_next_7d")


def dam_payload(table: DataFrame, daily: DataFrame, registry: DataFrame, prediction: Column) -> DataFrame:
    """(dam, payload) for every dam observed on the latest day.

    A payload nests the seven forecasts and the recent levels, both of bounded
    length; missing values are NULL, never NaN. A dam wetter than on any day before
    is marked as extrapolating. A table without rain says nothing about it.
    """
    table = table.select("*", *[F.lit(None).cast("double").alias(c) for c in RAIN if c not in table.columns])
    rise = past_extremes(table, ["dam", "horizon"], "target_delta", "_rise")
    wettest = past_extremes(table, ["dam"], "rain_7d", "_wettest")
    current = latest_day(table).join(rise, ["dam", "horizon"], "left").join(wettest, "dam", "left")
    level = F.col("rwl_m") + prediction
    forecast = F.struct(
        "horizon",
        F.date_add("date", F.col("horizon").cast("int")).alias("target_date"),
        F.round(prediction, 3).alias("pred_delta"),
        F.round(level, 3).alias("pred_rwl_m"),
        risk.beyond(prediction, F.col("_rise")).alias("beyond_observed_rise"),
    )
    per_dam = current.groupBy("dam", "date", "rwl_m", "nhwl_m", "rule_curve_m").agg(
        F.sort_array(F.collect_list(forecast)).alias("forecasts"), F.max(nan_to_null(level)).alias("_peak"),
        *[F.max(nan_to_null(F.col(c))).alias(c) for c in (*RAIN, "_wettest")],
    )
    label = risk.risk_of_peak(F.col("_peak"), F.col("nhwl_m"), F.col("rule_curve_m"))
    full = (
        per_dam.withColumn("risk", label)
        .join(recent_history(daily), "dam", "left")
        .join(registry.select("dam", "lat", "lon"), "dam", "left")
    )
    payload = F.struct(
        "dam", "lat", "lon", F.col("date").alias("issue_date"), "rwl_m",
        nan_to_null(F.col("nhwl_m")).alias("nhwl_m"), nan_to_null(F.col("rule_curve_m")).alias("rule_curve_m"),
        "risk", risk.risk_note(F.col("risk")).alias("risk_note"),
        risk.beyond(F.coalesce("rain_7d", F.lit(0.0)), F.col("_wettest")).alias("extrapolating"),
        *[F.round(c, 1).alias(c) for c in RAIN], "observed", "forecasts",
    )
    return full.select("dam", payload.alias("payload"))


def basin_forecast(alerts: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The status of alert forecasts, and their scores per horizon once that says `scored`."""
    gate = status_gate(alerts, scored.withColumnRenamed("actual", "target"))
    return gate, confusion(scored).filter(gate.select("status").scalar() == "scored")


def dashboard(table: DataFrame, daily: DataFrame, registry: DataFrame, alerts: DataFrame, errors: DataFrame,
              prediction: Column, as_of: Column, backtest: DataFrame | None = None, alert_scores: DataFrame | None = None,
              scored: DataFrame | None = None, drifted: DataFrame | None = None, disclaimer: str = DISCLAIMER) -> DataFrame:
    """The payload as (section, key, json) rows, one per dam, basin, horizon or day.

    Sections are written side by side instead of nested into one document, so
    the result grows with the number of dams without passing through one task.

    `backtest` holds errors per forecast with `date` and `fcst_source`: its scores are
    the ones shown, and its curve where no live error is known yet. `alert_scores` has
    basin, horizon, actual, pred and persistence. `scored` and `drifted` are the errors
    and drift events of this run. What is not given has no rows.
    """

    def section(name: str, df: DataFrame, key: str, *columns: str) -> DataFrame:
        body = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
        return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), body.alias("json"))

    curve = learning_curve(errors, "target_date", minimum=CURVE_MIN_LIVE)
    if backtest is not None:
        curve = fallback_curve(curve, learning_curve(backtest))
    curve = curve.withColumns({c: published(c) for c in curve.columns if c != "target_date"})
    n_scored = F.lit(0) if scored is None else scored.agg(F.count(F.lit(1))).scalar()
    fresh = freshness(daily, as_of).withColumns(
        {"generated_at": as_of, "scored_this_run": n_scored.cast("long"), "disclaimer": F.lit(disclaimer)})
    dams = dam_payload(table, daily, registry, prediction)
    parts = [
        dams.select(F.lit("dams").alias("section"), F.col("dam").alias("key"),
                    F.to_json("payload", {"ignoreNullFields": "false"}).alias("json")),
        section("basins", alert_board(alerts), "basin", "basin", "status", "on_watch", "kind", "date"),
        section("metrics", scoreboard(errors if backtest is None else backtest), "horizon"),
        section("learning_curve", curve, "target_date"),
        section("freshness", fresh, "latest_observation"),
    ]
    if backtest is not None:
        sources = by_source(backtest).withColumn("mae_model", published("mae_model"))
        parts.append(section("metrics_by_rain_source", sources, "fcst_source"))
    if alert_scores is not None:
        gate, scores = basin_forecast(alerts.filter("kind = 'river_basin'"), alert_scores)
        parts += [section("basin_forecast", gate, "status"), section("basin_forecast", scores, "horizon")]
    if drifted is not None:
        parts.append(section("drift_events_this_run", drifted, "dam"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
