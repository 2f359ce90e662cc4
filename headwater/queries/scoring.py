"""Baselines, scoreboards, curves, verdicts and alert scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.constants import CURVE_MIN_LIVE
from headwater.functions import numeric
from headwater.functions.registry import with_baselines
from headwater.operators import alerts, scoreboard
from headwater.operators.search import split_tag
from headwater.queries.common import (
    ALERTS, ERROR_CTES, query_set, reversion_errors, rounded, sql_round, with_ctes,
)
from headwater.sources import views

QUERIES, ORACLES, register = query_set()

GATE = 3000

BOARD = f"""per AS (
  SELECT horizon, count(*) AS n, round(avg(abs_err_model), 4) AS mae_model, round(avg(abs_err_persistence), 4) AS mae_persistence,
    round(avg(abs_err_drift), 4) AS mae_drift FROM errors GROUP BY horizon),
board AS (
  SELECT *, n >= {GATE} AS enough_data, CAST({GATE} AS BIGINT) AS min_scored,
    CASE WHEN mae_persistence <= mae_drift THEN 'persistence' ELSE 'drift' END AS best_baseline,
    least(mae_persistence, mae_drift) AS mae_best_baseline,
    n >= {GATE} AND mae_model < least(mae_persistence, mae_drift) AS beats_baseline FROM per)"""


@register("baseline_errors", f"""{with_ctes(*ERROR_CTES)}
SELECT dam, date, horizon, {sql_round("model", "drift", "abs_err_model", "abs_err_persistence", "abs_err_drift")},
  CAST(0 AS DOUBLE) AS persistence FROM errors""")
def baseline_errors(spark, folder):
    errors = with_baselines(reversion_errors(spark, folder))
    return rounded(errors.select("dam", "date", "horizon", "model", "persistence", "drift", "abs_err_model",
                                 "abs_err_persistence", "abs_err_drift"))


@register("scoreboard", f"{with_ctes(*ERROR_CTES, BOARD)} SELECT * FROM board")
def board(spark, folder):
    return scoreboard.scoreboard(reversion_errors(spark, folder), GATE)


@register("verdicts", f"""{with_ctes(*ERROR_CTES, BOARD)}
SELECT horizon, n, mae_model < mae_best_baseline AS ahead,
  CASE WHEN enough_data AND mae_model < mae_best_baseline THEN 'model wins' WHEN enough_data THEN 'baseline wins'
    WHEN mae_model < mae_best_baseline THEN 'ahead, needs ' || (min_scored - n) || ' more'
    ELSE 'behind, needs ' || (min_scored - n) || ' more' END AS verdict FROM board""")
def verdicts(spark, folder):
    judged = scoreboard.with_verdicts(scoreboard.scoreboard(reversion_errors(spark, folder), GATE))
    return judged.select("horizon", "n", "ahead", "verdict")


@register("scoreboard_rollup", f"""{with_ctes(*ERROR_CTES, BOARD)},
judged AS (SELECT *, mae_model < mae_best_baseline AS ahead FROM board)
SELECT coalesce(string_agg(horizon, ',' ORDER BY horizon) FILTER (ahead AND enough_data), '') AS certified,
  coalesce(string_agg(horizon, ',' ORDER BY horizon) FILTER (ahead AND NOT enough_data), '') AS provisional,
  coalesce(string_agg(horizon, ',' ORDER BY horizon) FILTER (NOT ahead), '') AS losing,
  coalesce(string_agg(horizon, ',' ORDER BY horizon) FILTER (NOT enough_data), '') AS thin,
  coalesce(string_agg(horizon, ',' ORDER BY horizon) FILTER (beats_baseline), '') AS winning,
  min(min_scored - n) FILTER (ahead AND NOT enough_data) AS next_needs,
  CASE WHEN bool_and(ahead AND enough_data) THEN 'all horizons certified'
    WHEN bool_and(ahead) THEN 'ahead everywhere, still counting' ELSE 'ahead at some horizons' END AS claim
FROM judged""")
def scoreboard_rollup(spark, folder):
    rolled = scoreboard.rollup(scoreboard.scoreboard(reversion_errors(spark, folder), GATE))
    lists = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
             for c in ("certified", "provisional", "losing", "thin", "winning")]
    return rolled.select(*lists, "next_needs", "claim")


@register("by_source", f"""{with_ctes(*ERROR_CTES)}
SELECT CASE WHEN dev_24h_m IS NULL THEN 'era5_proxy' ELSE 'forecast' END AS fcst_source,
  round(avg(abs_err_model), 4) AS mae_model, count(*) AS n FROM errors GROUP BY 1""")
def by_source(spark, folder):
    source = F.when(F.col("dev_24h_m").isNull(), "era5_proxy").otherwise("forecast")
    return rounded(scoreboard.by_source(reversion_errors(spark, folder).withColumn("fcst_source", source)), 4)


CURVE = """curve AS (
  SELECT date, avg(abs_err_model) AS abs_err_model, avg(abs_err_persistence) AS abs_err_persistence FROM errors GROUP BY date),
rolled AS (SELECT *,
  CASE WHEN count(abs_err_model) OVER w >= 5 THEN avg(abs_err_model) OVER w END AS roll_abs_err_model,
  CASE WHEN count(abs_err_persistence) OVER w >= 5 THEN avg(abs_err_persistence) OVER w END AS roll_abs_err_persistence
  FROM curve WINDOW w AS (ORDER BY date ROWS 19 PRECEDING))"""
CURVE_COLUMNS = ("abs_err_model", "abs_err_persistence", "roll_abs_err_model", "roll_abs_err_persistence")


@register("learning_curve", f"{with_ctes(*ERROR_CTES, CURVE)} SELECT date, {sql_round(*CURVE_COLUMNS)} FROM rolled")
def learning_curve(spark, folder):
    return rounded(scoreboard.learning_curve(reversion_errors(spark, folder)))


@register("fallback_curve", f"{with_ctes(*ERROR_CTES, CURVE)} SELECT date AS target_date, {sql_round(*CURVE_COLUMNS)} FROM rolled")
def fallback_curve(spark, folder):
    """No live error has been logged yet, so the backtest's curve is shown."""
    errors = reversion_errors(spark, folder)
    backtest = scoreboard.learning_curve(errors)
    live = scoreboard.learning_curve(
        errors.filter(F.col("label_date") > F.lit("2100-01-01").cast("date")).withColumnRenamed("date", "issue_date")
        .withColumnRenamed("label_date", "target_date"), "target_date")
    return rounded(scoreboard.fallback_curve(live, backtest))


@register("live_curve", f"""{with_ctes(*ERROR_CTES)},
curve AS (SELECT label_date AS target_date, avg(abs_err_model) AS abs_err_model, avg(abs_err_persistence) AS abs_err_persistence
  FROM errors WHERE label_date > DATE '2024-01-20' GROUP BY 1),
rolled AS (SELECT *, CASE WHEN count(abs_err_model) OVER w >= 3 THEN avg(abs_err_model) OVER w END AS roll_abs_err_model,
  CASE WHEN count(abs_err_persistence) OVER w >= 3 THEN avg(abs_err_persistence) OVER w END AS roll_abs_err_persistence
  FROM curve WINDOW w AS (ORDER BY target_date ROWS 19 PRECEDING))
SELECT target_date, {sql_round(*CURVE_COLUMNS)} FROM rolled""")
def live_curve(spark, folder):
    """Once live errors are logged their curve is shown, and the backtest's is not."""
    errors = reversion_errors(spark, folder)
    landed = errors.filter(F.col("label_date") > F.lit("2024-01-20").cast("date")).drop("date").withColumnRenamed("label_date", "target_date")
    live = scoreboard.learning_curve(landed, "target_date", minimum=CURVE_MIN_LIVE)
    return rounded(scoreboard.fallback_curve(live, scoreboard.learning_curve(errors)))


ALERT_PAIRS = """rivers AS (SELECT * FROM alerts WHERE kind = 'river_basin'),
pairs AS (SELECT a.basin, a.date, h.horizon, CAST(a.on_watch AS INTEGER) AS persistence, CAST(f.on_watch AS INTEGER) AS actual,
    CASE WHEN avg(CAST(a.on_watch AS DOUBLE)) OVER (PARTITION BY a.basin, h.horizon ORDER BY a.date ROWS 2 PRECEDING) >= 0.5
      THEN 1 ELSE 0 END AS pred
  FROM rivers a CROSS JOIN range(1, 4) h(horizon)
  LEFT JOIN rivers f ON f.basin = a.basin AND f.date = a.date + CAST(h.horizon AS INTEGER))"""


@register("confusion", f"""{with_ctes(ALERTS, ALERT_PAIRS)},
c AS (SELECT horizon, count(*) AS n,
  count(*) FILTER (pred = 1 AND actual = 1) AS model_tp, count(*) FILTER (pred = 1 AND actual = 0) AS model_fp,
  count(*) FILTER (pred = 0 AND actual = 1) AS model_fn, avg(CASE WHEN pred = actual THEN 1.0 ELSE 0.0 END) AS model_accuracy,
  count(*) FILTER (persistence = 1 AND actual = 1) AS persistence_tp, count(*) FILTER (persistence = 1 AND actual = 0) AS persistence_fp,
  count(*) FILTER (persistence = 0 AND actual = 1) AS persistence_fn,
  avg(CASE WHEN persistence = actual THEN 1.0 ELSE 0.0 END) AS persistence_accuracy
  FROM pairs WHERE actual IS NOT NULL GROUP BY horizon)
SELECT CAST(horizon AS INTEGER) AS horizon, n, model_tp, model_fp, model_fn, persistence_tp, persistence_fp, persistence_fn,
  round(model_accuracy, 6) AS model_accuracy, round(persistence_accuracy, 6) AS persistence_accuracy,
  round(model_tp / nullif(model_tp + model_fn, 0), 6) AS model_recall,
  round(model_tp / nullif(model_tp + model_fp, 0), 6) AS model_precision,
  round(persistence_tp / nullif(persistence_tp + persistence_fn, 0), 6) AS persistence_recall,
  round(persistence_tp / nullif(persistence_tp + persistence_fp, 0), 6) AS persistence_precision,
  coalesce(model_tp / nullif(model_tp + model_fn, 0) > persistence_tp / nullif(persistence_tp + persistence_fn, 0), FALSE) AS beats_baseline
FROM c""")
def confusion(spark, folder):
    table = alerts.alert_targets(alerts.alert_features(views.alerts(spark, folder)))
    scored = table.select(
        "horizon", F.col("target").alias("actual"), numeric.at_least_half(F.col("watch_3d")).alias("pred"),
        F.col("on_watch").cast("int").alias("persistence"))
    return rounded(alerts.confusion(scored))


@register("status_gate", f"""{with_ctes(ALERTS, ALERT_PAIRS)}
SELECT (SELECT count(DISTINCT date) FROM rivers) AS days_collected, (SELECT count(DISTINCT basin) FROM rivers) AS basins,
  CAST(sum(actual) AS BIGINT) AS watch_days_seen, count(actual) AS n_targets,
  CASE WHEN (SELECT count(DISTINCT date) FROM rivers) < 30 THEN 'not enough history yet'
    WHEN sum(actual) < 10 THEN 'not enough flood-watch days to learn from' ELSE 'scored' END AS status FROM pairs""")
def status_gate(spark, folder):
    states = views.alerts(spark, folder).filter("kind = 'river_basin'")
    return alerts.status_gate(states, alerts.alert_targets(alerts.alert_features(states)))


@register("shrink_blend", f"""{with_ctes(*ERROR_CTES)}
SELECT dam, date, horizon, round(model * 0.6, 6) AS shrunk, CAST(CASE WHEN round(model / 100 + 0.5, 9) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS rise,
  round(CASE WHEN dev_24h_m IS NULL THEN 0 ELSE model / nullif(dev_24h_m, 0) END, 6) AS guarded
FROM errors WHERE dev_24h_m IS NULL OR dev_24h_m <> 0
UNION ALL SELECT dam, date, horizon, round(model * 0.6, 6), CAST(CASE WHEN round(model / 100 + 0.5, 9) >= 0.5 THEN 1 ELSE 0 END AS INTEGER), 0
FROM errors WHERE dev_24h_m = 0""")
def shrink_blend(spark, folder):
    # A division by a zero change is infinite, one by an unknown change NULL.
    change = F.col("dev_24h_m")
    ratio = F.when(change == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("model"), change))
    return rounded(reversion_errors(spark, folder).select(
        "dam", "date", "horizon", numeric.shrink(F.col("model"), 0.6).alias("shrunk"),
        numeric.at_least_half(F.round(F.col("model") / 100 + 0.5, 9)).alias("rise"), numeric.finite_or_zero(ratio).alias("guarded")))


@register("split_scores", f"""{with_ctes(*ERROR_CTES)}
SELECT CASE WHEN date >= DATE '2024-01-21' THEN 'holdout' ELSE 'dev' END AS split, horizon, count(*) AS n,
  round(avg(abs_err_model), 4) AS mae, round(least(avg(abs_err_persistence), avg(abs_err_drift)), 4) AS best_baseline
FROM errors GROUP BY 1, 2""")
def split_scores(spark, folder):
    errors = split_tag(reversion_errors(spark, folder), "2024-01-21")
    return errors.groupBy("split", "horizon").agg(
        F.count(F.lit(1)).alias("n"), numeric.published(F.avg("abs_err_model")).alias("mae"),
        numeric.published(F.least(F.avg("abs_err_persistence"), F.avg("abs_err_drift"))).alias("best_baseline"))
