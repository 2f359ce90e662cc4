"""Fitted models. Ridges and what repeats them have SQL: sums over known labels and an
elimination. Trees, bagged draws and sweeps are checked by tests instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import ridge as ridges
from headwater.operators import reweighted, scoreboard, trees
from headwater.operators.alerts import alert_features, alert_targets, confusion
from headwater.operators.causal import expert_blend
from headwater.operators.targets import labelled
from headwater.plans import backtest, search, walkforward
from headwater.plans.roles import events_table
from headwater.constants import ALERT_FEATURES, BASE_FEATURES, LEAN_FEATURES, TINY_FEATURES
from headwater.queries.common import ALERTS, FEATURE_CTES, query_set, rounded
from headwater.session import materialise, work_folder
from headwater.sources import views

QUERIES, ORACLES, register = query_set()

KEYS = ("dam", "date", "horizon")


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


# The modelling table with the target scale and the entity effect known at each date.
PREPARED = """past AS (SELECT d.dam, d.date, count(l.target_delta) AS label_n, avg(l.target_delta) AS label_mean, stddev_pop(l.target_delta) AS sd
  FROM (SELECT DISTINCT dam, date FROM model_table) d
  LEFT JOIN model_table l ON l.dam = d.dam AND l.target_delta IS NOT NULL AND l.label_date <= d.date GROUP BY 1, 2),
scaled AS (SELECT *, CASE WHEN label_n >= 2 AND sd > 1e-6 THEN sd END AS scale FROM past),
prepared AS MATERIALIZED (SELECT m.*, s.scale, coalesce(s.scale, 1) AS unit,
    label_mean * label_n / (label_n + 5.0) / coalesce(s.scale, 1) AS dam_effect
  FROM model_table m JOIN scaled s USING (dam, date))"""


def ridge_ctes(source: str, out: str, features, pool: str, penalty: float = 1.0, target: str = "target_delta / unit", weight: str = "1.0") -> str:
    """CTEs up to `out`: the rows of `source` with _fit, the prediction of a weighted ridge on the
    labels known at their date, NULL where these weigh less than two.

    Features are centred and scaled by the moments known then; the normal equations are
    solved by elimination, one pivot a step.
    """
    every = range(1, len(features) + 1)
    x = ", ".join(f"CAST({f} AS DOUBLE) AS x{j}" for j, f in zip(every, features))
    moments = ", ".join(f"sum(_w * x{j}) / sum(_w) FILTER (x{j} IS NOT NULL) AS c{j}, sum(_w * x{j} * x{j}) / sum(_w) FILTER (x{j} IS NOT NULL) AS q{j}" for j in every)
    spreads = ", ".join(
        f"CASE WHEN sqrt(greatest(q{j} - c{j} * c{j}, 0)) > greatest(1e-6, 1e-6 * abs(c{j})) THEN sqrt(greatest(q{j} - c{j} * c{j}, 0)) END AS s{j}" for j in every)
    z = ", ".join(f"coalesce((x{j} - c{j}) / s{j}, 0) AS z{j}" for j in every)
    cells = ", ".join(f"sum(_w * z{i} * z{j}) AS g{i}_{j}" for i in every for j in every if i <= j)
    sides = ", ".join(f"sum(_w * z{i} * _t) AS h{i}" for i in every)
    matrix = ", ".join("[" + ", ".join(f"g{min(i, j)}_{max(i, j)}" + (f" + {penalty}" if i == j else "") for j in every) + f", h{i}]" for i in every)
    terms = " + ".join(f"CASE WHEN x{j} IS NULL OR s{j} IS NULL THEN 0 ELSE m[{j}][{len(features) + 1}] * greatest(least((x{j} - c{j}) / s{j}, 5), -5) END" for j in every)
    size = len(features)
    return f"""{out}_rows AS MATERIALIZED (SELECT *, {pool} AS _pool, {target} AS _t, {weight} AS _w, {x} FROM {source}),
{out}_moments AS (SELECT d._pool, d.date, sum(_w) AS n, sum(_w * _t) / sum(_w) AS level, {moments}
  FROM (SELECT DISTINCT _pool, date FROM {out}_rows) d
  JOIN {out}_rows r ON r._pool = d._pool AND r._t IS NOT NULL AND r.label_date <= d.date GROUP BY 1, 2),
{out}_spreads AS MATERIALIZED (SELECT *, {spreads} FROM {out}_moments),
{out}_sums AS (SELECT _pool, date, {cells}, {sides} FROM (
    SELECT s._pool, s.date, _w, _t, {z} FROM {out}_spreads s JOIN {out}_rows r ON r._pool = s._pool AND r._t IS NOT NULL AND r.label_date <= s.date)
  GROUP BY 1, 2),
{out}_steps AS (
  SELECT _pool, date, 1 AS k, [{matrix}] AS m FROM {out}_sums
  UNION ALL SELECT _pool, date, k + 1,
    [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END FOR j IN range(1, {size + 2})] FOR i IN range(1, {size + 1})]
  FROM {out}_steps WHERE k <= {size}),
{out} AS MATERIALIZED (SELECT r.* EXCLUDE ({", ".join(f"x{j}" for j in every)}, _t, _w),
    CASE WHEN s.n >= 2 THEN s.level + {terms} END AS _fit
  FROM {out}_rows r LEFT JOIN {out}_spreads s ON s._pool = r._pool AND s.date = r.date
  LEFT JOIN {out}_steps e ON e._pool = r._pool AND e.date = r.date AND e.k = {size + 1})"""


def error_ctes(source: str, model: str = "coalesce(_fit * unit, 0)") -> str:
    return f"""final_errors AS (SELECT dam, date, horizon, fcst_source, target_delta AS actual, {model} AS model,
    abs({model} - target_delta) AS abs_err_model, abs(target_delta) AS abs_err_persistence,
    abs(coalesce(dev_24h_m * horizon, 0) - target_delta) AS abs_err_drift FROM {source} WHERE target_delta IS NOT NULL)"""


BOARD = """board AS (
  SELECT horizon, count(*) AS n, round(avg(abs_err_model), 4) AS mae_model, round(avg(abs_err_persistence), 4) AS mae_persistence,
    round(avg(abs_err_drift), 4) AS mae_drift FROM final_errors GROUP BY horizon),
shown AS (SELECT *, n >= 200 AS enough_data, CAST(200 AS BIGINT) AS min_scored,
    CASE WHEN mae_persistence <= mae_drift THEN 'persistence' ELSE 'drift' END AS best_baseline,
    least(mae_persistence, mae_drift) AS mae_best_baseline,
    n >= 200 AND mae_model < least(mae_persistence, mae_drift) AS beats_baseline FROM board)"""
INPUTS = (*BASE_FEATURES, "dam_effect", "horizon")
BACKTEST = (*FEATURE_CTES, PREPARED, ridge_ctes("prepared", "fitted", INPUTS, "0"), error_ctes("fitted"))

# Each pass weighs a label by its miss in the former one, against the pool's mean miss when it came in.
HUBER = ",\n".join(
    [ridge_ctes("prepared", "pass1", (*TINY_FEATURES, "horizon"), "0")] + [
        f"""missed{k} AS MATERIALIZED (SELECT *, abs(target_delta - coalesce(_fit * unit, 0)) / unit AS miss FROM pass{k}),
usual{k} AS (SELECT d.label_date, avg(l.miss) AS usual FROM (SELECT DISTINCT label_date FROM missed{k}) d
  JOIN missed{k} l ON l.miss IS NOT NULL AND l.label_date <= d.label_date GROUP BY 1),
weighed{k} AS (SELECT m.* EXCLUDE (_pool, _fit, miss), CASE WHEN miss > 1.35 * usual THEN 1.35 * usual / miss ELSE 1.0 END AS weight{k}
  FROM missed{k} m LEFT JOIN usual{k} USING (label_date)),
{ridge_ctes(f"weighed{k}", f"pass{k + 1}", (*TINY_FEATURES, "horizon"), "0", weight=f"weight{k}")}""" for k in (1, 2)])

ALERT_TARGETS = """rivers AS (SELECT *, CAST(on_watch AS DOUBLE) AS watch_today FROM alerts WHERE kind = 'river_basin'),
islands AS (SELECT *, sum(CASE WHEN on_watch THEN 0 ELSE 1 END) OVER (PARTITION BY basin ORDER BY date) AS island FROM rivers),
history AS (SELECT i.basin, i.date, i.on_watch, i.watch_today,
    avg(i.watch_today) OVER (PARTITION BY i.basin ORDER BY i.date ROWS 2 PRECEDING) AS watch_3d,
    avg(i.watch_today) OVER (PARTITION BY i.basin ORDER BY i.date ROWS 6 PRECEDING) AS watch_7d,
    row_number() OVER (PARTITION BY i.basin, island ORDER BY i.date) - 1 AS streak, n.national_share
  FROM islands i JOIN (SELECT date, avg(watch_today) AS national_share FROM rivers GROUP BY date) n ON n.date = i.date),
alert_targets AS (SELECT a.*, CAST(h.horizon AS INTEGER) AS horizon, CAST(f.on_watch AS INTEGER) AS target
  FROM history a CROSS JOIN range(1, 4) h(horizon) JOIN rivers f ON f.basin = a.basin AND f.date = a.date + CAST(h.horizon AS INTEGER))"""

# Newton steps: each pass fits the logistic made straight at the former one's predictor.
LOGISTIC = ",\n".join(
    ["""labels AS (SELECT t.*, t.date + CAST(horizon AS INTEGER) AS label_date, basin AS dam FROM alert_targets t),
worked0 AS (SELECT *, 1.0 AS weight0, (target - 0.5) / 0.25 AS work0 FROM labels)"""] + [
        f"""{ridge_ctes(f"worked{k}", f"step{k + 1}", ALERT_FEATURES, "basin || '|' || horizon", target=f"work{k}", weight=f"weight{k}")},
at{k + 1} AS (SELECT * EXCLUDE (_pool, _fit), _fit AS fit{k + 1}, greatest(least(coalesce(_fit, 0), 6), -6) AS at{k + 1} FROM step{k + 1}),
chance{k + 1} AS (SELECT *, 1 / (1 + exp(-at{k + 1})) AS p{k + 1} FROM at{k + 1}),
worked{k + 1} AS (SELECT *, 4 * p{k + 1} * (1 - p{k + 1}) AS weight{k + 1}, at{k + 1} + (target - p{k + 1}) / (p{k + 1} * (1 - p{k + 1})) AS work{k + 1}
  FROM chance{k + 1})""" for k in (0, 1, 2)])
SCORED = """scored AS (SELECT horizon, target AS actual, CAST(on_watch AS INTEGER) AS persistence,
    CAST(fit3 IS NOT NULL AND round(1 / (1 + exp(-greatest(least(fit3, 30), -30))), 9) >= 0.5 AS INTEGER) AS pred FROM worked3)"""
CONFUSION = """SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n,
  count(*) FILTER (pred = 1 AND actual = 1) AS model_tp, count(*) FILTER (pred = 1 AND actual = 0) AS model_fp,
  count(*) FILTER (pred = 0 AND actual = 1) AS model_fn, round(avg(CASE WHEN pred = actual THEN 1.0 ELSE 0.0 END), 6) AS model_accuracy,
  count(*) FILTER (persistence = 1 AND actual = 1) AS persistence_tp, count(*) FILTER (persistence = 1 AND actual = 0) AS persistence_fp,
  count(*) FILTER (persistence = 0 AND actual = 1) AS persistence_fn,
  round(avg(CASE WHEN persistence = actual THEN 1.0 ELSE 0.0 END), 6) AS persistence_accuracy,
  round(model_tp / nullif(model_tp + model_fn, 0), 6) AS model_recall, round(model_tp / nullif(model_tp + model_fp, 0), 6) AS model_precision,
  round(persistence_tp / nullif(persistence_tp + persistence_fn, 0), 6) AS persistence_recall,
  round(persistence_tp / nullif(persistence_tp + persistence_fp, 0), 6) AS persistence_precision,
  coalesce(model_tp / nullif(model_tp + model_fn, 0) > persistence_tp / nullif(persistence_tp + persistence_fn, 0), FALSE) AS beats_baseline
FROM scored GROUP BY horizon"""

# Weights of the linear learner, the horizon's mean and no change, from their losses so far.
ENSEMBLE = f"""{ridge_ctes("prepared", "linear", (*LEAN_FEATURES, "horizon"), "0")},
level AS (SELECT d.dam, d.date, count(*) AS n, avg(r.target_delta / r.unit) AS mean FROM (SELECT DISTINCT dam, date FROM prepared) d
  JOIN prepared r ON r.dam = d.dam AND r.target_delta IS NOT NULL AND r.label_date <= d.date GROUP BY 1, 2),
experts AS MATERIALIZED (SELECT l.*, coalesce(_fit * unit, 0) AS e1, CASE WHEN n >= 2 THEN mean * unit ELSE 0 END AS e2, 0.0 AS e3
  FROM linear l LEFT JOIN level v ON v.dam = l.dam AND v.date = l.date),
lost AS MATERIALIZED (SELECT *, greatest(abs(e1 - target_delta), abs(e2 - target_delta), abs(e3 - target_delta), 1e-6) AS worst FROM experts),
losses AS (SELECT d.horizon, d.date, coalesce(sum(abs(e1 - target_delta) / worst), 0) AS l1, coalesce(sum(abs(e2 - target_delta) / worst), 0) AS l2,
    coalesce(sum(abs(e3 - target_delta) / worst), 0) AS l3
  FROM (SELECT DISTINCT horizon, date FROM lost) d
  LEFT JOIN lost r ON r.horizon = d.horizon AND r.target_delta IS NOT NULL AND r.label_date <= d.date GROUP BY 1, 2),
mixed AS (SELECT x.*, (exp(-0.1 * (l1 - least(l1, l2, l3))) * e1 + exp(-0.1 * (l2 - least(l1, l2, l3))) * e2 + exp(-0.1 * (l3 - least(l1, l2, l3))) * e3)
    / (exp(-0.1 * (l1 - least(l1, l2, l3))) + exp(-0.1 * (l2 - least(l1, l2, l3))) + exp(-0.1 * (l3 - least(l1, l2, l3)))) AS blended
  FROM lost x JOIN losses s ON s.horizon = x.horizon AND s.date = x.date)"""


@register("ridge_prequential")
def ridge_prequential(spark, folder):
    errors = backtest.backtest(events_table(spark, folder))
    return rounded(errors.select(*KEYS, "fcst_source", "actual", "model", "abs_err_model", "abs_err_persistence", "abs_err_drift"), 4)


TWO = ("dev_24h_m", "rain_3d")


@register("ridge_two_features", f"""{recursive(*FEATURE_CTES, PREPARED, ridge_ctes("prepared", "fitted", TWO, "horizon", 10.0))}
SELECT dam, date, horizon, round(coalesce(_fit * unit, 0), 4) AS model FROM fitted""")
def ridge_two_features(spark, folder):
    """Each row's prediction by the learner of its horizon, on two features."""
    rows = ridges.ridge(backtest.prepared(events_table(spark, folder)), TWO, "dam", 10.0)
    return rounded(rows.select(*KEYS, "model"), 4)


@register("ridge_scoreboard", f"{recursive(*BACKTEST, BOARD)} SELECT * FROM shown")
def ridge_scoreboard(spark, folder):
    return scoreboard.scoreboard(backtest.backtest(events_table(spark, folder)))


@register("backtest_resumed", f"{recursive(*BACKTEST, BOARD)} SELECT * FROM shown")
def backtest_resumed(spark, folder):
    """A backtest of three runs, each reading the days since the last one, scored together."""
    # Only what the runs read of a row is written, for each run writes its days again.
    table = materialise(events_table(spark, folder).select(*KEYS, "fcst_source", "target_delta", *BASE_FEATURES), "table")
    progress = backtest.Progress(work_folder(spark, "backtest"))
    for cut in ("2024-01-15", "2024-01-16"):
        day = F.lit(cut).cast("date")
        known = F.when(F.date_add("date", F.col("horizon").cast("int")) <= day, F.col("target_delta"))
        backtest.resume(progress, table.filter(F.col("date") <= day).withColumn("target_delta", known))
    last = backtest.resume(progress, table)
    return scoreboard.scoreboard(spark.read.schema(last.schema).parquet(progress.at("errors")))


@register("ridge_by_source", f"""{recursive(*BACKTEST)}
SELECT fcst_source, round(avg(abs_err_model), 4) AS mae_model, count(*) AS n FROM final_errors GROUP BY 1""")
def ridge_by_source(spark, folder):
    return rounded(scoreboard.by_source(backtest.backtest(events_table(spark, folder))), 4)


@register("ridge_per_dam", f"""{recursive(*FEATURE_CTES, PREPARED, ridge_ctes("prepared", "fitted", INPUTS, "dam", 5.0), error_ctes("fitted"), BOARD)}
SELECT * FROM shown""")
def ridge_per_dam(spark, folder):
    errors = backtest.backtest(events_table(spark, folder), pooling="horizon", penalty=5.0)
    return scoreboard.scoreboard(errors)


@register("bagged_ridge")
def bagged_ridge(spark, folder):
    rows = backtest.prepared(events_table(spark, folder))
    bag = ridges.bagged_ridge(rows, [*search.feature_columns("lean"), "horizon"], KEYS)
    return scoreboard.scoreboard(backtest.errors_of(labelled(bag)))


@register("forest_walkforward")
def forest_walkforward(spark, folder):
    rows = labelled(backtest.prepared(events_table(spark, folder)))
    scored = walkforward.walk_forward(rows, [*search.feature_columns("base"), "dam_effect"], "forest", walkforward.week_start())
    return scoreboard.scoreboard(backtest.errors_of(scored))


STUMP = ("dev_24h_m", "rain_3d", "horizon")
# Every cut between two values of a feature, missing ones below all; the one that leaves least squared error.
STUMPS = f"""rows AS MATERIALIZED (SELECT dam, date, horizon, label_date, CAST(date_trunc('week', date) AS DATE) AS block,
    CAST(round(target_delta / 1e-6) AS BIGINT) AS y, {", ".join(f"coalesce(CAST({f} AS DOUBLE), -1e300) AS x{j}" for j, f in enumerate(STUMP))}
  FROM model_table WHERE target_delta IS NOT NULL),
learners AS (SELECT DISTINCT dam, block FROM rows),
known AS MATERIALIZED (SELECT l.dam, l.block, r.y, u.feature, u.x FROM learners l JOIN rows r ON r.dam = l.dam AND r.label_date < l.block
  CROSS JOIN LATERAL (VALUES {", ".join(f"({j}, r.x{j})" for j in range(len(STUMP)))}) u(feature, x)),
whole AS (SELECT dam, block, count(*) // {len(STUMP)} AS n, CAST(sum(y) AS BIGINT) // {len(STUMP)} AS s FROM known GROUP BY 1, 2),
cuts AS (SELECT DISTINCT dam, block, feature, x AS cut FROM known),
sides AS (SELECT c.dam, c.block, c.feature, c.cut, count(*) AS nl, CAST(sum(k.y) AS BIGINT) AS sl FROM cuts c
  JOIN known k ON k.dam = c.dam AND k.block = c.block AND k.feature = c.feature AND k.x <= c.cut GROUP BY 1, 2, 3, 4),
scored AS (SELECT d.*, n, s, power(CAST(s AS DOUBLE), 2) / n AS base,
    power(CAST(sl AS DOUBLE), 2) / nl + power(CAST(s - sl AS DOUBLE), 2) / (n - nl) AS score FROM sides d JOIN whole w USING (dam, block) WHERE nl < n),
best AS (SELECT *, max(score) OVER (PARTITION BY dam, block) AS top FROM scored),
chosen AS (SELECT * FROM best WHERE top - base > 1e-9 * greatest(base, 1) AND score >= top - 1e-9 * (top - base)
  QUALIFY row_number() OVER (PARTITION BY dam, block ORDER BY feature, cut) = 1)"""


@register("stump_per_dam", f"""{recursive(*FEATURE_CTES, STUMPS)}
SELECT r.dam, r.date, r.horizon, round(CASE WHEN w.n IS NULL OR w.n < 2 THEN 0 WHEN c.cut IS NULL THEN w.s / w.n
    WHEN CASE c.feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= c.cut THEN sl / nl ELSE (c.s - sl) / (c.n - nl) END * 1e-6, 4) AS model
FROM rows r LEFT JOIN whole w USING (dam, block) LEFT JOIN chosen c USING (dam, block)""")
def stump_per_dam(spark, folder):
    """The best single cut for each dam, refitted every week."""
    rows = labelled(events_table(spark, folder)).withColumn("label_date", F.date_add("date", F.col("horizon").cast("int")))
    grown = trees.walk(rows, STUMP, KEYS, trees.Trees(depth=1), "horizon", F.col("target_delta"), walkforward.week_start())
    return grown.select(*KEYS, F.round(F.coalesce("_trees", F.lit(0.0)), 4).alias("model"))


@register("forest_per_dam")
def forest_per_dam(spark, folder):
    """A forest of its own for each dam, over all horizons."""
    rows = labelled(backtest.prepared(events_table(spark, folder)))
    scored = walkforward.walk_forward(rows, search.feature_columns("lean"), "forest10", walkforward.week_start(), pooling="horizon")
    return scoreboard.scoreboard(backtest.errors_of(scored))


@register("boosted_walkforward")
def boosted_walkforward(spark, folder):
    """Boosted trees for each horizon, over all dams."""
    rows = labelled(backtest.prepared(events_table(spark, folder)))
    scored = walkforward.walk_forward(rows, [*search.feature_columns("tiny"), "dam_effect"], "boosted", walkforward.week_start(), pooling="dam")
    return scoreboard.scoreboard(backtest.errors_of(scored))


@register("expert_sweep")
def expert_sweep(spark, folder):
    """Ensembles of learned experts beside their members, which are fitted once."""
    return search.sweep(events_table(spark, folder), split="2024-01-21", models=("ridge:1", "tree", "knn10", "ewa"), features=("tiny",),
                        poolings=("horizon",), scales=(True,), shrinks=(1.0, 0.6))


@register("tree_walkforward")
def tree_walkforward(spark, folder):
    rows = labelled(backtest.prepared(events_table(spark, folder)))
    scored = walkforward.walk_forward(rows, search.feature_columns("lean"), "tree", walkforward.week_start())
    return scoreboard.scoreboard(backtest.errors_of(scored))


@register("huber_walkforward", f"{recursive(*FEATURE_CTES, PREPARED, HUBER, error_ctes('pass3'), BOARD)} SELECT * FROM shown")
def huber_walkforward(spark, folder):
    rows = backtest.prepared(events_table(spark, folder))
    inputs = list(search.feature_columns("tiny"))
    # Each pass writes its rows: only what the passes and the errors read goes with them.
    rows = rows.select(*dict.fromkeys([*KEYS, "label_date", "fcst_source", "target_delta", "scale", "dev_24h_m", *inputs]))
    scored = labelled(reweighted.huber(rows, [*inputs, "horizon"]))
    return scoreboard.scoreboard(backtest.errors_of(scored))


@register("weighted_ensemble", f"{recursive(*FEATURE_CTES, PREPARED, ENSEMBLE, error_ctes('mixed', 'blended'), BOARD)} SELECT * FROM shown")
def weighted_ensemble(spark, folder):
    """Exponentially weighted mean of two learners and the naive forecasts."""
    rows = backtest.prepared(events_table(spark, folder))
    rows = ridges.ridge(rows, [*search.feature_columns("lean"), "horizon"], name="linear")
    rows = search.causal_mean(rows, "horizon", True, "level")
    mixed = expert_blend(rows.withColumn("persistence", F.lit(0.0)), ["linear", "level", "persistence"], 0.1, ["horizon"], "model")
    return scoreboard.scoreboard(backtest.errors_of(labelled(mixed)))


@register("alert_walkforward", f"{recursive(ALERTS, ALERT_TARGETS, LOGISTIC, SCORED)} {CONFUSION}")
def alert_walkforward(spark, folder):
    targets = alert_targets(alert_features(views.alerts(spark, folder)))
    return rounded(confusion(walkforward.alert_forecasts(targets)))


@register("ridge_sweep")
def ridge_sweep(spark, folder):
    """Dev and holdout scores of ridge configurations over pooled learners."""
    return search.sweep(
        events_table(spark, folder), split="2024-01-21", models=("ridge:1", "ridge:100"), features=("base", "lean"),
        poolings=("dam", "all"), scales=(True,), stacks=(False, True), shrinks=(1.0, 0.8, 0.6, 0.4, 0.2), blends=(0.0, 0.3, 0.6, 1.0, 2.0))
