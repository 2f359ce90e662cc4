"""Label-gated statistics, blending, search scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions.registry import with_baselines
from headwater.operators import causal, drift, neighbours, search
from headwater.operators.targets import labelled, with_label_date
from headwater.plans import search as sweep
from headwater.plans.roles import events_table
from headwater.queries.common import (
    DAILY, CHANGE, ERROR_CTES, FEATURE_CTES, REVERSION, TARGETS, query_set, reversion_errors, reversion_table,
    rounded, with_ctes,
)

from headwater.session import materialise

QUERIES, ORACLES, register = query_set()

SPLIT = "2024-01-21"

SCALE = """scales AS (
  SELECT r.dam, r.date, count(l.target_delta) AS label_n, avg(l.target_delta) AS label_mean,
    CASE WHEN count(l.target_delta) >= 2 AND stddev_pop(l.target_delta) > 1e-6 THEN stddev_pop(l.target_delta) END AS scale
  FROM (SELECT DISTINCT dam, date FROM targets) r
  LEFT JOIN targets l ON l.dam = r.dam AND l.target_delta IS NOT NULL AND l.label_date <= r.date GROUP BY 1, 2)"""


@register("causal_scale", f"""{with_ctes(DAILY, CHANGE, TARGETS, SCALE)},
all_days AS (SELECT DISTINCT dam, date FROM (SELECT dam, date FROM targets UNION ALL SELECT dam, label_date FROM targets WHERE target_delta IS NOT NULL))
SELECT dam, date, label_n, round(label_mean * label_n, 4) AS label_total, round(scale, 6) AS scale FROM scales JOIN all_days USING (dam, date)""")
def causal_scale(spark, folder):
    scales = causal.target_scale(reversion_table(spark, folder))
    total = F.round(F.col("label_mean") * F.col("label_n"), 4).alias("label_total")
    return scales.select("dam", "date", "label_n", total, F.round("scale", 6).alias("scale"))


@register("causal_scaled_target", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, SCALE)}
SELECT dam, date, horizon, round(target_delta / coalesce(scale, 1), 6) AS scaled_target, round(model * coalesce(scale, 1), 4) AS unscaled
FROM reversion JOIN scales USING (dam, date) WHERE target_delta IS NOT NULL""")
def causal_scaled_target(spark, folder):
    rows = causal.with_target_scale(reversion_table(spark, folder))
    return labelled(rows).select(
        "dam", "date", "horizon", F.round(causal.scaled_target(), 6).alias("scaled_target"),
        F.round(causal.unscaled(F.col("model")), 4).alias("unscaled"))


@register("causal_zscore", f"""{with_ctes(DAILY, CHANGE, TARGETS)},
stats AS (SELECT d.horizon, d.date, count(l.rwl_m) AS n_rwl, avg(l.rwl_m) AS m_rwl, stddev_pop(l.rwl_m) AS s_rwl,
    count(l.dev_24h_m) AS n_dev, avg(l.dev_24h_m) AS m_dev, stddev_pop(l.dev_24h_m) AS s_dev
  FROM (SELECT DISTINCT horizon, date FROM targets) d
  LEFT JOIN targets l ON l.horizon = d.horizon AND l.target_delta IS NOT NULL AND l.label_date <= d.date GROUP BY 1, 2)
SELECT dam, t.date, t.horizon,
  round(CASE WHEN n_rwl < 2 THEN 0 WHEN s_rwl < 1e-6 THEN rwl_m ELSE greatest(least((rwl_m - m_rwl) / s_rwl, 5), -5) END, 6) AS z_rwl_m,
  round(CASE WHEN dev_24h_m IS NULL THEN NULL WHEN n_dev < 2 THEN 0 WHEN s_dev < 1e-6 THEN dev_24h_m
    ELSE greatest(least((dev_24h_m - m_dev) / s_dev, 5), -5) END, 6) AS z_dev_24h_m
FROM targets t JOIN stats USING (horizon, date)""")
def causal_zscore(spark, folder):
    rows = causal.with_causal_z(reversion_table(spark, folder), ["rwl_m", "dev_24h_m"], ["horizon"])
    return rounded(rows.select("dam", "date", "horizon", "z_rwl_m", "z_dev_24h_m"))


@register("causal_zscore_global", f"""{with_ctes(DAILY, CHANGE, TARGETS)},
stats AS (SELECT d.date, count(l.rwl_m) AS n, avg(l.rwl_m) AS m, stddev_pop(l.rwl_m) AS s
  FROM (SELECT DISTINCT date FROM targets) d LEFT JOIN targets l ON l.target_delta IS NOT NULL AND l.label_date <= d.date GROUP BY 1)
SELECT dam, t.date, t.horizon, round(CASE WHEN n < 2 THEN 0 WHEN s < 1e-6 THEN rwl_m ELSE greatest(least((rwl_m - m) / s, 5), -5) END, 6) AS z_rwl_m
FROM targets t JOIN stats USING (date)""")
def causal_zscore_global(spark, folder):
    rows = causal.with_causal_z(reversion_table(spark, folder), ["rwl_m"])
    return rounded(rows.select("dam", "date", "horizon", "z_rwl_m"))


@register("expert_blend", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)},
experts AS (SELECT *, CAST(0 AS DOUBLE) AS persistence, coalesce(dev_24h_m * horizon, 0) AS drift FROM reversion),
losses AS (SELECT horizon, label_date, abs(model - target_delta) AS a, abs(target_delta) AS b, abs(drift - target_delta) AS c
  FROM experts WHERE target_delta IS NOT NULL),
blocks AS (SELECT horizon, label_date, sum(a / greatest(a, b, c, 1e-6)) AS a, sum(b / greatest(a, b, c, 1e-6)) AS b,
  sum(c / greatest(a, b, c, 1e-6)) AS c FROM losses GROUP BY 1, 2),
past AS (SELECT d.horizon, d.date, coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b, coalesce(sum(c), 0) AS c
  FROM (SELECT DISTINCT horizon, date FROM experts) d LEFT JOIN blocks l ON l.horizon = d.horizon AND l.label_date <= d.date GROUP BY 1, 2),
weights AS (SELECT horizon, date, exp(-0.6 * (a - least(a, b, c))) AS wa, exp(-0.6 * (b - least(a, b, c))) AS wb, exp(-0.6 * (c - least(a, b, c))) AS wc FROM past)
SELECT dam, e.date, e.horizon, round((wa * model + wb * persistence + wc * drift) / (wa + wb + wc), 6) AS blended,
  round(wa / (wa + wb + wc), 6) AS w_model FROM experts e JOIN weights w ON w.horizon = e.horizon AND w.date = e.date""")
def expert_blend(spark, folder):
    rows = with_baselines(reversion_table(spark, folder))
    mixed = causal.expert_blend(rows, ["model", "persistence", "drift"], 0.6, ["horizon"])
    return rounded(mixed.select("dam", "date", "horizon", "blended", "w_model"))


@register("mean_shift", f"""{with_ctes(*ERROR_CTES)},
logged AS (SELECT dam, horizon, label_date AS target_date, abs_err_model FROM errors),
stats AS (SELECT *, count(*) OVER now AS recent_n, avg(abs_err_model) OVER now AS recent_mean, count(*) OVER past AS past_n,
    avg(abs_err_model) OVER past AS past_mean, max(abs_err_model) OVER sofar - min(abs_err_model) OVER sofar AS spread
  FROM logged WINDOW now AS (PARTITION BY dam, horizon ORDER BY target_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    past AS (PARTITION BY dam, horizon ORDER BY target_date ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING),
    sofar AS (PARTITION BY dam, horizon ORDER BY target_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT dam, horizon, target_date, recent_n, past_n, round(recent_mean * recent_n, 6) AS recent_total, round(past_mean * past_n, 6) AS past_total,
  coalesce(past_n >= 5 AND abs(recent_mean - past_mean) > spread * sqrt((1 / recent_n + 1 / nullif(past_n, 0)) * ln(2 / 0.2) / 2) + 1e-9, FALSE) AS shifted
FROM stats""")
def mean_shift(spark, folder):
    logged = reversion_errors(spark, folder).select("dam", "horizon", F.col("label_date").alias("target_date"), "abs_err_model")
    tested = drift.mean_shift(logged, recent=5, delta=0.2)
    return tested.select(
        "dam", "horizon", "target_date", "recent_n", "past_n", "shifted",
        F.round(F.col("recent_mean") * F.col("recent_n"), 6).alias("recent_total"),
        F.round(F.col("past_mean") * F.col("past_n"), 6).alias("past_total"))


@register("drift_events")
def drift_events(spark, folder):
    logged = reversion_errors(spark, folder).withColumnRenamed("label_date", "target_date")
    return drift.drift_events(logged, delta=0.2)


# --- the search -----------------------------------------------------------

MEAN_SWEEP = """known AS (SELECT * FROM targets WHERE target_delta IS NOT NULL),
sc AS (SELECT r.dam, r.date, count(l.target_delta) AS n, stddev_pop(l.target_delta) AS sd
  FROM (SELECT DISTINCT dam, date FROM known) r LEFT JOIN known l ON l.dam = r.dam AND l.label_date <= r.date GROUP BY 1, 2),
sized AS (SELECT k.*, coalesce(dev_24h_m * horizon, 0) AS drift, CASE WHEN n >= 5 THEN greatest(sd, 1e-3) ELSE 1 END AS scale
  FROM known k JOIN sc USING (dam, date)),
pooled AS (SELECT s.*, p.pooling, f.scale_target, CASE p.pooling WHEN 'none' THEN dam || '|' || horizon WHEN 'dam' THEN CAST(horizon AS VARCHAR)
    WHEN 'horizon' THEN dam ELSE 'all' END AS pool, CASE WHEN f.scale_target THEN scale ELSE 1 END AS factor
  FROM sized s, (VALUES ('none'), ('dam'), ('horizon'), ('all')) p(pooling), (VALUES (FALSE), (TRUE)) f(scale_target)),
sums AS (SELECT pooling, scale_target, pool, label_date, count(*) AS n, sum(target_delta / factor) AS y FROM pooled GROUP BY ALL),
means AS (SELECT d.pooling, d.scale_target, d.pool, d.date, CASE WHEN sum(n) >= 2 THEN sum(y) / sum(n) ELSE 0 END AS m
  FROM (SELECT DISTINCT pooling, scale_target, pool, date FROM pooled) d
  LEFT JOIN sums s ON s.pooling = d.pooling AND s.scale_target = d.scale_target AND s.pool = d.pool AND s.label_date <= d.date GROUP BY ALL),
shrunk AS (SELECT p.*, h.shrink, coalesce(m, 0) * factor * h.shrink AS pred
  FROM pooled p JOIN means m ON m.pooling = p.pooling AND m.scale_target = p.scale_target AND m.pool = p.pool AND m.date = p.date,
  (VALUES (CAST(1.0 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) h(shrink)),
loss AS (SELECT *, abs(pred - target_delta) AS a, abs(target_delta) AS b, abs(drift - target_delta) AS c FROM shrunk),
lossblocks AS (SELECT pooling, scale_target, shrink, pool, label_date, sum(a / greatest(a, b, c, 1e-6)) AS a,
  sum(b / greatest(a, b, c, 1e-6)) AS b, sum(c / greatest(a, b, c, 1e-6)) AS c FROM loss GROUP BY ALL),
lost AS (SELECT d.pooling, d.scale_target, d.shrink, d.pool, d.date, coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b, coalesce(sum(c), 0) AS c
  FROM (SELECT DISTINCT pooling, scale_target, shrink, pool, date FROM shrunk) d LEFT JOIN lossblocks l ON l.pooling = d.pooling
    AND l.scale_target = d.scale_target AND l.shrink = d.shrink AND l.pool = d.pool AND l.label_date <= d.date GROUP BY ALL),
w AS (SELECT *, exp(-0.6 * (a - least(a, b, c))) AS wa, exp(-0.6 * (b - least(a, b, c))) AS wb, exp(-0.6 * (c - least(a, b, c))) AS wc FROM lost),
finals AS (
  SELECT pooling, scale_target, shrink, CAST(0 AS DOUBLE) AS blend, date, horizon, target_delta, drift, pred FROM shrunk
  UNION ALL SELECT s.pooling, s.scale_target, s.shrink, CAST(0.6 AS DOUBLE), s.date, horizon, target_delta, drift, (wa * pred + wc * drift) / (wa + wb + wc)
  FROM shrunk s JOIN w ON w.pooling = s.pooling AND w.scale_target = s.scale_target AND w.shrink = s.shrink AND w.pool = s.pool AND w.date = s.date),
judged AS (SELECT *, CASE WHEN date >= DATE '2024-01-21' THEN 'holdout' ELSE 'dev' END AS split FROM finals),
per AS (SELECT pooling, scale_target, shrink, blend, split, horizon, count(*) AS n, avg(abs(pred - target_delta)) AS mae, sum(abs(pred - target_delta)) AS total,
  least(avg(abs(target_delta)), avg(abs(drift - target_delta))) AS best FROM judged GROUP BY ALL),
overall AS (SELECT pooling, scale_target, shrink, blend, split, round(sum(total) / sum(n), 4) AS mae, count(*) FILTER (round(mae, 9) < round(best, 9)) AS n_wins, count(*) AS n_horizons,
  round(avg(least(mae / greatest(best, 1e-6), 3)), 4) AS mean_ratio, round(max(least(mae / greatest(best, 1e-6), 3)), 4) AS worst_ratio FROM per GROUP BY ALL),
wide AS (SELECT d.pooling, d.scale_target, d.shrink, d.blend, d.mae AS dev_mae, d.n_wins AS dev_n_wins, d.mean_ratio AS dev_mean_ratio, d.worst_ratio AS dev_worst_ratio,
  h.mae AS holdout_mae, h.n_wins AS holdout_n_wins, h.mean_ratio AS holdout_mean_ratio, round(h.mean_ratio - d.mean_ratio, 4) AS slippage
  FROM overall d LEFT JOIN overall h ON h.pooling = d.pooling AND h.scale_target = d.scale_target AND h.shrink = d.shrink AND h.blend = d.blend AND h.split = 'holdout'
  WHERE d.split = 'dev')"""

SWEEP_CTES = (DAILY, CHANGE, TARGETS, MEAN_SWEEP)
VARIED = ("pooling", "scale_target", "shrink", "blend")


MEAN_GRID = dict(models=["mean"], poolings=causal.POOLINGS, scales=(False, True), shrinks=(1.0, 0.5), blends=(0.0, 0.6), split=SPLIT)


def _mean_table(spark, folder):
    return reversion_table(spark, folder).drop("model", "label_date")


def _mean_errors(spark, folder):
    return sweep.sweep_errors(_mean_table(spark, folder), **MEAN_GRID)


def _mean_wide(spark, folder):
    return sweep.sweep(_mean_table(spark, folder), **MEAN_GRID)


WIDE = ("dev_mae", "dev_n_wins", "dev_mean_ratio", "dev_worst_ratio", "holdout_mae", "holdout_n_wins", "holdout_mean_ratio", "slippage")


@register("sweep_scores", f"{with_ctes(*SWEEP_CTES)} SELECT {', '.join(VARIED + WIDE)} FROM wide")
def sweep_scores(spark, folder):
    return _mean_wide(spark, folder).select(*VARIED, *WIDE)


@register("capped_ratio", f"""{with_ctes(*SWEEP_CTES)}
SELECT pooling, scale_target, shrink, blend, split, horizon, n, round(mae, 4) AS mae, round(best, 4) AS best_baseline,
  round(least(mae / greatest(best, 1e-6), 3), 4) AS ratio, round(mae, 9) < round(best, 9) AS wins FROM per""")
def capped_ratio(spark, folder):
    per, _ = search.config_scores(_mean_errors(spark, folder))
    return per.select(*VARIED, "split", "horizon", "n", "mae", "best_baseline", "ratio", "wins")


@register("top_configs", f"""{with_ctes(*SWEEP_CTES)}
SELECT {', '.join(VARIED)}, dev_mean_ratio, dev_n_wins FROM wide ORDER BY dev_mean_ratio, dev_n_wins DESC, {', '.join(VARIED)} LIMIT 20""")
def top_configs(spark, folder):
    return search.top_configs(_mean_wide(spark, folder)).select(*VARIED, "dev_mean_ratio", "dev_n_wins")


@register("dev_rank", f"""{with_ctes(*SWEEP_CTES)}
SELECT {', '.join(VARIED)}, dev_mean_ratio, holdout_mean_ratio, slippage,
  row_number() OVER (ORDER BY dev_mean_ratio, dev_n_wins DESC, {', '.join(VARIED)}) AS rank FROM wide""")
def dev_rank(spark, folder):
    return search.ranked(_mean_wide(spark, folder)).select(*VARIED, "dev_mean_ratio", "holdout_mean_ratio", "slippage", "rank")


@register("most_wins", f"""{with_ctes(*SWEEP_CTES)}
SELECT {', '.join(VARIED)}, dev_n_wins, dev_mean_ratio FROM wide ORDER BY dev_n_wins DESC, dev_mean_ratio, {', '.join(VARIED)} LIMIT 1""")
def most_wins(spark, folder):
    return search.most_wins(_mean_wide(spark, folder)).select(*VARIED, "dev_n_wins", "dev_mean_ratio")


@register("leading_families", f"""{with_ctes(*SWEEP_CTES)}
SELECT pooling AS model, min(dev_mean_ratio) AS dev_mean_ratio FROM wide GROUP BY pooling ORDER BY 2, 1 LIMIT 3""")
def leading_families(spark, folder):
    """Each pooling stands for a family."""
    wide = _mean_wide(spark, folder).withColumn("model", F.col("pooling"))
    return search.leading_families(wide, 3).select("model", "dev_mean_ratio")


@register("skip_done_configs", f"""{with_ctes(*SWEEP_CTES)}
SELECT {', '.join(VARIED)}, dev_mean_ratio FROM wide WHERE NOT (blend = 0 AND shrink = 1)""")
def skip_done_configs(spark, folder):
    wide = _mean_wide(spark, folder)
    done = wide.filter((F.col("blend") == 0) & (F.col("shrink") == 1))
    return search.not_yet_done(wide, done).select(*VARIED, "dev_mean_ratio")


KNN_FEATURES = ("rwl_m", "dev_24h_m", "rain_3d", "temperature_2m_mean")


def knn_sql(by, memory=None):
    """Neighbours among the labels of a pool, or its latest ones: `by` names its columns in a row."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by)
    names = ", ".join(by)
    limit = "" if memory is None else f" AND k.place > s.upto - {memory}"
    return f"""{with_ctes(*FEATURE_CTES)},
rows AS (SELECT dam, date, horizon, label_date, target_delta, rwl_m, dev_24h_m, rain_3d, temperature_2m_mean FROM model_table),
stats AS (SELECT d.horizon, d.date, {", ".join(f"count(l.{f}) AS n_{f}, avg(l.{f}) AS m_{f}, stddev_pop(l.{f}) AS s_{f}" for f in KNN_FEATURES)}
  FROM (SELECT DISTINCT horizon, date FROM rows) d LEFT JOIN rows l ON l.horizon = d.horizon AND l.target_delta IS NOT NULL AND l.label_date <= d.date GROUP BY 1, 2),
z AS (SELECT dam, r.date, r.horizon, label_date, target_delta, {", ".join(
    f"coalesce(CASE WHEN {f} IS NULL THEN NULL WHEN n_{f} < 2 THEN 0 WHEN s_{f} < 1e-6 THEN {f} ELSE greatest(least(({f} - m_{f}) / s_{f}, 5), -5) END, 0) AS z_{f}" for f in KNN_FEATURES)}
  FROM rows r JOIN stats USING (horizon, date)),
known AS (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY label_date, md5(concat_ws('|', dam, date, horizon))) AS place FROM z WHERE target_delta IS NOT NULL),
seen AS (SELECT {", ".join(f"d.{c}" for c in by)}, d.date, max(k.place) AS upto FROM (SELECT DISTINCT {names}, date FROM z) d
  LEFT JOIN known k ON {on("k", "d")} AND k.label_date <= d.date GROUP BY ALL),
pairs AS (SELECT q.dam, q.date, q.horizon, k.target_delta AS y, k.place,
    round({" + ".join(f"power(q.z_{f} - k.z_{f}, 2)" for f in KNN_FEATURES)}, 9) AS distance
  FROM z q JOIN seen s ON {on("s", "q")} AND s.date = q.date JOIN known k ON {on("k", "q")} AND k.place <= s.upto{limit}),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY dam, date, horizon ORDER BY distance, place) <= 5),
answers AS (SELECT dam, date, horizon, avg(y) AS knn FROM near GROUP BY 1, 2, 3)
SELECT z.dam, z.date, z.horizon, round(coalesce(knn, 0), 4) AS model FROM z LEFT JOIN answers a ON a.dam = z.dam AND a.date = z.date AND a.horizon = z.horizon"""


def _neighbours(spark, folder, pooling, memory=None):
    table = with_label_date(events_table(spark, folder)).select("dam", "date", "horizon", "label_date", "target_delta", *KNN_FEATURES)
    # Scores and neighbours read the rows some times each: both are written, not computed again.
    z = materialise(causal.with_causal_z(materialise(table, "table"), KNN_FEATURES, ["horizon"], few=True).drop(*KNN_FEATURES), "scores")
    near = neighbours.causal_knn(z, [f"z_{f}" for f in KNN_FEATURES], ["dam", "date", "horizon"], pooling, 5, memory, scaled=False)
    return rounded(near.select("dam", "date", "horizon", "model"), 4)


@register("causal_knn", knn_sql(["dam"]))
def causal_knn(spark, folder):
    """Neighbours among all labels that the dam has so far, of any horizon."""
    return _neighbours(spark, folder, "horizon")


@register("causal_knn_pooled", knn_sql(["horizon"]))
def causal_knn_pooled(spark, folder):
    """Neighbours among all labels that any dam has so far at the horizon."""
    return _neighbours(spark, folder, "dam")


@register("causal_knn_latest", knn_sql(["horizon"], 1000))
def causal_knn_latest(spark, folder):
    """Neighbours among the last 1,000 labels of any dam."""
    return _neighbours(spark, folder, "dam", 1000)
