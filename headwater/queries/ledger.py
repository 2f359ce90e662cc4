"""The ledger loop, risk, history, freshness and request planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater import schemas
from headwater.functions import numeric, risk
from headwater.operators import alerts, ledger
from headwater.operators.targets import horizon_targets
from headwater.plans import publish, tick
from headwater.plans.roles import events_table
from headwater.queries.common import (
    ALERTS, CHANGE, DAILY, ERROR_CTES, ERRORS, REFS, REGISTRY, REVERSION, ROLLED_WEATHER, TARGETS, WEATHER,
    query_set, reversion_errors, reversion_table, rounded, with_ctes,
)
from headwater.queries.scoring import ALERT_PAIRS, BOARD
from headwater.session import materialise, work_folder
from headwater.sources import incremental, views
from headwater.sources.files import read_table

QUERIES, ORACLES, register = query_set()

# The first run stopped here; its scores are in the error log.
FIRST_RUN = "2024-01-15"

LEDGER_ROWS = """ledger AS (
  SELECT date AS issue_date, label_date AS target_date, dam, horizon, rwl_m AS issue_rwl_m, model AS pred_delta, dev_24h_m
  FROM reversion)"""


def _ledger(spark, folder):
    return ledger.ledger_rows(reversion_table(spark, folder), F.col("model"), ["rwl_m", "dev_24h_m"])


def _actuals(spark, folder):
    return views.daily(spark, folder).select("dam", "date", "rwl_m")


def _first_scores(spark, folder):
    landed = _actuals(spark, folder).filter(F.col("date") <= F.lit(FIRST_RUN).cast("date"))
    return ledger.score_due(_ledger(spark, folder), None, landed)


@register("score_due", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, LEDGER_ROWS)}
SELECT issue_date, target_date, l.dam, horizon, round(pred_delta, 6) AS pred_delta, round(a.rwl_m - issue_rwl_m, 6) AS actual_delta,
  round(abs(pred_delta - (a.rwl_m - issue_rwl_m)), 6) AS abs_err_model, round(abs(a.rwl_m - issue_rwl_m), 6) AS abs_err_persistence,
  round(abs(coalesce(dev_24h_m * horizon, 0) - (a.rwl_m - issue_rwl_m)), 6) AS abs_err_drift
FROM ledger l JOIN daily a ON a.dam = l.dam AND a.date = l.target_date WHERE target_date > DATE '{FIRST_RUN}'""")
def score_due(spark, folder):
    """A second run: what the first one scored is not scored again."""
    return rounded(ledger.score_due(_ledger(spark, folder), _first_scores(spark, folder), _actuals(spark, folder)))


@register("open_forecasts", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, LEDGER_ROWS)}
SELECT l.dam, issue_date, target_date, horizon, round(pred_delta, 6) AS pred_delta FROM ledger l
WHERE NOT EXISTS (SELECT 1 FROM daily a WHERE a.dam = l.dam AND a.date = l.target_date AND a.date <= DATE '{FIRST_RUN}')""")
def open_forecasts(spark, folder):
    waiting = ledger.open_forecasts(_ledger(spark, folder), _first_scores(spark, folder))
    return rounded(waiting.select("dam", "issue_date", "target_date", "horizon", "pred_delta"))


@register("issue_new", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, LEDGER_ROWS)}
SELECT dam, issue_date, target_date, horizon, round(pred_delta, 6) AS pred_delta FROM ledger WHERE issue_date > DATE '{FIRST_RUN}'""")
def issue_new(spark, folder):
    """A rerun over all days adds only what an earlier run had not issued."""
    rows = _ledger(spark, folder)
    stored = rows.filter(F.col("issue_date") <= F.lit(FIRST_RUN).cast("date"))
    return rounded(ledger.issue_new(rows, stored).select("dam", "issue_date", "target_date", "horizon", "pred_delta"))


@register("issue_latest", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)}
SELECT dam, date AS issue_date, label_date AS target_date, horizon, round(rwl_m + model, 6) AS pred_rwl_m FROM reversion
WHERE date = (SELECT max(date) FROM daily)""")
def issue_latest(spark, folder):
    rows = alerts.latest_day(reversion_table(spark, folder))
    return rounded(rows.select("dam", F.col("date").alias("issue_date"), F.col("label_date").alias("target_date"), "horizon",
                               (F.col("rwl_m") + F.col("model")).alias("pred_rwl_m")))


@register("issue_latest_per_entity", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)}
SELECT dam, date AS issue_date, horizon, round(rwl_m + model, 6) AS pred_rwl_m FROM reversion
WHERE (dam, date) IN (SELECT (dam, max(date)) FROM daily GROUP BY dam)""")
def issue_latest_per_entity(spark, folder):
    rows = alerts.latest_day(reversion_table(spark, folder), per=["dam"])
    return rounded(rows.select("dam", F.col("date").alias("issue_date"), "horizon", (F.col("rwl_m") + F.col("model")).alias("pred_rwl_m")))


@register("ledger_json", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, LEDGER_ROWS)}
SELECT dam, issue_date, horizon, round(issue_rwl_m, 6) AS rwl_m, round(dev_24h_m, 6) AS dev_24h_m, CAST(horizon AS DOUBLE) AS stored_horizon
FROM ledger""")
def ledger_json(spark, folder):
    """Features and baseline inputs to JSON text and back."""
    back = ledger.ledger_from_json(ledger.ledger_json(_ledger(spark, folder)))
    return rounded(back.select(
        "dam", "issue_date", "horizon", F.try_element_at("features", F.lit("rwl_m")).alias("rwl_m"),
        F.try_element_at("baseline_inputs", F.lit("dev_24h_m")).alias("dev_24h_m"),
        F.try_element_at("features", F.lit("horizon")).alias("stored_horizon")))


@register("stored_inputs", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)}
SELECT dam, date, horizon, round(rwl_m, 6) AS rwl_m, round(dev_24h_m, 6) AS dev_24h_m FROM reversion""")
def stored_inputs(spark, folder):
    return rounded(ledger.stored_inputs(_ledger(spark, folder), ["rwl_m", "dev_24h_m"]))


@register("risk_class", f"""{with_ctes(REFS, DAILY, CHANGE, TARGETS, REVERSION)},
peaks AS (SELECT dam, date, max(rwl_m + model * horizon / 7) AS peak FROM reversion GROUP BY dam, date)
SELECT dam, date, round(peak, 6) AS peak,
  CASE WHEN peak >= nhwl_m THEN 'Spill Watch' WHEN peak >= rule_curve_m THEN 'Watch'
    WHEN nhwl_m IS NULL AND rule_curve_m IS NULL THEN 'Not rated' ELSE 'Normal' END AS risk,
  CASE WHEN peak >= nhwl_m THEN 'reaches' WHEN peak >= rule_curve_m THEN 'crosses'
    WHEN nhwl_m IS NULL AND rule_curve_m IS NULL THEN 'publishes' ELSE 'stays' END AS note_word
FROM peaks JOIN refs USING (dam)""")
def risk_class(spark, folder):
    """Highest of the seven forecast levels against the references."""
    table = reversion_table(spark, folder)
    level = F.col("rwl_m") + F.col("model") * F.col("horizon") / 7
    # Seven horizons per dam and day: the array is of fixed length.
    peaks = table.groupBy("dam", "date", "nhwl_m", "rule_curve_m").agg(F.collect_list(level).alias("levels"))
    label = risk.risk_of_levels(F.col("levels"), F.col("nhwl_m"), F.col("rule_curve_m"))
    word = F.regexp_extract(risk.risk_note(F.col("risk")), "(reaches|crosses|publishes|stays)", 1)
    return rounded(peaks.withColumn("risk", label).select(
        "dam", "date", F.array_max("levels").alias("peak"), "risk", word.alias("note_word")))


@register("extreme_flags", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION, WEATHER, ROLLED_WEATHER)},
newest AS (SELECT max(date) AS d FROM daily),
rise AS (SELECT dam, horizon, max(target_delta) AS biggest_rise FROM targets, newest WHERE date < d AND target_delta IS NOT NULL GROUP BY 1, 2),
wet AS (SELECT c.dam, max(w.rain_7d) AS wettest FROM changed c JOIN rolled w ON w.dam = c.dam AND w.date = c.date, newest WHERE c.date < d GROUP BY 1)
SELECT r.dam, r.date, r.horizon, round(rise.biggest_rise, 6) AS biggest_rise, coalesce(r.model > rise.biggest_rise, FALSE) AS beyond_observed_rise,
  coalesce(coalesce(w.rain_7d, 0) > wet.wettest, FALSE) AS extrapolating
FROM reversion r JOIN newest ON r.date = d LEFT JOIN rise ON rise.dam = r.dam AND rise.horizon = r.horizon
LEFT JOIN rolled w ON w.dam = r.dam AND w.date = r.date LEFT JOIN wet ON wet.dam = r.dam""")
def extreme_flags(spark, folder):
    from headwater.operators.rain import weather_features

    rain = weather_features(views.weather(spark, folder)).select("dam", "date", "rain_7d")
    table = reversion_table(spark, folder).join(rain, ["dam", "date"], "left")
    rise = ledger.past_extremes(table, ["dam", "horizon"], "target_delta", "biggest_rise")
    wet = ledger.past_extremes(table, ["dam"], "rain_7d", "wettest")
    latest = alerts.latest_day(table)
    return rounded(latest.join(rise, ["dam", "horizon"], "left").join(wet, "dam", "left").select(
        "dam", "date", "horizon", "biggest_rise",
        risk.beyond(F.col("model"), F.col("biggest_rise")).alias("beyond_observed_rise"),
        risk.beyond(F.coalesce("rain_7d", F.lit(0.0)), F.col("wettest")).alias("extrapolating")))


@register("group_max", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT dam, horizon, round(max(target_delta), 6) AS biggest_rise FROM targets
WHERE date < (SELECT max(date) FROM daily) GROUP BY dam, horizon""")
def group_max(spark, folder):
    table = horizon_targets(views.daily(spark, folder).select("dam", "date", "rwl_m"))
    return rounded(ledger.past_extremes(table, ["dam", "horizon"], "target_delta", "biggest_rise"))


@register("observed_60d", """
WITH daily AS (SELECT o_orderpriority AS dam, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 3) AS rwl_m FROM orders GROUP BY 1, 2)
SELECT dam, CAST(row_number() OVER (PARTITION BY dam ORDER BY date) - 1 AS INTEGER) AS position, date, rwl_m FROM daily
WHERE date >= (SELECT max(date) - 60 FROM daily)""")
def observed_60d(spark, folder):
    recent = ledger.recent_history(views.order_series(spark, folder))
    return recent.select("dam", F.posexplode("observed").alias("position", "point")).select("dam", "position", "point.date", "point.rwl_m")


@register("staleness", f"""{with_ctes(DAILY)}
SELECT max(date) AS latest_observation, CAST(DATE '2024-02-04' - max(date) AS INTEGER) AS data_age_days,
  DATE '2024-02-04' - max(date) > 2 AS stale FROM daily""")
def staleness(spark, folder):
    return ledger.freshness(views.daily(spark, folder), F.lit("2024-02-04").cast("date"))


@register("latest_slice", f"""{with_ctes(DAILY)} SELECT dam, date, rwl_m FROM daily WHERE date = (SELECT max(date) FROM daily)""")
def latest_slice(spark, folder):
    return alerts.latest_day(views.daily(spark, folder).select("dam", "date", "rwl_m"))


@register("alert_board", f"""{with_ctes(ALERTS)}
SELECT basin, CASE WHEN on_watch THEN 'Flood Watch' ELSE 'Non-Flood Watch' END AS status, on_watch, kind, date FROM alerts
WHERE date = (SELECT max(date) FROM alerts) ORDER BY on_watch DESC, basin""")
def alert_board(spark, folder):
    return alerts.alert_board(views.alerts(spark, folder))


@register("request_plan", """
WITH span AS (SELECT CAST(o_custkey AS VARCHAR) AS dam, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)
SELECT dam, CAST(greatest(a, make_date(y, 1, 1)) AS DATE) AS start_date, CAST(least(b, make_date(y, 12, 31)) AS DATE) AS end_date
FROM (SELECT dam, a, b, unnest(range(year(a), year(b) + 1)) AS y FROM span)""")
def request_plan(spark, folder):
    return incremental.by_year(_order_span(spark, folder))


@register("request_plan_180d", """
WITH span AS (SELECT CAST(o_custkey AS VARCHAR) AS dam, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
steps AS (SELECT dam, b, a + CAST(180 * k AS INTEGER) AS s FROM (SELECT dam, a, b, unnest(range(0, CAST(floor((b - a) / 180) AS BIGINT) + 1)) AS k FROM span))
SELECT dam, s AS start_date, least(b, s + 179) AS end_date FROM steps""")
def request_plan_180d(spark, folder):
    return incremental.by_days(_order_span(spark, folder), 180)


def _order_span(spark, folder):
    return views.table(spark, folder, "orders").groupBy(F.col("o_custkey").cast("string").alias("dam")).agg(
        F.min(F.to_date("o_orderdate")).alias("start_date"), F.max(F.to_date("o_orderdate")).alias("end_date"))


@register("incremental_bounds", f"""{with_ctes(DAILY)}
SELECT dam, date, rwl_m FROM daily WHERE date >= (SELECT max(date) - 10 FROM daily)""")
def incremental_bounds(spark, folder):
    return incremental.trailing(views.daily(spark, folder).select("dam", "date", "rwl_m"), 10)


@register("next_ranges", f"""{with_ctes(DAILY)}, dams AS (SELECT DISTINCT dam FROM daily)
SELECT dam, 'stored' AS kind, greatest(DATE '2024-01-05', (SELECT max(date) - 10 FROM daily)) AS start_date, DATE '2024-02-15' AS end_date FROM dams
UNION ALL SELECT dam, 'early', greatest(DATE '2024-01-05', (SELECT max(date) - 10 FROM daily WHERE date <= DATE '2024-01-08')), DATE '2024-02-15' FROM dams
UNION ALL SELECT dam, 'new', DATE '2024-01-05', DATE '2024-02-15' FROM dams""")
def next_ranges(spark, folder):
    """What to request with a store, with one that ends before the backfill's trailing days begin, and without."""
    daily = views.daily(spark, folder)
    dams = daily.select("dam").distinct()
    start, until = (F.lit(d).cast("date") for d in ("2024-01-05", "2024-02-15"))
    early = daily.filter(F.col("date") <= F.lit("2024-01-08").cast("date"))
    parts = [incremental.next_range(stored, 10, start, until, dams).withColumn("kind", F.lit(kind))
             for stored, kind in ((daily, "stored"), (early, "early"), (None, "new"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("dashboard_dams", f"""{with_ctes(DAILY, CHANGE, TARGETS, REVERSION)}
SELECT dam, date AS issue_date, round(rwl_m, 3) AS rwl_m, CAST(count(*) AS INTEGER) AS n_forecasts, round(max(round(rwl_m + model / 7, 3)), 3) AS peak
FROM reversion WHERE date = (SELECT max(date) FROM daily) GROUP BY dam, date, rwl_m""")
def dashboard_dams(spark, folder):
    """The per-dam part of the published payload, read back from its JSON."""
    part = publish.dam_payload(reversion_table(spark, folder), views.daily(spark, folder), views.registry(spark, folder), F.col("model") / 7)
    parsed = part.select("dam", F.from_json(F.to_json("payload", {"ignoreNullFields": "false"}), "issue_date date, rwl_m double, forecasts array<struct<horizon:int,pred_rwl_m:double>>").alias("p"))
    return parsed.select("dam", "p.issue_date", F.round("p.rwl_m", 3).alias("rwl_m"), F.size("p.forecasts").alias("n_forecasts"),
                         F.round(F.array_max("p.forecasts.pred_rwl_m"), 3).alias("peak"))


@register("dashboard_payload")
def dashboard_payload(spark, folder):
    return publish.dashboard(
        reversion_table(spark, folder), views.daily(spark, folder), views.registry(spark, folder), views.alerts(spark, folder),
        _first_scores(spark, folder), F.col("model"), F.lit("2024-02-01").cast("date"))


def _fields(section: str, key: str, source: str) -> str:
    """SQL for one row per field of each row of a CTE."""
    return f"""SELECT '{section}' AS section, key, field, value FROM (UNPIVOT (
  SELECT CAST({key} AS VARCHAR) AS key, CAST(COLUMNS(*) AS VARCHAR) FROM {source}) ON COLUMNS(* EXCLUDE (key)) INTO NAME field VALUE value)"""


@register("dashboard_fields", f"""{with_ctes(REFS, DAILY, CHANGE, TARGETS, REVERSION, ERRORS, BOARD.replace("3000", "200"), WEATHER, ROLLED_WEATHER, ALERTS, ALERT_PAIRS, REGISTRY)},
newest AS (SELECT max(date) AS d FROM daily),
wet AS (SELECT c.dam, max(w.rain_7d) AS wettest FROM changed c JOIN rolled w ON w.dam = c.dam AND w.date = c.date, newest WHERE c.date < d GROUP BY 1),
peaks AS (SELECT dam, date, rwl_m, max(rwl_m + model) AS peak FROM reversion JOIN newest ON date = d GROUP BY ALL),
dams AS (
  SELECT dam, lat, lon, date AS issue_date, rwl_m, nhwl_m, rule_curve_m,
    CASE WHEN peak >= nhwl_m THEN 'Spill Watch' WHEN peak >= rule_curve_m THEN 'Watch'
      WHEN nhwl_m IS NULL AND rule_curve_m IS NULL THEN 'Not rated' ELSE 'Normal' END AS risk,
    coalesce(coalesce(w.rain_7d, 0) > wettest, FALSE) AS extrapolating, round(w.rain_7d, 1) AS rain_7d, round(w.rain_next_7d, 1) AS rain_next_7d
  FROM peaks LEFT JOIN refs USING (dam) LEFT JOIN registry g USING (dam) LEFT JOIN wet USING (dam)
  LEFT JOIN rolled w USING (dam, date)),
sources AS (SELECT CASE WHEN dev_24h_m IS NULL THEN 'era5_proxy' ELSE 'forecast' END AS fcst_source,
  round(avg(abs_err_model), 4) AS mae_model, count(*) AS n FROM errors GROUP BY 1),
days AS (SELECT label_date AS target_date, avg(abs_err_model) AS m, avg(abs_err_persistence) AS p FROM errors WHERE label_date <= DATE '{FIRST_RUN}' GROUP BY 1),
curve AS (SELECT target_date, round(m, 4) AS abs_err_model, round(p, 4) AS abs_err_persistence,
  round(CASE WHEN count(m) OVER w >= 3 THEN avg(m) OVER w END, 4) AS roll_abs_err_model,
  round(CASE WHEN count(p) OVER w >= 3 THEN avg(p) OVER w END, 4) AS roll_abs_err_persistence
  FROM days WINDOW w AS (ORDER BY target_date ROWS 19 PRECEDING)),
fresh AS (SELECT max(date) AS latest_observation, DATE '2024-02-01' - max(date) AS data_age_days, DATE '2024-02-01' - max(date) > 2 AS stale,
  DATE '2024-02-01' AS generated_at, (SELECT count(*) FROM errors WHERE label_date <= DATE '{FIRST_RUN}') AS scored_this_run FROM daily),
board_now AS (SELECT basin, CASE WHEN on_watch THEN 'Flood Watch' ELSE 'Non-Flood Watch' END AS status, on_watch, kind, date FROM alerts
  WHERE date = (SELECT max(date) FROM alerts)),
gate AS (SELECT (SELECT count(DISTINCT date) FROM rivers) AS days_collected, (SELECT count(DISTINCT basin) FROM rivers) AS basins,
  CAST(sum(actual) AS BIGINT) AS watch_days_seen, count(actual) AS n_targets,
  CASE WHEN (SELECT count(DISTINCT date) FROM rivers) < 30 THEN 'not enough history yet'
    WHEN sum(actual) < 10 THEN 'not enough flood-watch days to learn from' ELSE 'scored' END AS status FROM pairs),
recall AS (SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n,
  count(*) FILTER (pred = 1 AND actual = 1) AS model_tp, count(*) FILTER (persistence = 1 AND actual = 1) AS persistence_tp
  FROM pairs WHERE actual IS NOT NULL AND (SELECT status FROM gate) = 'scored' GROUP BY 1),
shown AS ({" UNION ALL ".join([
    _fields("dams", "dam", "dams"), _fields("metrics", "horizon", "board"), _fields("metrics_by_rain_source", "fcst_source", "sources"),
    _fields("learning_curve", "target_date", "curve"), _fields("freshness", "latest_observation", "fresh"), _fields("basins", "basin", "board_now"),
    _fields("basin_forecast", "status", "gate"), _fields("basin_forecast", "horizon", "recall")])})
SELECT section, key, field, round(try_cast(value AS DOUBLE), 4) AS number, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS word FROM shown""")
def dashboard_fields(spark, folder):
    """The whole payload with backtest, alert scores and this run's errors, one row per plain field."""
    from headwater.operators.rain import weather_features

    rain = weather_features(views.weather(spark, folder)).select("dam", "date", "rain_7d", "rain_next_7d")
    source = F.when(F.col("dev_24h_m").isNull(), "era5_proxy").otherwise("forecast")
    states = views.alerts(spark, folder)
    scored = alerts.alert_targets(alerts.alert_features(states)).select(
        "basin", "horizon", F.col("target").alias("actual"), numeric.at_least_half(F.col("watch_3d")).alias("pred"),
        F.col("on_watch").cast("int").alias("persistence"))
    # Several sections read each of these.
    landed = materialise(_first_scores(spark, folder), "landed")
    backtest = materialise(reversion_errors(spark, folder).withColumn("fcst_source", source), "backtest")
    table = materialise(reversion_table(spark, folder).join(rain, ["dam", "date"], "left"), "table")
    view = publish.dashboard(
        table, views.daily(spark, folder), views.registry(spark, folder),
        states, landed, F.col("model"), F.lit("2024-02-01").cast("date"),
        backtest=backtest, alert_scores=scored, scored=landed)
    fields = view.select("section", "key", F.explode(F.from_json("json", "map<string,string>")).alias("field", "value"))
    long = ["risk_note", "observed", "forecasts", "disclaimer"]
    of_counts = (F.col("section") != "basin_forecast") | F.col("field").rlike("^(days|basins|watch_days|n$|n_|status|horizon|.*_tp)")
    number = F.col("value").try_cast("double")
    return fields.filter(F.col("value").isNotNull() & ~F.col("field").isin(long) & of_counts).select(
        "section", "key", "field", F.round(number, 4).alias("number"), F.when(number.isNull(), F.col("value")).alias("word"))


@register("tick_scores", f"""{with_ctes(*ERROR_CTES)}
SELECT date AS issue_date, label_date AS target_date, dam, horizon, round(actual, 6) AS actual_delta,
  round(abs_err_persistence, 6) AS abs_err_persistence, round(abs_err_drift, 6) AS abs_err_drift, TRUE AS model_scored
FROM errors WHERE date = (SELECT max(date) FROM daily WHERE date <= DATE '{FIRST_RUN}')""")
def tick_scores(spark, folder):
    """Two runs of the live loop: the second one logs the errors of what the first one issued."""
    store = tick.Store(work_folder(spark, "loop"))
    cut = F.lit(FIRST_RUN).cast("date")
    # Each run reads them in many places.
    table, daily = materialise(events_table(spark, folder), "table"), materialise(views.daily(spark, folder), "daily")
    known = F.when(F.date_add("date", F.col("horizon").cast("int")) <= cut, F.col("target_delta"))
    registry, states = views.registry(spark, folder), views.alerts(spark, folder)
    tick.run(spark, store, table.filter(F.col("date") <= cut).withColumn("target_delta", known),
             daily.filter(F.col("date") <= cut), registry, states, cut)
    tick.run(spark, store, table, daily, registry, states, F.lit("2024-02-01").cast("date"))
    log = read_table(spark, store.errors, schemas.ERROR_LOG)
    return rounded(log.select("issue_date", "target_date", "dam", "horizon", "actual_delta", "abs_err_persistence", "abs_err_drift",
                              F.col("abs_err_model").isNotNull().alias("model_scored")))


@register("live_errors", f"""{with_ctes(*ERROR_CTES)}
SELECT horizon, count(*) AS n, round(avg(abs_err_model), 4) AS mae FROM errors WHERE label_date <= DATE '{FIRST_RUN}' GROUP BY horizon""")
def live_errors(spark, folder):
    return _first_scores(spark, folder).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), numeric.published(F.avg("abs_err_model")).alias("mae"))
