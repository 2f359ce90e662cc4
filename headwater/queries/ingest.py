"""Pages and payloads, rendered by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import series
from headwater.queries.common import DAILY, REFS, query_set, rounded, with_ctes
from headwater.sources import bulletin, payloads, views

QUERIES, ORACLES, register = query_set()


def _cell(text, rows=1):
    return F.concat(F.lit(f'<td rowspan="{rows}">'), text, F.lit("</td>"))


def level_pages(spark, folder):
    """One bulletin per dam and day with that reading and the one before.

    Where the run key is 90 or more the page lacks a column, as after a change
    of layout.
    """
    first = series.daily_first(views.readings(spark, folder).select(
        "dam", "obs_datetime", "rwl_m", "inflow_cms", F.col("obs_datetime").alias("at")))
    refs = views.references(spark, folder)
    w = series.rows_of("dam")
    rows = first.withColumns({"p_rwl": F.lag("rwl_m").over(w), "p_at": F.lag("at").over(w)}).join(refs, "dam")
    money = lambda c: F.format_number(c, 2)
    empty, name = F.lit(""), F.concat(F.lit("Dam  "), F.col("dam"), F.lit(" "))

    def reading(level, at, inflow, lead_cells, shared):
        deviation = money(F.when(F.col("nhwl_m") == 0, 0.0).otherwise(level - F.col("nhwl_m")))
        curve = money(F.when(F.col("rule_curve_m") == 0, 0.0).otherwise(level - F.col("rule_curve_m")))
        own = [_cell(deviation, 2), _cell(money(F.col("rule_curve_m")), 2), _cell(curve, 2),
               _cell(F.lit("-"), 2), _cell(empty, 2), _cell(inflow, 2)]
        tail = F.when(F.col("inflow_cms") < 90, _cell(F.lit("N/A"), 2)).otherwise("")
        time_row = F.concat(F.lit("<tr>"), lead_cells, _cell(F.lower(F.date_format(at, "hh:mm a"))),
                            _cell(money(level), 2), shared, *own, tail, F.lit("</tr>"))
        return F.concat(time_row, F.lit("<tr>"), _cell(F.date_format(at, "MMM-dd")), F.lit("</tr>"))

    shared = F.concat(_cell(F.lit("24"), 4), _cell(F.lit("0.64"), 4), _cell(money(F.col("nhwl_m")), 4))
    now = reading(F.col("rwl_m"), F.col("at"), F.col("inflow_cms").cast("string"), _cell(name, 4), shared)
    before = F.when(F.col("p_at").isNotNull(), reading(F.col("p_rwl"), F.col("p_at"), F.lit("--"), F.lit(""), F.lit(""))).otherwise("")
    head = '<html><body><p>x</p><table><tr><th rowspan="2">Dam Name</th><th colspan="12">Readings</th></tr></table><table class="t"><thead><tr><th>Dam Name</th></tr></thead>'
    html = F.concat(F.lit(head), F.lit("<tbody>"), now, before, F.lit("</tbody></table></body></html>"))
    return rows.select(
        F.concat_ws("/", "dam", "date").alias("page_id"), F.col("at").alias("captured_at"),
        F.lit("wayback").alias("source"), html.alias("html"))


_PAGES = f"""{with_ctes(REFS, DAILY)},
firsts AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, min(ts) AS seen_at FROM events GROUP BY 1, 2),
page AS (SELECT d.*, f.seen_at, lag(rwl_m) OVER w AS p_rwl, lag(f.seen_at) OVER w AS p_at FROM daily d JOIN firsts f USING (dam, date)
         WINDOW w AS (PARTITION BY d.dam ORDER BY d.date))"""


@register("extract_levels", f"""{_PAGES},
readings AS (SELECT dam, date, seen_at, rwl_m, seen_at AS t, inflow_cms FROM page WHERE inflow_cms < 90
  UNION ALL SELECT dam, date, seen_at, p_rwl, p_at, NULL FROM page WHERE inflow_cms < 90 AND p_at IS NOT NULL)
SELECT 'Dam ' || dam AS dam, dam || '/' || date AS page_id, date_trunc('minute', t) AS obs_datetime, round(rwl_m, 2) AS rwl_m,
  round(nhwl_m, 2) AS nhwl_m, round(rule_curve_m, 2) AS rule_curve_m, inflow_cms,
  CAST(NULL AS DOUBLE) AS outflow_cms, 'wayback' AS source, seen_at AS scraped_at
FROM readings JOIN refs USING (dam)""")
def extract_levels(spark, folder):
    rows = bulletin.levels(bulletin.read_level_pages(level_pages(spark, folder), marker="Dam "), aliases={"-": "-"})
    return rows.select("dam", "page_id", "obs_datetime", "rwl_m", "nhwl_m", "rule_curve_m", "inflow_cms", "outflow_cms", "source", "scraped_at")


@register("backfill", f"""{_PAGES}
SELECT CASE WHEN inflow_cms < 90 THEN 'parsed' ELSE 'no 13-column table with Dam ' END AS status, count(*) AS pages,
  CAST(sum(CASE WHEN inflow_cms < 90 THEN CASE WHEN p_at IS NULL THEN 1 ELSE 2 END ELSE 0 END) AS BIGINT) AS readings FROM page GROUP BY 1""")
def backfill(spark, folder):
    return bulletin.page_status(bulletin.read_level_pages(level_pages(spark, folder), marker="Dam "))


@register("backfill_new", f"""{_PAGES},
readings AS (SELECT dam, seen_at, rwl_m, seen_at AS t FROM page WHERE inflow_cms < 90
  UNION ALL SELECT dam, seen_at, p_rwl, p_at FROM page WHERE inflow_cms < 90 AND p_at IS NOT NULL),
found AS (SELECT 'Dam ' || dam AS dam, date_trunc('minute', t) AS obs_datetime, rwl_m, seen_at FROM readings
  QUALIFY row_number() OVER (PARTITION BY dam, date_trunc('minute', t) ORDER BY seen_at) = 1)
SELECT dam, obs_datetime, round(rwl_m, 2) AS rwl_m, seen_at AS scraped_at FROM found f
WHERE NOT EXISTS (SELECT 1 FROM page p WHERE 'Dam ' || p.dam = f.dam AND date_trunc('minute', p.seen_at) = f.obs_datetime AND p.inflow_cms < 30)""")
def backfill_new(spark, folder):
    """Recovered readings that the live record lacks; of repeats the earliest capture."""
    from headwater.operators.keys import first_seen

    rows = bulletin.levels(bulletin.read_level_pages(level_pages(spark, folder), marker="Dam "), aliases={"-": "-"})
    first = series.daily_first(views.readings(spark, folder).select("dam", "obs_datetime", "inflow_cms", F.col("obs_datetime").alias("at")))
    live = first.filter("inflow_cms < 30").select(
        F.concat(F.lit("Dam "), "dam").alias("dam"), F.date_trunc("minute", "at").cast("timestamp_ntz").alias("obs_datetime"))
    return first_seen(live, rows.select("dam", "obs_datetime", "rwl_m", "scraped_at"), ["dam", "obs_datetime"], "scraped_at")


@register("page_failures", """
SELECT 'no 13-column table with Angat' AS status, count(*) AS pages, CAST(0 AS BIGINT) AS readings FROM pages""")
def page_failures(spark, folder):
    """Ordinary web pages hold no bulletin: each becomes a failure row."""
    pages = views.table(spark, folder, "pages").select(
        "page_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("captured_at"), F.col("url").alias("source"), "html")
    return bulletin.page_status(bulletin.read_level_pages(pages))


def alert_pages(spark, folder):
    states = views.alerts(spark, folder)
    row = F.concat(F.lit("<tr><td>\n   "), F.col("basin"), F.lit("</td><td class='c'>\n <a href='#'>"), F.col("status"), F.lit("</a>\n</td></tr>"))
    head = "<table><thead><tr><th>18 MAJOR RIVER BASINS</th><th>STATUS</th></tr></thead>"
    middle = "<tr><td>DAMS/RESERVOIR (SUB BASIN)</td><td>STATUS</td></tr><tr><td>Closed</td><td>n/a</td></tr>"
    return states.select(
        F.concat_ws("/", "basin", "date").alias("page_id"), F.col("scraped_at").alias("captured_at"), F.lit("live").alias("source"),
        F.concat(F.lit(head), row, F.lit(middle), F.lit("</table>")).alias("html"))


@register("extract_alerts", """
SELECT 'Basin ' || user_id || CASE WHEN user_id % 10 = 0 THEN ' Sub-basin' ELSE '' END AS basin,
  CASE WHEN user_id % 10 = 0 THEN 'dam_sub_basin' ELSE 'river_basin' END AS kind,
  CAST(ts AS DATE) AS date, CASE WHEN bool_or(event_type = 'error') THEN 'Flood Watch' ELSE 'Non-Flood Watch' END AS status,
  bool_or(event_type = 'error') AS on_watch, max(ts) AS scraped_at FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def extract_alerts(spark, folder):
    return bulletin.alerts(bulletin.read_alert_pages(alert_pages(spark, folder))).drop("page_id")


@register("flatten_weather", """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, event_type, avg(value) AS mean_value, max(value) AS top
  FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
n AS (SELECT dam, CAST(count(DISTINCT event_type) AS INTEGER) AS n_points FROM p GROUP BY dam)
SELECT dam, date, 'archive' AS source, round(avg(mean_value), 6) AS temperature_2m_mean, round(avg(top), 6) AS temperature_2m_max, n_points
FROM p JOIN n USING (dam) GROUP BY dam, date, n_points""")
def flatten_weather(spark, folder):
    """Payloads of up to two points per dam, each with a value for every day it
    has; the days of a payload are bounded by the calendar."""
    points = views.table(spark, folder, "events").filter("event_type IN ('view', 'click')").groupBy(
        views.dam_id(), F.to_date("ts").alias("date"), "event_type"
    ).agg(F.avg("value").alias("mean_value"), F.max("value").alias("top"))
    days = points.groupBy("dam", "event_type").agg(F.sort_array(F.collect_list(F.struct("date", "mean_value", "top"))).alias("d"))
    daily = F.struct(F.transform("d.date", lambda x: x.cast("string")).alias("time"), F.col("d.mean_value").alias("temperature_2m_mean"),
                     F.col("d.top").alias("temperature_2m_max"))
    listed = days.select("dam", F.struct(daily.alias("daily")).alias("point")).groupBy("dam").agg(F.collect_list("point").alias("points"))
    single = F.to_json(F.col("points")[0])
    text = F.when(F.size("points") == 1, single).otherwise(F.to_json("points"))
    rows = payloads.weather_rows(listed.select("dam", F.lit("archive").alias("source"), text.alias("payload")))
    return rounded(rows.select("dam", "date", "source", "temperature_2m_mean", "temperature_2m_max", "n_points"))


@register("unpivot_leads", """
WITH h AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date,
  CAST(floor(CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) / 15) + 1 AS INTEGER) AS lead, value FROM events)
SELECT dam, date, lead, round(sum(value), 4) AS rain_mm FROM h GROUP BY 1, 2, 3""")
def unpivot_leads(spark, folder):
    """One payload per dam and day with at most 24 hours and a column per lead."""
    lead = (F.floor(views.run_key() / 15) + 1).cast("int")
    hourly = views.table(spark, folder, "events").groupBy(
        views.dam_id(), F.to_date("ts").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("time")
    ).agg(*[F.sum(F.when(lead == n, F.col("value"))).alias(f"precipitation_previous_day{n}") for n in range(1, 8)])
    names = ["time", *[f"precipitation_previous_day{n}" for n in range(1, 8)]]
    grouped = hourly.groupBy("dam", "date").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("h"))
    body = F.struct(F.struct(*[F.col(f"h.{n}").alias(n) for n in names]).alias("hourly"))
    return rounded(payloads.forecast_rows(grouped.select("dam", F.to_json(body).alias("payload"))), 4)


@register("snapshot_index", """
SELECT CAST(user_id AS VARCHAR) AS site, CAST(ts AS DATE) AS date, date_trunc('second', min(ts)) AS captured_at FROM events GROUP BY 1, 2""")
def snapshot_index(spark, folder):
    """Listings per dam and week of the first snapshot of every hour."""
    hourly = views.table(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("site"), F.date_trunc("hour", "ts").alias("hour")).agg(F.min("ts").alias("ts"))
    stamp = F.array(F.date_format("ts", "yyyyMMddHHmmss"))
    weekly = hourly.groupBy("site", F.date_trunc("week", "hour").alias("week")).agg(F.sort_array(F.collect_list(stamp)).alias("rows"))
    text = F.to_json(F.concat(F.array(F.array(F.lit("timestamp"))), F.col("rows")))
    return payloads.snapshot_index(weekly.select("site", text.alias("payload")))
