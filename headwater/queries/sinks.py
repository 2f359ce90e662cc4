"""Sources and sinks: tables written from the given ones and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from headwater.operators import keys
from headwater.queries.common import CHANGE, DAILY, TARGETS, query_set, reversion_table, with_ctes
from headwater.session import work_folder
from headwater.sources import files, incremental, views

QUERIES, ORACLES, register = query_set()

LEVELS = StructType([StructField("dam", StringType()), StructField("date", DateType()),
                     StructField("rwl_m", DoubleType()), StructField("outflow_cms", DoubleType())])


def _levels(spark, folder):
    return views.daily(spark, folder).select("dam", "date", "rwl_m", "inflow_cms")


@register("csv_round_trip", f"""{with_ctes(DAILY)}
SELECT dam, date, rwl_m, CAST(NULL AS DOUBLE) AS outflow_cms FROM daily""")
def csv_round_trip(spark, folder):
    """Read by header name: columns stand in another order, one is absent, one is not asked for."""
    path = work_folder(spark, "csv")
    _levels(spark, folder).select("inflow_cms", "rwl_m", "date", "dam").write.csv(path, header=True)
    return files.read_table(spark, path, LEVELS, "csv")


@register("csv_quarantine", """
SELECT CAST(user_id AS VARCHAR) AS dam, event_type AS rwl_m, count(*) AS n FROM events
WHERE event_type <> 'view' GROUP BY ALL""")
def csv_quarantine(spark, folder):
    """Rows whose level is no number come back as text."""
    path = work_folder(spark, "csv")
    level = F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.col("event_type"))
    views.table(spark, folder, "events").select(level.alias("rwl_m"), views.dam_id()).write.csv(path, header=True)
    return files.unreadable_csv(spark, path, LEVELS).groupBy("dam", "rwl_m").agg(F.count(F.lit(1)).alias("n"))


@register("optional_source", f"""{with_ctes(DAILY)}
SELECT dam, count(*) AS n_days FROM daily GROUP BY dam""")
def optional_source(spark, folder):
    """A source that was never written adds no rows and fails nothing."""
    absent = files.read_table(spark, work_folder(spark, "absent"), LEVELS, optional=True)
    return keys.stack(_levels(spark, folder), absent).groupBy("dam").agg(F.count(F.lit(1)).alias("n_days"))


@register("append_twice", """
SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL""")
def append_twice(spark, folder):
    """A log that grows by two appends and an empty one."""
    path, events = work_folder(spark, "log"), views.table(spark, folder, "events")
    clicks = F.col("event_type") == "click"
    for part in (events.filter(clicks), events.filter(~clicks), events.filter(F.lit(False))):
        files.append(part, path)
    return spark.read.schema(events.schema).parquet(path).groupBy(views.dam_id(), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("replace_table", f"""{with_ctes(DAILY)}
SELECT dam, date, rwl_m FROM daily WHERE inflow_cms >= 50""")
def replace_table(spark, folder):
    """The second version alone is what readers see."""
    root, levels = work_folder(spark, "table"), _levels(spark, folder).select("dam", "date", "rwl_m", "inflow_cms")
    for part in (levels.filter("inflow_cms < 50"), levels.filter("inflow_cms >= 50")):
        files.replace_table(part, root)
    return files.read_current(spark, root, levels.schema).select("dam", "date", "rwl_m")


@register("table_sink", f"""{with_ctes(DAILY, CHANGE, TARGETS)}
SELECT dam, date, horizon, target_delta FROM targets WHERE horizon IN (1, 7)""")
def table_sink(spark, folder):
    """A table partitioned by horizon; the read prunes all others."""
    path = work_folder(spark, "targets")
    files.write_table(reversion_table(spark, folder).select("dam", "date", "horizon", "target_delta"), path)
    return spark.read.parquet(path).filter("horizon in (1, 7)").select("dam", "date", "horizon", "target_delta")


@register("json_documents", f"""{with_ctes(DAILY)}
SELECT dam, date, CASE WHEN inflow_cms < 50 THEN rwl_m END AS rwl_m, inflow_cms >= 50 AS was_null FROM daily WHERE inflow_cms IS NOT NULL""")
def json_documents(spark, folder):
    """One document per row; a NULL, or NaN, is written as null and not left out."""
    path = work_folder(spark, "documents")
    level = F.when(F.col("inflow_cms") < 50, F.col("rwl_m")).otherwise(F.lit(float("nan")))
    files.write_documents(_levels(spark, folder).filter("inflow_cms is not null").select("dam", "date", level.alias("rwl_m")), path)
    body = F.from_json("value", "dam string, date date, rwl_m double").alias("d")
    return spark.read.text(path).select(F.col("value").contains('"rwl_m":null').alias("was_null"), body).select("d.*", "was_null")


@register("priority_by_source", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dam, CAST(ts AS DATE) AS date, value AS rain_mm, ts AS seq, event_type = 'click' AS fresh,
  CASE WHEN event_type IN ('view', 'click') THEN 'archive' ELSE 'forecast' END AS source FROM events)
SELECT dam, date, rain_mm, seq, source FROM r
QUALIFY row_number() OVER (PARTITION BY dam, date ORDER BY (source = 'archive') DESC, fresh DESC, seq DESC) = 1""")
def priority_by_source(spark, folder):
    """A store that meets new rows: the archive beats a forecast, then the new row the stored one."""
    kind = F.when(F.col("event_type").isin("view", "click"), "archive").otherwise("forecast")
    rows = views.table(spark, folder, "events").select(
        views.dam_id(), F.to_date("ts").alias("date"), F.col("value").alias("rain_mm"), F.col("ts").alias("seq"),
        kind.alias("source"), "event_type")
    fresh = F.col("event_type") == "click"
    stored, new = rows.filter(~fresh).drop("event_type"), rows.filter(fresh).drop("event_type")
    return keys.by_source(stored, new, ["dam", "date"], {"archive": 2, "forecast": 1}, "seq")


@register("weather_requests", f"""{with_ctes(DAILY)},
day AS (SELECT max(date) + 40 AS today, min(date) - 500 AS backfill FROM daily),
old AS (SELECT DISTINCT dam FROM daily WHERE dam <= '5'), fresh AS (SELECT DISTINCT dam FROM daily WHERE dam > '5'),
span AS (SELECT dam, today - 30 AS a, today - 6 AS b FROM old, day UNION ALL SELECT dam, backfill, today - 6 FROM fresh, day)
SELECT dam, greatest(a, make_date(y, 1, 1)) AS start_date, least(b, make_date(y, 12, 31)) AS end_date
FROM (SELECT dam, a, b, unnest(range(year(a), year(b) + 1)) AS y FROM span)""")
def weather_requests(spark, folder):
    """Archive requests by calendar year: the trailing days of known dams, all days of new ones,
    up to the newest day that the archive has."""
    daily = views.daily(spark, folder)
    day = daily.agg(F.date_add(F.max("date"), 40).alias("today"), F.date_sub(F.min("date"), 500).alias("backfill"))
    dams = daily.select("dam").distinct()
    today, backfill = day.select("today").scalar(), day.select("backfill").scalar()
    plan = [incremental.archive_range(dams.filter(some), today, backfill, known)
            for some, known in (("dam <= '5'", True), ("dam > '5'", False))]
    return incremental.by_year(keys.stack(*plan))
