"""Cleaning expressions and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.constants import ALIASES
from headwater.functions import clean, geo, numeric
from headwater.queries.common import DAILY, REFS, REGISTRY, query_set, rounded, with_ctes
from headwater.sources import views

QUERIES, ORACLES, register = query_set()

PRIORITY_ALIASES = {
    "1 urgent": "Urgent",
    "2 high": "High",
    "3 medium": "Medium",
    "5 low": "Low",
}


def _messy(priority):
    return F.concat(F.lit("  "), F.regexp_replace(priority, "-", "   "), F.lit(" \t"))


@register("canonical_names", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
  WHEN '5-LOW' THEN 'Low' ELSE '4 NOT SPECIFIED' END AS canonical FROM orders""")
def canonical_names(spark, folder):
    orders = views.table(spark, folder, "orders")
    return orders.select("o_orderkey", clean.canonical(_messy(F.col("o_orderpriority")), PRIORITY_ALIASES).alias("canonical"))


@register("canonical_by_table", """
SELECT o_orderpriority || '!' AS label, upper(replace(o_orderpriority, '-', ' ')) AS name, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def canonical_by_table(spark, folder):
    orders = views.table(spark, folder, "orders")
    aliases = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("_n")).select(
        F.lower(_messy(F.col("o_orderpriority"))).alias("label"),
        F.upper(F.regexp_replace("o_orderpriority", "-", " ")).alias("canonical"),
    )
    named = clean.canonical_by_table(
        orders.select("o_orderpriority", _messy(F.col("o_orderpriority")).alias("name")), "name", aliases
    )
    return named.groupBy(F.concat("o_orderpriority", F.lit("!")).alias("label"), "name").agg(F.count(F.lit(1)).alias("n"))


@register("clean_numbers", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS price,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS amount FROM lineitem""")
def clean_numbers(spark, folder):
    marker = F.when(F.col("l_returnflag") == "A", "-").when(F.col("l_returnflag") == "R", " -- ").otherwise("N/A")
    price = F.when(F.col("l_discount") == 0, marker).otherwise(
        F.concat(F.lit(" "), F.format_number("l_extendedprice", 2), F.lit(" ")))
    amount = F.when(F.col("l_tax") == 0, F.lit("n.d. 7")).otherwise(F.col("l_quantity").cast("string"))
    return views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.round(clean.number(price), 2).alias("price"), clean.number(amount).alias("amount"),
    )


@register("zero_ref_null", f"""{with_ctes(REFS, DAILY)}
SELECT dam, date, rwl_m, round(nhwl_m, 6) AS nhwl_m, round(rule_curve_m, 6) AS rule_curve_m,
  round(rwl_m - nhwl_m, 6) AS dev_nhwl_m, round(rwl_m - rule_curve_m, 6) AS dev_rule_curve_m
FROM daily JOIN refs USING (dam)""")
def zero_ref_null(spark, folder):
    return rounded(views.daily(spark, folder).select(
        "dam", "date", "rwl_m", "nhwl_m", "rule_curve_m", "dev_nhwl_m", "dev_rule_curve_m"))


@register("resolve_year", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOUR + INTERVAL 5 MINUTE AS obs_datetime FROM orders""")
def resolve_year(spark, folder):
    seen = F.col("o_orderdate") + F.expr("interval 20 days")
    day = clean.month_day_to_date(F.date_format("o_orderdate", "MMM-dd"), seen)
    return views.table(spark, folder, "orders").select(
        "o_orderkey", day.alias("day"), clean.at_clock(day, F.lit(" 08:05 pm ")).alias("obs_datetime"))


@register("bad_clock", """
SELECT event_id, CASE WHEN event_type = 'view' THEN date_trunc('minute', ts) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS obs_datetime
FROM events""")
def bad_clock(spark, folder):
    text = F.when(F.col("event_type") == "view", F.lower(F.date_format("ts", "hh:mm a"))).otherwise(F.date_format("ts", "HH-mm"))
    return views.table(spark, folder, "events").select("event_id", clean.at_clock(F.to_date("ts"), text).alias("obs_datetime"))


@register("alert_flag", """
SELECT event_id, event_type = 'error' AS on_watch,
  CASE WHEN user_id % 10 = 0 THEN 'dam_sub_basin' ELSE 'river_basin' END AS kind FROM events""")
def alert_flag(spark, folder):
    status = F.when(F.col("event_type") == "error", " Flood Watch").otherwise(" Non-Flood Watch ")
    name = F.concat(F.lit("Basin "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 10 == 0, " SUB-basin").otherwise(""))
    return views.table(spark, folder, "events").select(
        "event_id", clean.is_alert(status).alias("on_watch"), clean.alert_kind(name).alias("kind"))


@register("noise_filter", """
WITH lines AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, source, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines
WHERE NOT regexp_matches(line, '(?i)license|cookie|status') AND trim(line) <> '' GROUP BY lang, source""")
def noise_filter(spark, folder):
    lines = views.table(spark, folder, "documents").select("lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    kept = lines.filter(~clean.matches(F.col("line"), "license|cookie|status") & (F.trim("line") != ""))
    return kept.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("line").cast("long")).alias("chars"))


@register("seasonal", """
SELECT o_orderkey, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_sin,
  round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_cos FROM orders""")
def seasonal(spark, folder):
    sin, cos = numeric.seasonal(F.to_date("o_orderdate"))
    return rounded(views.table(spark, folder, "orders").select("o_orderkey", sin.alias("doy_sin"), cos.alias("doy_cos")))


@register("catchment_points", f"""{with_ctes(REGISTRY)},
offsets AS (SELECT *, 12 / 111.32 AS dlat, 12 / (111.32 * cos(radians(lat))) AS dlon FROM registry)
SELECT dam, 0 AS point, lat, lon FROM offsets UNION ALL SELECT dam, 1, round(lat + dlat, 4), lon FROM offsets
UNION ALL SELECT dam, 2, round(lat - dlat, 4), lon FROM offsets UNION ALL SELECT dam, 3, lat, round(lon + dlon, 4) FROM offsets
UNION ALL SELECT dam, 4, lat, round(lon - dlon, 4) FROM offsets""")
def catchment_points(spark, folder):
    return geo.catchment_points(views.registry(spark, folder))


@register("nan_to_null", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value,
  CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 2 END AS INTEGER) AS n_known
FROM events""")
def nan_to_null(spark, folder):
    nan = F.lit(float("nan"))
    value = F.when(F.col("event_type") == "view", nan).otherwise(F.col("value"))
    pair = F.array(value, F.when(F.col("event_type") == "click", nan).otherwise(F.col("value")))
    dirty = views.table(spark, folder, "events").select("event_id", value.alias("value"), pair.alias("pair"))
    return clean.nan_free(dirty).select(
        "event_id", "value", F.size(F.filter("pair", lambda v: v.isNotNull())).alias("n_known"))


@register("iso_stamps", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS minute_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second_text,
  CAST(ts AS DATE) AS day, CAST(ts AS DATE) + 3 AS later, CAST(ts AS DATE) - 2 AS earlier FROM events""")
def iso_stamps(spark, folder):
    return views.table(spark, folder, "events").select(
        "event_id", clean.iso_minute(F.col("ts")).alias("minute_text"), clean.iso_second(F.col("ts")).alias("second_text"),
        clean.to_day(F.col("ts")).alias("day"), F.date_add(F.to_date("ts"), 3).alias("later"),
        F.date_sub(F.to_date("ts"), 2).alias("earlier"))


@register("known_entities", f"""{with_ctes(DAILY, REGISTRY)}
SELECT dam, date, rwl_m FROM daily WHERE dam IN (SELECT dam FROM registry)""")
def known_entities(spark, folder):
    daily = views.daily(spark, folder).select("dam", "date", "rwl_m")
    return daily.join(views.registry(spark, folder).select("dam"), "dam", "left_semi")


@register("registry_attach", f"""{with_ctes(DAILY, REGISTRY)}
SELECT dam, date, rwl_m, lat, lon, basin FROM daily LEFT JOIN registry USING (dam)""")
def registry_attach(spark, folder):
    daily = views.daily(spark, folder).select("dam", "date", "rwl_m")
    return daily.join(views.registry(spark, folder), "dam", "left")


@register("reservoir_names", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Magat' WHEN '2-HIGH' THEN 'La Mesa'
  ELSE 'Unlisted ' || o_orderpriority END AS dam FROM orders""")
def reservoir_names(spark, folder):
    """The fixed alias list, met in the data under varying spelling."""
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.when(F.col("o_totalprice") > 100000, "MAGAT  dam").otherwise(" magat"))
        .when(F.col("o_orderpriority") == "2-HIGH", "La  Mesa\nDam ")
        .otherwise(F.concat(F.lit(" Unlisted   "), F.col("o_orderpriority")))
    )
    return views.table(spark, folder, "orders").select("o_orderkey", clean.canonical(label, ALIASES).alias("dam"))


