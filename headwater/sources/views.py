"""The given tables in the roles of the forecasting inputs.

events      level readings, weather, lead forecasts and alerts per user
orders      a long daily series per priority
customer    with nation and region: the registry
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.constants import DAILY_VARIABLES
from headwater.functions.clean import alert_kind, blank_undefined_reference, is_alert
from headwater.operators.series import daily_first, densify
from headwater.session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dam_id():
    return F.col("user_id").cast("string").alias("dam")


def run_key():
    """The number in an event's JSON properties."""
    return F.get_json_object("props", "$.k").try_cast("double")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Raw readings, keyed (dam, obs_datetime)."""
    return table(spark, folder, "events").select(
        dam_id(), F.col("ts").alias("obs_datetime"), F.col("value").alias("rwl_m"),
        run_key().alias("inflow_cms"), (run_key() / 2).alias("outflow_cms"),
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """High-water level and rule curve per dam; 0 where a dam has none."""
    value = F.col("value")
    spread = F.stddev_pop(value)
    return table(spark, folder, "events").groupBy(dam_id()).agg(
        F.when(F.first("user_id") % 5 == 0, 0.0).otherwise(F.avg(value) + 1.5 * spread).alias("nhwl_m"),
        F.when(F.first("user_id") % 3 == 0, 0.0).otherwise(F.avg(value) + 0.5 * spread).alias("rule_curve_m"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """First reading per dam and day, with the deviations from its references."""
    return _with_references(daily_first(readings(spark, folder)), references(spark, folder))


def _with_references(levels: DataFrame, refs: DataFrame) -> DataFrame:
    levels = levels.join(refs, "dam", "left")
    levels = levels.withColumns(
        {
            "dev_nhwl_m": F.col("rwl_m") - F.col("nhwl_m"),
            "dev_rule_curve_m": F.col("rwl_m") - F.col("rule_curve_m"),
        }
    )
    return blank_undefined_reference(levels, {"nhwl_m": "dev_nhwl_m", "rule_curve_m": "dev_rule_curve_m"})


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """A dense daily series per dam; a day without readings holds NULLs."""
    rain = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    observed = table(spark, folder, "events").groupBy(dam_id(), F.to_date("ts").alias("date")).agg(
        F.sum(rain).alias("precipitation_sum"),
        F.avg("value").alias("temperature_2m_mean"),
        F.max("value").alias("temperature_2m_max"),
        F.avg(run_key()).alias("relative_humidity_2m_mean"),
        F.min("value").alias("et0_fao_evapotranspiration"),
    )
    return densify(observed)


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Lead forecasts issued with each first reading; how far they reach varies."""
    return _lead_forecasts(daily_first(readings(spark, folder)))


def _lead_forecasts(first: DataFrame) -> DataFrame:
    reach = F.least(F.lit(7), F.floor(F.col("inflow_cms") / 10).cast("int") + 1)
    issued = first.select("dam", F.col("date").alias("issue"), "rwl_m", F.explode(F.sequence(F.lit(1), reach)).alias("lead"))
    return issued.select(
        "dam", F.date_add("issue", F.col("lead")).alias("date"), "lead",
        (F.col("rwl_m") / (F.col("lead") + 1)).alias("rain_mm"),
    )


def basin_name():
    return F.concat(F.lit("Basin "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 10 == 0, " Sub-basin").otherwise(""))


def alert_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every alert reading: an error event raises the alert."""
    name = basin_name()
    status = F.when(F.col("event_type") == "error", "Flood Watch").otherwise("Non-Flood Watch")
    return table(spark, folder, "events").select(
        name.alias("basin"), status.alias("status"), is_alert(status).alias("on_watch"),
        alert_kind(name).alias("kind"), F.to_date("ts").alias("date"), F.col("ts").alias("scraped_at"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """One state per basin and day: on alert if any reading of the day was."""
    return alert_readings(spark, folder).groupBy("basin", "kind", "date").agg(
        F.max("on_watch").alias("on_watch"), F.max("scraped_at").alias("scraped_at")
    ).withColumn("status", F.when(F.col("on_watch"), "Flood Watch").otherwise("Non-Flood Watch"))


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """What every role needs of a user's day, from one pass over the events and written once.

    The roles below that are made of it read a row per user and day, not the events.
    """
    value, key = F.col("value"), F.col("k")
    events = table(spark, folder, "events").withColumn("k", run_key())
    days = events.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.min_by(value, "ts").alias("rwl_m"), F.min_by(key, "ts").alias("inflow_cms"), F.min_by(key / 2, "ts").alias("outflow_cms"),
        F.sum(F.when(F.col("event_type").isin("view", "click"), value)).alias("precipitation_sum"), F.count(value).alias("n"),
        F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.avg(value).alias("temperature_2m_mean"),
        F.max(value).alias("temperature_2m_max"), F.avg(key).alias("relative_humidity_2m_mean"), F.min(value).alias("et0_fao_evapotranspiration"),
        F.max(F.col("event_type") == "error").alias("on_watch"), F.max("ts").alias("scraped_at"))
    return materialise(days, "event-days")


def _level_days(days: DataFrame) -> DataFrame:
    return days.select(dam_id(), "date", "rwl_m", "inflow_cms", "outflow_cms")


def roles_of(days: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(daily, weather, forecasts, alerts) of `event_days`, as the functions above give them."""
    n, total, squares = (F.sum(c) for c in ("n", "total", "squares"))
    mean = total / n
    spread = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    refs = days.groupBy("user_id").agg(mean.alias("mean"), spread.alias("spread")).select(
        dam_id(), F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("mean") + 1.5 * F.col("spread")).alias("nhwl_m"),
        F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(F.col("mean") + 0.5 * F.col("spread")).alias("rule_curve_m"))
    observed = days.select(dam_id(), "date", *DAILY_VARIABLES)
    name = basin_name()
    states = days.select(name.alias("basin"), alert_kind(name).alias("kind"), "date", "on_watch", "scraped_at")
    states = states.withColumn("status", F.when(F.col("on_watch"), "Flood Watch").otherwise("Non-Flood Watch"))
    return _with_references(_level_days(days), refs), densify(observed), _lead_forecasts(_level_days(days)), states


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as registered dams, placed by nation."""
    nation = table(spark, folder, "nation")
    place = nation.select(
        "n_nationkey", (F.col("n_nationkey") * 2.5 - 30).alias("lat"),
        (F.col("n_nationkey") * 10.0 - 120).alias("lon"), F.col("n_name").alias("basin"),
    )
    return (
        table(spark, folder, "customer")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").cast("string").alias("dam"), "lat", "lon", "basin")
    )


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily order value per priority."""
    return table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("dam"), F.to_date("o_orderdate").alias("date")
    ).agg(F.sum("o_totalprice").alias("rwl_m"))
