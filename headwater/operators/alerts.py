"""Alert states per basin and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.constants import ALERT_HORIZONS, ALERT_MIN_DAYS, ALERT_MIN_EVENTS
from headwater.operators.series import rolling_mean, streak, value_at


def daily_alert_count(alerts: DataFrame, kind: str = "river_basin") -> DataFrame:
    return (
        alerts.filter(F.col("kind") == kind)
        .groupBy("date")
        .agg(F.count_if("on_watch").alias("basins_on_watch"))
    )


def national_share(alerts: DataFrame) -> DataFrame:
    """Share of basins on alert per day."""
    return alerts.groupBy("date").agg(F.avg(F.col("on_watch").cast("double")).alias("national_share"))


def attach_daily(df: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join a table with one row per date.

    Its size is bounded by the number of calendar days, so it is broadcast:
    a shuffle on the date would send whole days to single tasks.
    """
    return df.join(F.broadcast(daily), "date", "left")


def alert_features(alerts: DataFrame, kind: str = "river_basin") -> DataFrame:
    """Recent alert history of each basin, and the share over all of them."""
    basins = alerts.filter(F.col("kind") == kind)
    flagged = basins.withColumn("watch_today", F.col("on_watch").cast("double"))
    for n in (3, 7):
        flagged = rolling_mean(flagged, ["watch_today"], n, 1, ["basin"], prefix=f"_{n}_")
        flagged = flagged.withColumnRenamed(f"_{n}_watch_today", f"watch_{n}d")
    return attach_daily(streak(flagged, "on_watch", "basin"), national_share(basins))


def alert_targets(features: DataFrame, horizons: Sequence[int] = ALERT_HORIZONS) -> DataFrame:
    """One row per basin, day and horizon whose target day was observed."""
    ahead = [
        F.struct(F.lit(h).alias("horizon"), value_at("watch_today", h, "basin").alias("target"))
        for h in horizons
    ]
    return (
        features.withColumn("_all", F.array(*ahead))
        .withColumn("_ahead", F.explode("_all"))
        .select("*", "_ahead.horizon", "_ahead.target")
        .drop("_ahead", "_all")
        .filter(F.col("target").isNotNull())
        .withColumn("target", F.col("target").cast("int"))
    )


def confusion(scored: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Counts, accuracy, recall and precision of the model and of persistence."""
    columns = [F.count(F.lit(1)).alias("n")]
    for who, prediction in (("model", "pred"), ("persistence", "persistence")):
        p, a = F.col(prediction) == 1, F.col("actual") == 1
        tp, fp, fn = F.count_if(p & a), F.count_if(p & ~a), F.count_if(~p & a)
        columns += [
            tp.alias(f"{who}_tp"), fp.alias(f"{who}_fp"), fn.alias(f"{who}_fn"),
            F.avg((p == a).cast("double")).alias(f"{who}_accuracy"),
            F.try_divide(tp, tp + fn).alias(f"{who}_recall"),
            F.try_divide(tp, tp + fp).alias(f"{who}_precision"),
        ]
    table = scored.groupBy(*by).agg(*columns)
    better = F.col("model_recall") > F.col("persistence_recall")
    return table.withColumn("beats_baseline", F.coalesce(better, F.lit(False)))


def status_gate(alerts: DataFrame, targets: DataFrame, min_days: int = ALERT_MIN_DAYS,
                min_events: int = ALERT_MIN_EVENTS) -> DataFrame:
    """One row telling whether there is enough history to publish a score."""
    seen = alerts.agg(
        F.count_distinct("date").alias("days_collected"), F.count_distinct("basin").alias("basins")
    )
    outcome = targets.agg(F.struct(
        F.coalesce(F.sum(F.col("target").cast("long")), F.lit(0)).alias("watch_days_seen"),
        F.count(F.lit(1)).alias("n_targets"),
    )).scalar()
    both = seen.withColumn("_o", outcome).select("*", "_o.*").drop("_o")
    status = (
        F.when(F.col("days_collected") == 0, "no data")
        .when((F.col("days_collected") < min_days) | (F.col("n_targets") == 0), "not enough history yet")
        .when(F.col("watch_days_seen") < min_events, "not enough flood-watch days to learn from")
        .otherwise("scored")
    )
    return both.withColumn("status", status)


def alert_board(alerts: DataFrame) -> DataFrame:
    """The latest day's states, alerts first, then by name."""
    latest = latest_day(alerts)
    return latest.select("basin", "status", "on_watch", "kind", "date").orderBy(
        F.col("on_watch").desc(), F.col("basin").asc()
    )


def latest_day(df: DataFrame, date: str = "date", per: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest day, over all entities or of each of them."""
    if per:
        newest = df.groupBy(*per).agg(F.max(date).alias("_newest"))
        return df.join(newest, list(per)).filter(F.col(date) == F.col("_newest")).drop("_newest")
    newest = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) == newest)
