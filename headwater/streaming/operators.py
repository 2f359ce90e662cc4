"""The forecasting loop as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from headwater.operators.keys import first_seen as first_of_keys
from headwater.operators.drift import DELTA, AdaptiveWindow
from headwater.sources.files import upsert_partitions
from headwater.streaming.sources import event_time


def first_seen(readings: DataFrame, keys: Sequence[str], stamp: str = "obs_datetime", late: str = "2 days") -> DataFrame:
    """Keep the first reading of each key that arrives; later copies are dropped
    for as long as the watermark remembers the key."""
    timed = readings.withColumn("event_time", event_time(F.col(stamp))).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark([*keys])


BUCKETS = 1024  # states of a stream: a call for each key would cost far more than its few rows


class FirstSeenProcessor(StatefulProcessor):
    """The keys of the latest readings of a bucket's entities, each for as long as `late` behind its newest.

    A reading older than that, which may or may not have been seen, is passed on as late
    instead of being dropped. Readings of one batch count in the order of `order__`.
    """

    def __init__(self, columns: Sequence[str], entity: str, late: int):
        self.columns, self.entity, self.late = list(columns), entity, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One row of parallel arrays: an entity's part of the keys, its newest stamp, and each stamp remembered.
        self._state = handle.getValueState("seen", "entity array<string>, part array<int>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("order__", kind="stable", ignore_index=True)
        stored = self._state.get() if self._state.exists() else ([], [], [])
        known = pd.DataFrame({"e": pd.Series(stored[0], dtype=object), "p": pd.Series(stored[1], dtype="int64"), "at": pd.Series(stored[2], dtype="int64")})
        new = pd.DataFrame({"e": fresh[self.entity].to_numpy(object), "p": fresh["salt__"].to_numpy("int64"), "at": fresh["at__"].to_numpy("int64")})
        both = pd.concat([known, new], ignore_index=True)
        who = both.groupby(["e", "p"], sort=False, dropna=False).ngroup().to_numpy()
        at, was = both["at"].to_numpy(), np.arange(len(both)) < len(known)
        least = np.iinfo(np.int64).min
        before, top = np.full(who.max() + 1, least), np.full(who.max() + 1, least)
        np.maximum.at(before, who[was], at[was])
        np.maximum.at(top, who, at)
        late = ~was & (before[who] > least) & (at < before[who] - self.late)
        # The first of each stamp, the stored one before all others; late ones among themselves.
        first = ~pd.DataFrame({"who": who, "at": at, "late": late}).duplicated().to_numpy()
        kept = first & ~late & (at >= top[who] - self.late)
        self._state.update((both["e"].to_numpy()[kept].tolist(), both["p"].to_numpy()[kept].tolist(), at[kept].tolist()))
        picked = (first & ~was)[len(known):]
        yield fresh.loc[picked, self.columns].assign(late=late[len(known):][picked])

    def close(self) -> None:
        pass


def first_seen_or_late(readings: DataFrame, entity: str, stamp: str, order: str, late: str = "2 days", salts: int = 8,
                       buckets: int = BUCKETS) -> DataFrame:
    """The first reading of each (entity, stamp), and those too late to tell, flagged `late`.

    No reading is lost: `settle` decides about late ones against the stored table. An
    entity's stamps are dealt out to `salts` parts, so a hot one is several; parts lie in
    `buckets` states, a number that a stream keeps.
    """
    columns = readings.columns
    kept = int(pd.Timedelta(late) / pd.Timedelta(1, "us"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = readings.withColumns({"at__": micros(stamp), "order__": micros(order)}).withColumn("salt__", F.pmod(F.xxhash64("at__"), F.lit(salts)))
    rows = rows.withColumn("bucket__", F.pmod(F.xxhash64(entity, "salt__"), F.lit(buckets)))
    schema = ", ".join(f"`{c}` {dict(readings.dtypes)[c]}" for c in columns) + ", late boolean"
    return rows.groupBy("bucket__").transformWithStateInPandas(FirstSeenProcessor(columns, entity, kept), schema, "Append", "None")


def stored_batches(rows: DataFrame, path: str, state: str):
    """A query that keeps each batch in a folder of its own: a replayed batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def settle(stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table that first readings and late ones make together: a late one counts where its key has no other."""
    first = stored.filter(~F.col("late")).drop("late")
    return first.unionByName(first_of_keys(first, stored.filter("late").drop("late"), keys, order))


def score_due(forecasts: DataFrame, observations: DataFrame, late: str = "2 days") -> DataFrame:
    """Forecasts meet the observation of their target day.

    Both sides carry a watermark on that day and are joined on it, so a forecast
    waits as state until its day has passed by the allowed lateness; one whose
    day was never observed then comes out without an actual.
    """
    issued = forecasts.withColumn("target_time", event_time(F.col("target_date"))).withWatermark("target_time", late)
    seen = observations.select(
        F.col("dam").alias("_dam"), F.col("rwl_m").alias("actual_rwl_m"), event_time(F.col("date")).alias("_seen_time")
    ).withWatermark("_seen_time", late)
    joined = issued.join(
        seen, (F.col("dam") == F.col("_dam")) & (F.col("target_time") == F.col("_seen_time")), "left_outer"
    )
    actual = F.col("actual_rwl_m") - F.col("issue_rwl_m")
    return joined.withColumns(
        {
            "actual_delta": actual,
            "abs_err_model": F.abs(F.col("pred_delta") - actual),
            "landed": F.col("actual_rwl_m").isNotNull(),
        }
    ).drop("_dam", "_seen_time")


def daily_alerts(alerts: DataFrame, stamp: str = "scraped_at", late: str = "1 day") -> DataFrame:
    """Alert readings, and their share, per tumbling day."""
    timed = alerts.withColumn("event_time", event_time(F.col(stamp))).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("on_watch").alias("alerts"),
        F.avg(F.col("on_watch").cast("double")).alias("share"),
    ).select(F.to_date("w.start").alias("date"), "readings", "alerts", "share")


DRIFT_OUTPUT = "dam string, horizon int, detected_at date, abs_err double"
STATS_OUTPUT = "dam string, n long, mean double, sd double, upto date"


class DriftProcessor(StatefulProcessor):
    """Adaptive error windows of a bucket's (dam, horizon) series, kept across runs.

    The state is the windows' buckets, logarithmic in their length.
    """

    def __init__(self, delta: float = DELTA):
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "windows", "dam array<string>, horizon array<int>, n array<array<double>>, total array<array<double>>, squares array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self._state.get() if self._state.exists() else ([], [], [], [], [])
        windows = {(dam, horizon): AdaptiveWindow(list(zip(*parts)), delta=self.delta) for dam, horizon, *parts in zip(*stored)}
        fresh = pd.concat(list(rows)).sort_values("target_date", kind="stable")
        hits = []
        dams, horizons = fresh["dam"].astype(object), fresh["horizon"].astype(object)
        names = zip(dams.where(dams.notna(), None), horizons.where(horizons.notna(), None))
        for (dam, horizon), error in zip(names, fresh["abs_err_model"].tolist()):
            series = dam, None if horizon is None else int(horizon)
            if series not in windows:
                windows[series] = AdaptiveWindow(delta=self.delta)
            hits.append(windows[series].add(float(error)))
        sums = [[[float(b[i]) for b in w.buckets] for w in windows.values()] for i in range(3)]
        self._state.update(([d for d, _ in windows], [h for _, h in windows], *sums))
        found = fresh[hits]
        yield pd.DataFrame({"dam": found["dam"], "horizon": found["horizon"], "detected_at": found["target_date"], "abs_err": found["abs_err_model"]})

    def close(self) -> None:
        pass


def drift_events(errors: DataFrame, delta: float = DELTA, buckets: int = BUCKETS) -> DataFrame:
    """Detections per series; errors that are NULL or NaN say nothing and are left out.

    Series lie in `buckets` states, a number that a stream keeps.
    """
    known = errors.filter(F.col("abs_err_model").isNotNull() & ~F.isnan("abs_err_model"))
    rows = known.select("dam", "horizon", "target_date", "abs_err_model", F.pmod(F.xxhash64("dam", "horizon"), F.lit(buckets)).alias("bucket__"))
    return rows.groupBy("bucket__").transformWithStateInPandas(DriftProcessor(delta), DRIFT_OUTPUT, "Append", "None")


class StatsProcessor(StatefulProcessor):
    """Running count, mean and spread of a dam's labels."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self._state.get() if self._state.exists() else (0, 0.0, 0.0)
        upto = None
        for part in rows:
            values = part["actual_delta"].to_numpy(float)
            # Merge the batch's moments into the stored ones.
            k, batch_mean = len(values), values.mean()
            gap, total = batch_mean - mean, n + k
            m2 += ((values - batch_mean) ** 2).sum() + gap * gap * n * k / total
            mean, n = mean + gap * k / total, total
            newest = part["label_date"].max()
            upto = newest if upto is None else max(upto, newest)
        self._state.update((int(n), float(mean), float(m2)))
        yield pd.DataFrame({"dam": [key[0]], "n": [n], "mean": [mean], "sd": [math.sqrt(m2 / n)], "upto": [upto]})

    def close(self) -> None:
        pass


def running_stats(labels: DataFrame) -> DataFrame:
    """One row per dam and batch: its label statistics so far. Labels that are NULL or
    NaN are left out, so a batch of such labels alone gives no row."""
    known = labels.filter(F.col("actual_delta").isNotNull() & ~F.isnan("actual_delta"))
    return known.select("dam", "actual_delta", "label_date").groupBy("dam").transformWithStateInPandas(
        StatsProcessor(), STATS_OUTPUT, "Update", "None")


def upsert_batches(path: str, keys: Sequence[str], precedence: Sequence[Column], partition: str):
    """A foreachBatch sink. Replaying a batch leaves the table as it is."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_partitions(batch, path, keys, precedence, partition)

    return write


def upsert_stream(rows: DataFrame, path: str, state: str, keys: Sequence[str], precedence: Sequence[Column], partition: str):
    return (
        rows.writeStream.foreachBatch(upsert_batches(path, keys, precedence, partition))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


__all__ = ["first_seen", "first_seen_or_late", "stored_batches", "settle", "score_due", "daily_alerts", "drift_events", "running_stats", "upsert_stream"]
