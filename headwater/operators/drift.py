"""Shifts in a forecast's error level."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELTA = 0.002


class AdaptiveWindow:
    """Adaptive windowing (Bifet and Gavalda, 2007) over bucketed sums.

    Recent values sit in small buckets, older ones in buckets of doubling size,
    so the state grows with the logarithm of the window.
    """

    PER_SIZE = 5
    MIN_SIDE = 5

    def __init__(self, buckets: Sequence[tuple] = (), delta: float = DELTA):
        self.delta = delta
        # (count, sum, sum of squares), oldest and largest first.
        self.buckets = [tuple(b) for b in buckets]
        self.n, self.total, self.squares = (sum(b[j] for b in self.buckets) for j in range(3))

    def add(self, value: float) -> bool:
        """Take one value; true if the mean has shifted and the past was cut."""
        self.buckets.append((1, value, value * value))
        self.n, self.total, self.squares = self.n + 1, self.total + value, self.squares + value * value
        self._merge()
        cut = False
        while self.n >= 2 * self.MIN_SIDE and self._shifted():
            count, part, square = self.buckets.pop(0)
            self.n, self.total, self.squares = self.n - count, self.total - part, self.squares - square
            cut = True
        return cut

    def _merge(self) -> None:
        """Merge the two oldest buckets of a size that has one too many."""
        end, size = len(self.buckets), 1
        while True:
            start = end
            while start > 0 and self.buckets[start - 1][0] == size:
                start -= 1
            if end - start <= self.PER_SIZE:
                return
            older, newer = self.buckets[start:start + 2]
            self.buckets[start:start + 2] = [tuple(a + b for a, b in zip(older, newer))]
            end, size = start + 1, size * 2

    def _shifted(self) -> bool:
        n, total = self.n, self.total
        variance = max(self.squares / n - (total / n) ** 2, 0.0)
        log = math.log(2.0 * math.log(n) / self.delta)
        n0 = s0 = 0.0
        for count, part, _ in self.buckets[:-1]:
            n0, s0 = n0 + count, s0 + part
            n1 = n - n0
            if n0 < self.MIN_SIDE or n1 < self.MIN_SIDE:
                continue
            inverse = 1.0 / n0 + 1.0 / n1
            bound = math.sqrt(2.0 * inverse * variance * log) + 2.0 / 3.0 * inverse * log
            if abs(s0 / n0 - (total - s0) / n1) > bound:
                return True
        return False


def drift_events(errors: DataFrame, date: str = "target_date", delta: float = DELTA) -> DataFrame:
    """Days on which the error of a (dam, horizon) series shifted.

    The error log holds one row per (dam, horizon, day), so the array of a
    series is bounded by the calendar. Series travel to Python as rows: a call
    per group would cost far more than the few values in it.
    """

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = []
            for dam, horizon, days, values in batch.itertuples(index=False):
                window = AdaptiveWindow(delta=delta)
                hits += [(d, dam, horizon, v) for d, v in zip(days, values) if window.add(v)]
            yield pd.DataFrame(hits, columns=["day", "dam", "horizon", "abs_err"])

    point = F.struct(F.unix_date(date).alias("day"), F.col("abs_err_model").alias("abs_err"))
    known = errors.filter(F.col("abs_err_model").isNotNull() & ~F.isnan("abs_err_model"))
    series = known.groupBy("dam", "horizon").agg(F.sort_array(F.collect_list(point)).alias("s"))
    found = series.select("dam", "horizon", "s.day", "s.abs_err").mapInPandas(
        detect, "day int, dam string, horizon int, abs_err double"
    )
    return found.select(F.date_from_unix_date("day").alias("detected_at"), "dam", "horizon", "abs_err")


STATE = "dam string, horizon int, n array<double>, total array<double>, squares array<double>"


def drift_step(state: DataFrame | None, errors: DataFrame, date: str = "target_date", delta: float = DELTA) -> DataFrame:
    """Take new errors into stored windows: (STATE columns, events).

    `state` holds the buckets of each series, logarithmic in its length; series without
    new errors keep theirs. events are the (day, abs_err) at which a window was cut. The
    errors of a call must be later than those of former calls, as a log's are.
    """
    point = F.struct(F.unix_date(date).alias("day"), F.col("abs_err_model").alias("abs_err"))
    known = errors.filter(F.col("abs_err_model").isNotNull() & ~F.isnan("abs_err_model"))
    fresh = known.groupBy("dam", "horizon").agg(F.sort_array(F.collect_list(point)).alias("s"))
    if state is None:
        state = errors.sparkSession.createDataFrame([], STATE)
    schema = f"{STATE}, events array<struct<day: int, abs_err: double>>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dam, horizon, days, values, n, total, squares in batch.itertuples(index=False):
                window = AdaptiveWindow(list(zip(n, total, squares)) if n is not None else (), delta=delta)
                hits = [{"day": d, "abs_err": v} for d, v in zip(days, values) if window.add(v)]
                out.append((dam, horizon, *([float(b[i]) for b in window.buckets] for i in range(3)), hits))
            yield pd.DataFrame(out, columns=["dam", "horizon", "n", "total", "squares", "events"])

    both = fresh.join(state, ["dam", "horizon"], "left").select("dam", "horizon", "s.day", "s.abs_err", "n", "total", "squares")
    kept = state.join(fresh, ["dam", "horizon"], "left_anti").withColumn("events", F.array().cast("array<struct<day: int, abs_err: double>>"))
    return both.mapInPandas(add, schema).unionByName(kept)


def events_of(step: DataFrame) -> DataFrame:
    """The detections of a step, as `drift_events` gives them."""
    hit = step.select("dam", "horizon", F.explode("events").alias("e"))
    return hit.select(F.date_from_unix_date("e.day").alias("detected_at"), "dam", "horizon", F.col("e.abs_err").alias("abs_err"))


def mean_shift(errors: DataFrame, date: str = "target_date", recent: int = 10, delta: float = DELTA,
               value: str = "abs_err_model") -> DataFrame:
    """The same question by windows alone: the last rows against all before.

    A Hoeffding bound over the range of errors seen so far decides.
    """
    w = Window.partitionBy("dam", "horizon").orderBy(date)
    now, before = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(Window.unboundedPreceding, -recent)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    stats = errors.withColumns(
        {
            "recent_n": F.count(value).over(now),
            "recent_mean": F.avg(value).over(now),
            "past_n": F.count(value).over(before),
            "past_mean": F.avg(value).over(before),
            "_range": F.max(value).over(so_far) - F.min(value).over(so_far),
        }
    )
    inverse = F.try_divide(F.lit(1.0), F.col("recent_n")) + F.try_divide(F.lit(1.0), F.col("past_n"))
    bound = F.col("_range") * F.sqrt(inverse * F.lit(math.log(2.0 / delta) / 2.0))
    # In a flat series the bound is 0, and a difference only rounding.
    gap = F.abs(F.col("recent_mean") - F.col("past_mean"))
    shifted = (F.col("past_n") >= recent) & (gap > bound + F.lit(1e-9))
    return stats.withColumns({"bound": bound, "shifted": F.coalesce(shifted, F.lit(False))}).drop("_range")


def replay(values: Iterator[float], delta: float = DELTA) -> list[int]:
    """Positions at which one series, given in order, is cut."""
    window = AdaptiveWindow(delta=delta)
    return [i for i, v in enumerate(values) if window.add(v)]
