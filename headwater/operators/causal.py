"""Statistics of labels that were already known when a forecast was issued.

A label becomes known on its label date, which is the issue date plus the
horizon. A running statistic over one pool would be one task's window over all
rows. Instead rows are first reduced to one block per (key, day) by an ordinary
aggregate, and only the blocks, of which a key has at most one per calendar
day, are accumulated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.constants import FLAT_SD, SEARCH_SCALE_FLOOR, SEARCH_SCALE_MIN_N
from headwater.functions.numeric import causal_z, population_sd
from headwater.session import materialise

POOLINGS = ("none", "dam", "horizon", "all")
ENTITY_POOLS = ("none", "horizon")  # those within one dam


def pool_key(scheme: str) -> Column:
    """Rows that share one learner.

    "dam" pools all dams of a horizon, "horizon" all horizons of a dam.
    """
    horizon = F.col("horizon").cast("string")
    return {
        "none": F.concat_ws("|", F.col("dam"), horizon),
        "dam": horizon,
        "horizon": F.col("dam"),
        "all": F.lit("all"),
    }[scheme]


def label_prefix(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column],
                 known: Column | None = None, before: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Sums over labels known up to each issue date, one row per (keys, date).

    `rows` needs date, label_date and target_delta. Each row contributes at its
    label date; zero rows at the issue dates turn the later lookup into an equi
    join. `known` says which rows are labelled. `before` has the sums of labels that
    `rows` no longer hold, as of a date: an earlier call's row of each key. written: rows that
    are read from files; their issue dates are then read apart, and no row carries zeros.
    """
    known = F.col("target_delta").isNotNull() if known is None else known
    values = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in sums.items()]
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    if written and before is None:
        labels = rows.filter(known & F.col("label_date").isNotNull()).select(*keys, F.col("label_date").alias("date"), *values)
        labels = labels.groupBy(*keys, "date").agg(*[F.sum(n).alias(n) for n in sums])
        issues = rows.select(*keys, "date").filter(F.col("date").isNotNull()).distinct()
        blocks = labels.unionByName(issues.select("*", *[F.lit(0.0).alias(n) for n in sums]))
        blocks = blocks.groupBy(*keys, "date").agg(*[F.sum(n).alias(n) for n in sums])
        return blocks.withColumns({n: F.sum(n).over(past) for n in sums})
    label = F.struct(
        F.when(known, F.col("label_date")).alias("at"),
        *values,
    )
    issue = F.struct(F.col("date").alias("at"), *[F.lit(0.0).alias(n) for n in sums])
    blocks = (
        rows.select(*keys, F.explode(F.array(label, issue)).alias("_c"))
        .filter(F.col("_c.at").isNotNull())
        .groupBy(*keys, F.col("_c.at").alias("date"))
        .agg(*[F.sum(f"_c.{n}").alias(n) for n in sums])
    )
    if before is not None:
        blocks = blocks.unionByName(before.select(*blocks.columns)).groupBy(*keys, "date").agg(*[F.sum(n).alias(n) for n in sums])
    return blocks.withColumns({n: F.sum(n).over(past) for n in sums})


def with_pool_sums(rows: DataFrame, pooling: str, sums: Mapping[str, Column], written: bool = True) -> DataFrame:
    """The `label_prefix` of each row's pool beside the row; written: rows that are read from files.

    Sums of pools over many dams are a few per day, whatever the number of dams: they are
    written once and broadcast, and the rows stay where they are. Those within a dam are as many
    as the rows; they are running sums over the dam's labels and rows, and rows that lie
    together by dam (`repartition("dam")`) move for none of them.
    """
    keyed = rows.withColumn("_pool", pool_key(pooling))
    if pooling not in ENTITY_POOLS:
        past = materialise(label_prefix(keyed, ["_pool"], sums, written=written), "past")
        return keyed.join(F.broadcast(past), ["_pool", "date"], "left").drop("_pool")
    known, row = F.col("target_delta").isNotNull(), F.struct(*[c for c in rows.columns if c != "dam"])
    values = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in sums.items()]
    label = F.struct(F.when(known, F.col("label_date")).alias("_at"), F.when(F.lit(False), row).alias("_row"), *values)
    issue = F.struct(F.col("date").alias("_at"), row.alias("_row"), *[F.lit(0.0).alias(n) for n in sums])
    events = keyed.select("dam", "_pool", F.explode(F.array(label, issue)).alias("_c")).select("dam", "_pool", "_c.*")
    events = events.filter(F.col("_at").isNotNull() | F.col("_row").isNotNull())
    # Labels of the row's own day count, as peers do in a range.
    past = Window.partitionBy("dam", "_pool").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Without a pool or a date nothing is known, as in a join.
    found = F.col("_pool").isNotNull() & F.col("_at").isNotNull()
    summed = events.withColumns({n: F.sum(n).over(past) for n in sums}).filter(F.col("_row").isNotNull())
    # The dam stays a column of its own, by which Spark knows how the rows lie.
    kept = [F.col(c) if c == "dam" else F.col(f"_row.{c}") for c in rows.columns]
    return summed.select(*kept, *[F.when(found, F.col(n)).alias(n) for n in sums])


def _moments(value: Column) -> dict[str, Column]:
    return {
        "past_n": value.isNotNull().cast("double"),
        "past_sum": value,
        "past_sq": value * value,
    }


def target_moments(rows: DataFrame, known: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """(dam, date, past_n, past_sum, past_sq): sums of each dam's known targets per date."""
    return label_prefix(rows, ["dam"], _moments(F.col("target_delta")), known, before)


def target_scale(rows: DataFrame, minimum: int = 2, floor: float | None = None, past: DataFrame | None = None) -> DataFrame:
    """Past count, mean and spread of each dam's target per issue date.

    `scale` is NULL below `minimum` labels; without a floor also where the
    spread is flat, and then nothing is scaled, neither target nor prediction.
    `past` may give the moments.
    """
    past = target_moments(rows) if past is None else past
    sd = population_sd(F.col("past_n"), F.col("past_sum"), F.col("past_sq"))
    usable = F.greatest(sd, F.lit(floor)) if floor else F.when(sd > FLAT_SD, sd)
    return past.select(
        "dam", "date", F.col("past_n").cast("long").alias("label_n"),
        F.try_divide("past_sum", "past_n").alias("label_mean"),
        F.when(F.col("past_n") >= minimum, usable).alias("scale"),
    )


def with_target_scale(rows: DataFrame, search: bool = False) -> DataFrame:
    """Attach the scale known at each row's issue date, for the target and the
    prediction alike."""
    scale = (
        target_scale(rows, SEARCH_SCALE_MIN_N, SEARCH_SCALE_FLOOR) if search else target_scale(rows)
    )
    return rows.join(scale, ["dam", "date"], "left")


def scaled_target(scaled: bool = True) -> Column:
    target = F.col("target_delta")
    return target / F.coalesce(F.col("scale"), F.lit(1.0)) if scaled else target


def unscaled(prediction: Column) -> Column:
    return prediction * F.coalesce(F.col("scale"), F.lit(1.0))


def with_causal_z(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Z-scores of features against rows whose label was known at issue time.

    The statistics are made once per key and date, not again for each row. few: keys that are
    a few per day, whatever the number of dams; then they are written, so that joins know their
    size and the rows stay where they are.
    """
    keys = list(keys)
    if not keys:
        rows, keys = rows.withColumn("_pool", F.lit("all")), ["_pool"]
    sums = {}
    for f in features:
        sums |= {f"{name}_{f}": value for name, value in _moments(F.col(f)).items()}
    past = label_prefix(rows, keys, sums)
    known, out = [], {}
    for f in features:
        n, total, squares = (F.col(f"{m}_{f}") for m in ("past_n", "past_sum", "past_sq"))
        known += [n, F.try_divide(total, n).alias(f"past_mean_{f}"), population_sd(n, total, squares).alias(f"past_sd_{f}")]
        out[f"z_{f}"] = causal_z(F.col(f), *(F.col(f"past_{m}_{f}") for m in ("n", "mean", "sd")))
    past = past.select(*keys, "date", *known)
    joined = rows.join(materialise(past, "moments") if few else past, [*keys, "date"], "left").withColumns(out)
    return joined.drop(*past.columns[len(keys) + 1:], "_pool")


def scaled_losses(experts: Mapping[str, Column]) -> dict[str, Column]:
    """Each expert's loss, scaled by the row's worst loss."""
    losses = {e: F.abs(value - F.col("target_delta")) for e, value in experts.items()}
    worst = F.greatest(*losses.values(), F.lit(1e-6))
    return {f"_loss_{e}": loss / worst for e, loss in losses.items()}


def with_past_losses(rows: DataFrame, experts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Attach each expert's summed past loss, scaled by a row's worst loss."""
    past = label_prefix(rows, keys, scaled_losses({e: F.col(e) for e in experts}))
    return rows.join(past, [*keys, "date"], "left")


def expert_weights(experts: Sequence[str], eta) -> dict[str, Column]:
    """Weights from past losses. The multiplicative update has a closed form:
    the softmax of the negative summed losses."""
    rate = eta if isinstance(eta, Column) else F.lit(float(eta))
    smallest = F.least(*[F.col(f"_loss_{e}") for e in experts])
    raw = {e: F.exp(-rate * (F.col(f"_loss_{e}") - smallest)) for e in experts}
    total = sum(raw.values(), F.lit(0.0))
    return {e: w / total for e, w in raw.items()}


def expert_blend(rows: DataFrame, experts: Sequence[str], eta, keys: Sequence[str],
                 name: str = "blended") -> DataFrame:
    """Exponentially weighted mean of several forecasts, and its weights."""
    weights = expert_weights(experts, eta)
    joined = with_past_losses(rows, experts, keys).withColumns({f"w_{e}": w for e, w in weights.items()})
    mixed = sum((F.col(f"w_{e}") * F.col(e) for e in experts), F.lit(0.0))
    return joined.withColumn(name, mixed).drop(*[f"_loss_{e}" for e in experts])
