"""Expanding-window ridge regression, label-gated and pooled.

One pass reduces all rows to cross-product blocks per (pool, day). Their running
sums give the normal equations of every issue date, which small dense solves
inside tasks turn into coefficients. The sums serve every penalty and every
subset of the features, its variants.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.constants import FLAT_SD, Z_CLIP
from headwater.functions.numeric import clip, finite_or_zero
from headwater.operators.causal import pool_key, scaled_target, unscaled
from headwater.session import materialise

# Blocks a task holds before it passes them on; bounds its memory.
HELD_BLOCKS = 2048
# Sums of products of multiples of 1 / GRID are exact up to 2^33.
GRID = 1024.0
# Normal equations that a task unpacks and solves together.
SOLVED_AT_ONCE = 256
MODEL_SCHEMA = (
    "pool string, day int, variant int, known_n double, intercept double, "
    "beta array<double>, centre array<double>, spread array<double>"
)


def _design(frame: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    """Values with 0 for missing, presence flags, target, ones; rows weighted."""
    x = frame[list(features)].to_numpy(dtype=float)
    seen = ~np.isnan(x)
    y = frame["y"].to_numpy(dtype=float)[:, None]
    u = np.hstack([np.where(seen, x, 0.0), seen.astype(float), y, np.ones_like(y)])
    return u * np.sqrt(frame["w"].to_numpy(dtype=float))[:, None]


def _products(u: np.ndarray, coarse: np.ndarray, upper) -> np.ndarray:
    """Packed cross products of rows: those of their coarse parts, and what these lack."""
    fine = np.nan_to_num(u - coarse, nan=0.0)
    return np.stack([(coarse.T @ coarse)[upper], (coarse.T @ fine + fine.T @ u)[upper]])


def solve(grams: np.ndarray, p: int, penalty: float, use: np.ndarray | None = None):
    """Coefficients of standardised ridge for a stack of cross-product matrices.

    Features are centred and scaled with the moments in the matrices; a missing
    value counts as its mean. Flat features, and those not in `use`, get no
    coefficient. The intercept is the mean target and is not penalised.
    """
    xx, xm, mm = grams[:, :p, :p], grams[:, :p, p:2 * p], grams[:, p:2 * p, p:2 * p]
    xy, my = grams[:, :p, 2 * p], grams[:, p:2 * p, 2 * p]
    x1, m1 = grams[:, :p, 2 * p + 1], grams[:, p:2 * p, 2 * p + 1]
    n, ysum = grams[:, 2 * p + 1, 2 * p + 1], grams[:, 2 * p, 2 * p + 1]
    count = np.maximum(m1, 1e-300)
    centre = np.where(m1 > 0, x1 / count, 0.0)
    variance = np.where(m1 > 0, np.einsum("kii->ki", xx) / count - centre ** 2, 0.0)
    spread = np.sqrt(np.maximum(variance, 0.0))
    alive = spread > np.maximum(FLAT_SD, 1e-6 * np.abs(centre))
    if use is not None:
        alive &= use[None, :]
    spread = np.where(alive, spread, 1.0)
    cross = (
        xx - xm * centre[:, None, :] - np.swapaxes(xm, 1, 2) * centre[:, :, None]
        + mm * centre[:, :, None] * centre[:, None, :]
    )
    both = alive[:, :, None] & alive[:, None, :]
    z = np.where(both, cross / (spread[:, :, None] * spread[:, None, :]), 0.0)
    rhs = np.where(alive, (xy - centre * my) / spread, 0.0)
    beta = np.linalg.solve(z + penalty * np.eye(p)[None], rhs[:, :, None])[:, :, 0]
    intercept = np.where(n > 0, ysum / np.maximum(n, 1e-300), 0.0)
    return n, intercept, np.where(alive, beta, 0.0), centre, spread


# A variant of a learner: its penalty and the features it may use, all of them if None.
Variant = tuple[float, Sequence[str] | None]


def _models(pools, days, grams, features: Sequence[str], variants: Sequence[Variant]) -> pd.DataFrame:
    out = []
    for number, (penalty, use) in enumerate(variants):
        mask = None if use is None else np.array([f in set(use) for f in features])
        n, intercept, beta, centre, spread = solve(grams, len(features), penalty, mask)
        out.append(pd.DataFrame({
            "pool": pools, "day": days, "variant": number, "known_n": n, "intercept": intercept,
            "beta": list(beta), "centre": list(centre), "spread": list(spread),
        }))
    return pd.concat(out)


def _ready(rows: DataFrame, pool: Column, features: Sequence[str], target: Column, weight: Column) -> DataFrame:
    return rows.select(
        pool.alias("pool"), F.unix_date("date").alias("day"), F.unix_date("label_date").alias("label_day"),
        target.cast("double").alias("y"), weight.cast("double").alias("w"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )


def cross_product_blocks(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Packed cross products (pool, day, cell, part) of the labels of each day.

    Tasks reduce their rows to blocks before the shuffle. Blocks add up: stored
    ones and those of new rows together are the state of the learner, and a warm
    start reads them instead of the rows.

    A feature that hardly varies around a large value leaves its spread to the last bits
    of its sums. So values count in two parts: the products of the coarse ones add up
    exactly, and sums hang on no order of rows or tasks.
    """
    p = len(features)
    upper = np.triu_indices(2 * p + 2)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def release() -> pd.DataFrame:
            out = pd.DataFrame(
                {"pool": [k[0] for k in held], "day": [k[1] for k in held],
                 "coarse": [m[0] for m in held.values()], "fine": [m[1] for m in held.values()]}
            )
            held.clear()
            return out

        empty = np.zeros((2, len(upper[0])))
        for frame in batches:
            # A zero block at each issue day makes its model an equi join away.
            for key in frame[["pool", "day"]].drop_duplicates().itertuples(index=False, name=None):
                held.setdefault(key, empty)
            known = frame[frame["y"].notna() & (frame["w"] > 0) & frame["pool"].notna() & frame["label_day"].notna()]
            if len(known):
                # One matrix for the batch: a block takes its rows, in their order.
                u, (pool, names), (day, days) = _design(known, features), pd.factorize(known["pool"]), pd.factorize(known["label_day"])
                coarse = np.where(np.abs(u) < 2.0 ** 40, np.rint(u * GRID) / GRID, u)
                block = pool * len(days) + day
                order = np.argsort(block, kind="stable")
                begins = np.flatnonzero(np.diff(block[order], prepend=-1))
                for rows in np.split(order, begins[1:]):
                    key = names[pool[rows[0]]], days[day[rows[0]]]
                    held[key] = held.get(key, empty) + _products(u[rows], coarse[rows], upper)
            if len(held) >= HELD_BLOCKS:
                yield release()
        if held:
            yield release()

    blocks = rows.mapInPandas(reduce, "pool string, day int, coarse array<double>, fine array<double>")
    cells = blocks.select("pool", "day", F.posexplode(F.arrays_zip("coarse", "fine")).alias("cell", "part"))
    return cells.groupBy("pool", "day", "cell").agg((F.sum("part.coarse") + F.sum("part.fine")).alias("part"))


def add_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("pool", "day", "cell").agg(F.sum("part").alias("part"))


def accumulate(blocks: DataFrame) -> DataFrame:
    """Running sums over days; a task sees one cell of a pool for every day."""
    past = Window.partitionBy("pool", "cell").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("pool", "day", "cell", F.sum("part").over(past).alias("total"))


def pooled_models(rows: DataFrame, features: Sequence[str], penalty: float, use: Sequence[str] | None = None) -> DataFrame:
    """One model per (pool, issue day), for pools that span many entities."""
    return models_of(cross_product_blocks(rows, features), features, penalty, use)


def models_of(blocks: DataFrame, features: Sequence[str], penalty: float, use: Sequence[str] | None = None) -> DataFrame:
    """The models that follow from blocks, for any penalty and subset of features."""
    return variant_models(blocks, features, [(penalty, use)]).drop("variant")


def variant_models(blocks: DataFrame, features: Sequence[str], variants: Sequence[Variant]) -> DataFrame:
    """The models of every variant: the blocks are read and accumulated once."""
    size = 2 * len(features) + 2
    upper = np.triu_indices(size)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), SOLVED_AT_ONCE):
                part = frame.iloc[at:at + SOLVED_AT_ONCE]
                grams = np.zeros((len(part), size, size))
                packed = np.array([np.asarray(c, dtype=float) for c in part["cells"]])
                grams[:, upper[0], upper[1]] = packed
                grams[:, upper[1], upper[0]] = packed
                yield _models(part["pool"].to_numpy(), part["day"].to_numpy(), grams, features, variants)

    # The number of cells is fixed, so these lists are too.
    cells = F.sort_array(F.collect_list(F.struct("cell", "total")))
    packed = accumulate(blocks).groupBy("pool", "day").agg(cells.alias("_c"))
    return packed.select("pool", "day", F.col("_c.total").alias("cells")).mapInPandas(fit, MODEL_SCHEMA)


def entity_models(rows: DataFrame, features: Sequence[str], variants: Sequence[Variant]) -> DataFrame:
    """The same for pools within one entity, whose rows the calendar bounds.

    A pool then has at most one row per day and horizon, and is solved whole. Tasks
    take buckets of pools: a Python call for each would cost more than its solves.
    """
    p = len(features)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fit_pool(part) for _, part in frame.groupby("pool", sort=False)])

    def fit_pool(frame: pd.DataFrame) -> pd.DataFrame:
        days = np.unique(frame["day"].to_numpy())
        known = frame[frame["y"].notna() & (frame["w"] > 0)]
        slot = np.searchsorted(days, known["label_day"].to_numpy())
        u = _design(known, features)
        blocks = np.zeros((len(days), 2 * p + 2, 2 * p + 2))
        inside = slot < len(days)
        np.add.at(blocks, slot[inside], u[inside, :, None] * u[inside, None, :])
        return _models(frame["pool"].iloc[0], days, np.cumsum(blocks, axis=0), features, variants)

    return in_buckets(rows).applyInPandas(fit, MODEL_SCHEMA)


def in_buckets(rows: DataFrame):
    """Rows grouped by buckets of whole pools, some to a task whatever the number of pools."""
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy(F.pmod(F.xxhash64("pool"), F.lit(buckets)).alias("bucket"))


def linear_prediction(features: Sequence[str], bound: float = Z_CLIP) -> Column:
    """Prediction from the model columns; stays a JVM expression.

    Written over arrays, so that the plan does not grow with the features.
    """
    return _sum_of_terms(features, F.arrays_zip("centre", "spread", "beta"), F.col("intercept"), bound)


def _sum_of_terms(features: Sequence[str], model: Column, intercept: Column, bound: float = Z_CLIP) -> Column:
    values = F.array(*[F.col(f).cast("double") for f in features])
    terms = F.zip_with(
        values, model,
        lambda x, m: F.coalesce(F.when(m.beta != 0.0, clip((x - m.centre) / m.spread, bound) * m.beta), F.lit(0.0)),
    )
    return intercept + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def ready_rows(table: DataFrame, features: Sequence[str], pooling: str = "all", scaled: bool = True) -> DataFrame:
    """The learner's view of a table: pool, days, target and features."""
    return _ready(table, pool_key(pooling), features, scaled_target(scaled), F.lit(1.0))


def ridge(table: DataFrame, features: Sequence[str], pooling: str = "all", penalty: float = 1.0,
          scaled: bool = True, use: Sequence[str] | None = None, name: str = "model",
          pool: Column | None = None, weight: Column | None = None, keep_null: bool = False) -> DataFrame:
    """Add a prediction to each row from labels known at its issue date.

    The table needs date, label_date and target_delta, and `scale` where scaled.
    With fewer than two known labels, by weight, the prediction is no change, or NULL with `keep_null`.
    """
    rows = ridge_variants(table, features, [(penalty, use)], pooling, scaled, name, pool, weight, keep_null)
    return rows.drop("variant")


def ridge_variants(table: DataFrame, features: Sequence[str], variants: Sequence[Variant], pooling: str = "all",
                   scaled: bool = True, name: str = "model", pool: Column | None = None,
                   weight: Column | None = None, keep_null: bool = False) -> DataFrame:
    """`ridge` for several penalties and subsets of the features: each row once per
    variant, whose place in the list `variant` tells.

    One pass over the rows, one running sum and one join serve them all.
    """
    key = pool_key(pooling) if pool is None else pool
    ready = _ready(table, key, features, scaled_target(scaled), F.lit(1.0) if weight is None else weight)
    return with_models(table, key, _fitted(ready, features, variants, pooling), features, scaled, name, keep_null)


def _fitted(ready: DataFrame, features: Sequence[str], variants: Sequence[Variant], pooling: str) -> DataFrame:
    if pooling not in ("all", "dam"):
        return entity_models(ready, features, variants)
    # Written, so that the join with the rows knows their size: a few per day, they are
    # broadcast where that is small, and whole days of rows stay where they are.
    return materialise(variant_models(cross_product_blocks(ready, features), features, variants), "models")


def ridge_matrix(table: DataFrame, features: Sequence[str], variants: Sequence[Variant], pooling: str = "all",
                 scaled: bool = True, name: str = "models") -> DataFrame:
    """`ridge_variants` with each row once: an array of predictions in the order of `variants`."""
    fitted = _fitted(_ready(table, pool_key(pooling), features, scaled_target(scaled), F.lit(1.0)), features, variants, pooling)
    # Of a model only the terms that count, with the places of their features: fewer than the union's.
    terms = F.transform(F.arrays_zip("centre", "spread", "beta"), lambda m, i: F.struct(i.alias("at"), m.centre.alias("centre"), m.spread.alias("spread"), m.beta.alias("beta")))
    model = F.struct("variant", "known_n", "intercept", F.filter(terms, lambda m: m.beta != 0.0).alias("terms"))
    each = fitted.groupBy(F.col("pool").alias("_pool"), F.date_from_unix_date("day").alias("date")).agg(F.sort_array(F.collect_list(model)).alias("_models"))
    if pooling in ("all", "dam"):
        # A few per day, whatever the number of dams: the rows do not move to meet them.
        each = F.broadcast(materialise(each, "models"))
    # Made before the join: a lambda would make the array anew for each term.
    values = F.array(*[F.col(f).cast("double") for f in features]).alias("_values")
    joined = table.select("*", pool_key(pooling).alias("_pool"), values).join(each, ["_pool", "date"])

    def term(x: Column, t: Column) -> Column:
        # Bounded as by `clip`, which in a lambda would make the quotient three times.
        bounded = F.greatest(F.least((x - t.centre) / t.spread, F.lit(Z_CLIP)), F.lit(-Z_CLIP))
        return F.when(x.isNotNull(), bounded * t.beta).otherwise(0.0)

    def value(m: Column) -> Column:
        return F.when(m.known_n >= 2, m.intercept + F.aggregate(m.terms, F.lit(0.0), lambda total, t: total + term(F.col("_values")[t.at], t)))

    guarded = lambda raw: finite_or_zero(unscaled(raw) if scaled else raw)
    return joined.withColumn(name, F.transform(F.transform("_models", value), guarded)).drop("_pool", "_models", "_values")


def with_models(table: DataFrame, key: Column, models: DataFrame, features: Sequence[str], scaled: bool = True,
                name: str = "model", keep_null: bool = False) -> DataFrame:
    """Each row with the prediction of its pool's model of its date."""
    models = models.withColumn("_date", F.date_from_unix_date("day")).drop("day")
    joined = table.withColumn("_pool", key).join(
        models.withColumnRenamed("pool", "_pool").withColumnRenamed("_date", "date"), ["_pool", "date"], "left"
    )
    return predicted(joined, features, scaled, name, keep_null).drop("_pool")


def predicted(joined: DataFrame, features: Sequence[str], scaled: bool = True, name: str = "model", keep_null: bool = False) -> DataFrame:
    """Turn the model columns beside each row into its prediction."""
    # In steps, so that the long sum is evaluated once and not in every guard.
    raw = joined.withColumn("_raw", F.when(F.col("known_n") >= 2, linear_prediction(features)))
    scored = raw.withColumn("_value", unscaled(F.col("_raw")) if scaled else F.col("_raw"))
    value = F.col("_value")
    return scored.withColumn(name, F.when(value.isNotNull(), finite_or_zero(value)) if keep_null else finite_or_zero(value)).drop(
        "_raw", "_value", "intercept", "beta", "centre", "spread", "known_n")


def bagged_ridge(table: DataFrame, features: Sequence[str], keys: Sequence[str], pooling: str = "all",
                 penalty: float = 1.0, scaled: bool = True, replicas: int = 5, seed: int = 7,
                 name: str = "model") -> DataFrame:
    """Mean of ridges on Poisson-weighted copies of the rows.

    The weights follow from a hash of the row key, so a recomputed task draws
    the same ones.
    """
    copies = table.withColumn("_replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_replica"), *keys), F.lit(1_000_000)) / F.lit(1_000_000.0)
    # Upper ends of the Poisson(1) probabilities of 0, 1, 2, 3 and 4.
    weight = sum(((draw >= edge).cast("double") for edge in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)), F.lit(0.0))
    pool = F.concat_ws("#", pool_key(pooling), F.col("_replica").cast("string"))
    each = ridge(copies, features, pooling, penalty, scaled, name="_one", pool=pool, weight=weight)
    mean = each.groupBy(*keys).agg(F.avg("_one").alias(name))
    return table.join(mean, list(keys), "left")
