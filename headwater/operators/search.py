"""The configuration search: grids, scores and dev-only ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.constants import BLENDS, FEATURE_SETS, RATIO_CAP, SHRINKS, SPLIT_DATE
from headwater.functions.numeric import published
from headwater.functions.registry import BASELINES
from headwater.operators.causal import POOLINGS
from headwater.operators.keys import missing_from

CONFIG = (
    "model", "features", "pooling", "scale_target", "interactions", "shrink", "blend", "stack_baseline",
)


def config_grid(spark: SparkSession, models: Sequence[str], features: Sequence[str] = ("base",),
                poolings: Sequence[str] = POOLINGS, scales: Sequence[bool] = (False, True),
                interactions: Sequence[bool] = (False,), shrinks: Sequence[float] = (1.0,),
                blends: Sequence[float] = (0.0,), stacks: Sequence[bool] = (False,)) -> DataFrame:
    """All combinations, one row each; chained explodes of literal lists."""
    grid = spark.range(1).select()
    options = (models, features, poolings, scales, interactions, shrinks, blends, stacks)
    for name, values in zip(CONFIG, options):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


# The stages of the search: every model over a small grid, the leading families over
# everything but blends, and the best of them hedged against the baselines or fed with them.
STAGES = {
    "coarse": dict(features=("base", "lean"), shrinks=(1.0, 0.5)),
    "fine": dict(features=tuple(FEATURE_SETS), interactions=(False, True), shrinks=SHRINKS),
    "blend": dict(features=("base", "lean"), interactions=(False, True), blends=BLENDS, stacks=(False, True)),
    "stack": dict(features=("base", "lean"), shrinks=(1.0, 0.6), stacks=(True,)),
}


def coarse_grid(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    return config_grid(spark, models, **STAGES["coarse"])


def fine_grid(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    return config_grid(spark, models, **STAGES["fine"])


def blend_grid(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    return config_grid(spark, models, **STAGES["blend"]).unionByName(config_grid(spark, models, **STAGES["stack"]))


def not_yet_done(grid: DataFrame, results: DataFrame) -> DataFrame:
    return missing_from(grid, results.select(*CONFIG).distinct(), CONFIG, null_safe=True)


def split_tag(df: DataFrame, split: str = SPLIT_DATE) -> DataFrame:
    held = F.col("date") >= F.lit(split).cast("date")
    return df.withColumn("split", F.when(held, "holdout").otherwise("dev"))


def config_scores(errors: DataFrame, config: Sequence[str] = CONFIG, cap: float = RATIO_CAP) -> tuple[DataFrame, DataFrame]:
    """Scores per (configuration, split, horizon) and per (configuration, split).

    The first aggregate sees all errors and reduces them before its shuffle; the
    second only sees one row per horizon. The ratio to the best baseline is
    capped, and is the cap where the error is not finite. A win must exceed the
    rounding noise of sums whose order a cluster does not fix.
    """
    sums = [F.sum("abs_err_model").alias("_sum")]
    sums += [F.avg(f"abs_err_{n}").alias(f"_mae_{n}") for n in BASELINES]
    per = errors.groupBy(*config, "split", "horizon").agg(F.count(F.lit(1)).alias("n"), *sums)
    per = per.withColumn("mae", F.col("_sum") / F.col("n"))
    best = F.least(*[F.col(f"_mae_{n}") for n in BASELINES])
    finite = F.col("mae").isNotNull() & ~F.isnan("mae") & (F.abs("mae") != F.lit(float("inf")))
    ratio = F.when(finite, F.least(F.col("mae") / F.greatest(best, F.lit(1e-6)), F.lit(cap))).otherwise(cap)
    per = per.withColumns({"best_baseline": best, "ratio": ratio, "wins": finite & (F.round("mae", 9) < F.round(best, 9))})
    overall = per.groupBy(*config, "split").agg(
        (F.sum("_sum") / F.sum("n")).alias("mae"),
        F.count_if("wins").alias("n_wins"),
        F.count(F.lit(1)).alias("n_horizons"),
        F.avg("ratio").alias("mean_ratio"),
        F.max("ratio").alias("worst_ratio"),
    )
    overall = overall.withColumns(
        {
            "mae": F.when(~F.isnan("mae") & (F.abs("mae") != F.lit(float("inf"))), published("mae")),
            "mean_ratio": published("mean_ratio"),
            "worst_ratio": published("worst_ratio"),
        }
    )
    per = per.select(
        *config, "split", "horizon", "n", published("mae").alias("mae"),
        published("best_baseline").alias("best_baseline"), published("ratio").alias("ratio"), "wins",
    )
    return per, overall


def dev_and_holdout(overall: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """One row per configuration: dev scores, holdout scores and the slippage."""
    columns = []
    for split in ("dev", "holdout"):
        for c in ("mae", "n_wins", "n_horizons", "mean_ratio", "worst_ratio"):
            columns.append(F.max(F.when(F.col("split") == split, F.col(c))).alias(f"{split}_{c}"))
    wide = overall.groupBy(*config).agg(*columns).filter(F.col("dev_mean_ratio").isNotNull())
    slippage = F.round(F.col("holdout_mean_ratio") - F.col("dev_mean_ratio"), 4)
    return wide.withColumn("slippage", slippage)


def top_configs(wide: DataFrame, k: int = 20, config: Sequence[str] = CONFIG) -> DataFrame:
    """Lowest mean ratio on dev, then most wins; the holdout is never sorted on."""
    return wide.orderBy("dev_mean_ratio", F.col("dev_n_wins").desc(), *config).limit(k)


def incumbent(wide: DataFrame, **config) -> DataFrame:
    """The row of one named configuration."""
    for name, value in config.items():
        wide = wide.filter(F.col(name).eqNullSafe(F.lit(value)))
    return wide


def holdout_reads(chosen: DataFrame, run: str, rule: str, config: Sequence[str] = CONFIG) -> DataFrame:
    """Log rows for holdout scores about to be looked at. Each look costs some of
    the holdout's worth, so all of them are kept on record."""
    return chosen.select(
        F.lit(run).alias("run"), F.lit(rule).alias("rule"), *config, "dev_mean_ratio", "holdout_mean_ratio", "slippage"
    )


def most_wins(wide: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """The rival rule: most horizons beaten on dev, then the lower ratio."""
    return wide.orderBy(F.col("dev_n_wins").desc(), "dev_mean_ratio", *config).limit(1)


def leading_families(wide: DataFrame, k: int = 6, config: Sequence[str] = CONFIG) -> DataFrame:
    """The first k distinct models in rank order."""
    best = wide.groupBy("model").agg(
        F.min_by(F.struct("dev_mean_ratio", *[c for c in config if c != "model"]),
                 F.struct("dev_mean_ratio", *[c for c in config if c != "model"])).alias("_best")
    )
    return (
        best.orderBy("_best", "model").limit(k)
        .select("model", F.col("_best.dev_mean_ratio").alias("dev_mean_ratio"))
    )


def ranked(wide: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """Rank of every configuration; there are as many rows as configurations."""
    order = Window.partitionBy(F.lit(1)).orderBy("dev_mean_ratio", F.col("dev_n_wins").desc(), *config)
    return wide.withColumn("rank", F.row_number().over(order).cast("long"))
