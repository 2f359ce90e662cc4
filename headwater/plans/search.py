"""The configuration sweep.

Configurations are rows. Those that differ only in shrinkage or blending share
their base predictions, and those with the same pooling, scaling and inputs
share one data pass; scores are aggregated before anything is collected. Base
predictions go to a matrix of experts, (row key, family), which every later stage
and every ensemble reads instead of fitting again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.constants import BLEND_FAMILIES, REFINE_FAMILIES, SPLIT_DATE
from headwater.functions.registry import (
    BASELINES, feature_columns, with_baselines, with_errors, with_interactions, with_stacked_baseline,
)
from headwater.operators.causal import (
    ENTITY_POOLS, POOLINGS, expert_weights, label_prefix, pool_key, scaled_losses, scaled_target, unscaled, with_causal_z,
    with_pool_sums, with_target_scale,
)
from headwater.operators.neighbours import causal_knn
from headwater.operators.reweighted import huber
from headwater.operators.ridge import bagged_ridge, ridge, ridge_matrix
from headwater.operators.search import (
    CONFIG, STAGES, config_grid, config_scores, dev_and_holdout, leading_families, not_yet_done, split_tag,
)
from headwater.operators.targets import labelled, with_label_date
from headwater.plans.backtest import entity_effect
from headwater.plans.walkforward import ESTIMATORS, month_start, walk_forward
from headwater.session import materialise

KEYS = ("dam", "date", "horizon")
# "ewa": an ensemble weighted by the past losses of a linear, a tree and a neighbour learner.
ENSEMBLE = ("ridge:1", "tree", "knn10")
ENSEMBLE_RATE = 0.1
FAMILY = ("model", "features", "pooling", "scale_target", "interactions", "stack_baseline")


def mean_families(rows: DataFrame, families: Sequence[tuple[str, bool]], name: str = "_bases") -> DataFrame:
    """Causal means of all (pooling, scaling), as an array in their order beside each row."""
    sums = {"_n": F.lit(1.0), "_y": scaled_target(False)}
    if any(scaled for _, scaled in families):
        sums["_s"] = scaled_target(True)
    poolings = list(dict.fromkeys(p for p, _ in families))
    kept, within = rows.columns, [p for p in poolings if p in ENTITY_POOLS]
    for pooling in [p for p in poolings if p not in within]:
        rows = with_pool_sums(rows, pooling, {f"{c}_{pooling}": v for c, v in sums.items()})
    rows = rows.repartition("dam") if within else rows
    for pooling in within:
        rows = with_pool_sums(rows, pooling, {f"{c}_{pooling}": v for c, v in sums.items()})

    def value(pooling: str, scaled: bool) -> Column:
        n = F.col(f"_n_{pooling}")
        mean = F.when(n >= 2, F.try_divide(F.col(f"_s_{pooling}" if scaled else f"_y_{pooling}"), n))
        return F.coalesce(unscaled(mean) if scaled else mean, F.lit(0.0))

    return rows.select(*kept, F.array(*[value(*f) for f in families]).alias(name))


def causal_mean(rows: DataFrame, pooling: str, scaled: bool, name: str = "model") -> DataFrame:
    """The mean known target of the pool: a linear model without inputs."""
    keyed = rows.withColumn("_pool", pool_key(pooling))
    y = scaled_target(scaled)
    past = label_prefix(keyed, ["_pool"], {"_n": F.lit(1.0), "_y": y})
    mean = F.when(F.col("_n") >= 2, F.try_divide("_y", "_n"))
    value = F.coalesce(unscaled(mean) if scaled else mean, F.lit(0.0))
    return keyed.join(past, ["_pool", "date"], "left").withColumn(name, value).drop("_pool", "_n", "_y")


def _inputs(features: str, pooling: str, interactions: bool, stack: bool) -> list[str]:
    """The inputs of a family: learners of several dams also see whose row it is, by the
    dam's shrunken past mean, and those of several horizons which."""
    inputs = list(feature_columns(features, interactions, stack))
    inputs += ["dam_effect"] if pooling in ("dam", "all") else []
    return [*inputs, "horizon"] if pooling in ("horizon", "all") else inputs


def _penalty(model: str) -> float:
    return float(model.split(":")[1]) if ":" in model else 1.0


def base_predictions(rows: DataFrame, model: str, features: str, pooling: str, scaled: bool,
                     interactions: bool, stack: bool) -> DataFrame:
    """Predictions of one family before shrinkage and blending.

    The rows should be read from files, as `prepared` gives them. Models: "mean", "ridge" or "ridge:<penalty>", "bagged", "huber", "knn<k>" and the
    trees of ESTIMATORS, in every pooling.
    """
    if model == "mean":
        return causal_mean(rows, pooling, scaled)
    inputs = _inputs(features, pooling, interactions, stack)
    if model.startswith("knn"):
        z = with_causal_z(rows.withColumn("_kp", pool_key(pooling)), inputs, ["_kp"], few=pooling not in ENTITY_POOLS)
        near = causal_knn(z, [f"z_{c}" for c in inputs], KEYS, pooling, int(model[3:]), scaled=scaled)
        return near.drop("_kp", *[f"z_{c}" for c in inputs])
    if model == "bagged":
        return bagged_ridge(rows, inputs, KEYS, pooling, scaled=scaled)
    if model == "huber":
        return huber(rows, inputs, pooling, scaled=scaled)
    if model in ESTIMATORS:
        return walk_forward(rows, [c for c in inputs if c != "horizon"], model, month_start(), scaled, pooling=pooling, written=True)
    if model.split(":")[0] != "ridge":
        raise ValueError(f"unknown model {model}")
    return ridge(rows, inputs, pooling, _penalty(model), scaled)


STORED = [*KEYS, "target_delta", "dev_24h_m"]  # of a row, what the matrix of experts keeps beside its predictions
SLIM = [*KEYS, "label_date", "target_delta", "dev_24h_m", *BASELINES]  # what scoring needs; the rest follows from STORED


def prepared(table: DataFrame, crossed: bool = True, families: Sequence[tuple] | None = None) -> DataFrame:
    """Labelled rows with all that any family reads, written once for all of them.

    crossed: with the products of features, which only some families read.
    families: where all that will read the rows are known, only their columns are kept.
    """
    rows = entity_effect(with_target_scale(with_label_date(labelled(table)), search=True))
    rows = with_stacked_baseline(rows)
    rows = with_baselines(with_interactions(rows) if crossed else rows)
    if families is not None:
        read = {c for model, *f in families if model != "mean" for c in _inputs(f[0], f[1], f[3], f[4])}
        rows = rows.select(*[c for c in rows.columns if c in {*SLIM, "scale", *read}])
    return materialise(rows, "sweep-rows")


def pending(spark: SparkSession, done: DataFrame | None = None, **grid) -> list[tuple]:
    """The configurations of a grid that `done` lacks, as tuples in the order of CONFIG.

    "mean" reads no inputs: one setting of the inputs stands for all. A grid is the
    product of the caller's short lists, so its rows may pass through the driver.
    """
    rows = config_grid(spark, **grid)
    still = F.col("model") == "mean"
    first = {"features": grid.get("features", ("base",))[0], "interactions": False, "stack_baseline": False}
    rows = rows.withColumns({c: F.when(still, F.lit(v)).otherwise(F.col(c)) for c, v in first.items()}).distinct()
    return sorted(tuple(r[c] for c in CONFIG) for r in (rows if done is None else not_yet_done(rows, done)).collect())


def _groups(families: Sequence[tuple]) -> list[list[tuple]]:
    """Families that share their passes over the rows: ridges of one pooling and scaling, whatever
    their penalty and inputs, and all means."""
    groups: dict[tuple, list[tuple]] = {}
    for family in families:
        model = family[0].split(":")[0]
        by = (model,) if model == "mean" else (model, *family[2:4]) if model == "ridge" else family
        groups.setdefault(by, []).append(family)
    return list(groups.values())


def _base_rows(rows: DataFrame, groups: Sequence[Sequence[tuple]]) -> DataFrame:
    """Base predictions of groups of families: each row once per group, whose place `_group` tells,
    with an array of the group's predictions."""
    parts = []
    for number, group in enumerate(groups):
        model, features, pooling, scaled, crossed, stack = group[0]
        if model == "mean":
            part = mean_families(rows.select(*STORED, "label_date", "scale"), [(f[2], f[3]) for f in group])
        elif model.split(":")[0] == "ridge":
            inputs = [_inputs(f, pooling, crossed, stack) for _, f, _, _, crossed, stack in group]
            union = list(dict.fromkeys(c for columns in inputs for c in columns))
            variants = [(_penalty(family[0]), columns) for family, columns in zip(group, inputs)]
            part = ridge_matrix(rows, union, variants, pooling, scaled, "_bases")
        else:
            base = base_predictions(rows, model, features, pooling, scaled, crossed, stack)
            part = base.withColumn("_bases", F.array("model"))
        parts.append(part.select(*STORED, "_bases", F.lit(number).alias("_group")))
    return reduce(DataFrame.unionByName, parts)


class Experts:
    """Base predictions by (row key, family), kept in the work folder and filled as asked.

    A family is fitted once, however many stages, configurations and ensembles read it. One
    that fails is noted with its error and costs no other family its place.
    """

    def __init__(self, rows: Callable[[], DataFrame]):
        self.rows, self.numbers, self.parts, self.failed = rows, {}, [], {}

    def _members(self, family: tuple) -> list[tuple]:
        return [(model, *family[1:]) for model in ENSEMBLE]

    def fill(self, families: Sequence[tuple]) -> None:
        """Fit what is missing: single learners in one go, or where that fails one by one, then ensembles."""
        wanted = list(dict.fromkeys(m for f in families for m in (self._members(f) if f[0] == "ewa" else [f])))
        wanted = [f for f in wanted if f not in self.numbers and f not in self.failed]
        try:
            self._fit(wanted)
        except Exception:  # noqa: BLE001 - some family failed: the others are fitted alone
            for family in wanted:
                try:
                    self._fit([family])
                except Exception as error:  # noqa: BLE001 - an error becomes a row
                    self.failed[family] = f"{type(error).__name__}: {error}"
        for family in dict.fromkeys(f for f in families if f[0] == "ewa" and f not in self.numbers and f not in self.failed):
            broken = [m for m in self._members(family) if m in self.failed]
            if broken:
                self.failed[family] = f"of its members {broken[0][0]} failed: {self.failed[broken[0]]}"
            else:
                self._blend(family)

    def _keep(self, fitted: Callable[[], DataFrame], groups: Sequence[Sequence[tuple]]) -> None:
        written = materialise(fitted(), "experts")
        slim = with_baselines(with_label_date(written))
        self.parts += [(group, slim.filter(F.col("_group") == number).drop("_group")) for number, group in enumerate(groups)]
        for group in groups:
            self.numbers |= {f: len(self.numbers) + i for i, f in enumerate(group)}

    def _fit(self, families: Sequence[tuple]) -> None:
        if families:
            groups = _groups(families)
            self._keep(lambda: _base_rows(self.rows(), groups), groups)

    def _blend(self, family: tuple) -> None:
        """The members' predictions side by side, weighted by their past losses in the pool."""
        members, pooling = self._members(family), family[2]
        names = [f"_e{i}" for i in range(len(members))]

        def fitted() -> DataFrame:
            many = self.read(members)
            each = [F.max(F.when(F.col("_family") == self.numbers[m], F.col("_base"))).alias(n) for m, n in zip(members, names)]
            # A row's other columns are the same for all members; what follows from them does not move.
            wide = many.groupBy(*STORED).agg(*each)
            if pooling in ENTITY_POOLS:
                wide = wide.repartition("dam")
            mixed = with_pool_sums(with_label_date(wide), pooling, scaled_losses({n: F.col(n) for n in names}), written=False)
            weights = expert_weights(names, ENSEMBLE_RATE)
            value = sum((weights[n] * F.col(n) for n in names), F.lit(0.0))
            return mixed.select(*STORED, F.array(value).alias("_bases"), F.lit(0).alias("_group"))

        self._keep(fitted, [[family]])

    def wide(self, families: Sequence[tuple]) -> list[tuple[dict[tuple, int], DataFrame]]:
        """Rows of each group that holds some of the families, and the places of these in its arrays."""
        wanted = set(families)
        held = [({f: i for i, f in enumerate(group) if f in wanted}, part) for group, part in self.parts]
        return [(bases, part) for bases, part in held if bases]

    def read(self, families: Sequence[tuple]) -> DataFrame:
        """The rows of families that were filled, one for each of them."""
        parts = []
        for bases, part in self.wide(families):
            each = [F.struct(F.lit(self.numbers[f]).alias("_family"), F.col("_bases")[i].alias("_base"), pool_key(f[2]).alias("_pool")) for f, i in bases.items()]
            parts.append(part.select(*SLIM, F.explode(F.array(*each)).alias("_o")).select(*SLIM, "_o.*"))
        return reduce(DataFrame.unionByName, parts)


RUNS_AT_ONCE = 16  # runs whose past losses are summed together, side by side


def _shrunk(part: DataFrame, runs: Sequence[tuple[int, str, int, float]], blended: bool) -> DataFrame:
    """A row for each run (number, pooling, place of its base, shrink) over a row's bases, where blended with its past losses.

    Rows meet the past losses of their runs before they become a row for each run: what moves is a row, not its runs.
    """
    names = ["_shrunk", *BASELINES]

    def long(rows: DataFrame, some: Sequence[tuple[int, str, Column]], *more: Callable[[int], Column]) -> DataFrame:
        each = [F.struct(F.lit(run).alias("_run"), value.alias("_shrunk"), *[c(run) for c in more]) for run, _, value in some]
        return rows.select(*SLIM, F.explode(F.array(*each)).alias("_o")).select(*SLIM, "_o.*")

    def values(some: Sequence[tuple[int, str, int, float]], base: Callable[[int], Column]) -> list[tuple[int, str, Column]]:
        return [(run, pooling, base(i) * F.lit(shrink)) for run, pooling, i, shrink in some]

    in_place = lambda i: F.col("_bases")[i]
    if not blended:
        return long(part, values(runs, in_place))
    parts, within = [], [r for r in runs if r[1] in ENTITY_POOLS]
    across = [r for r in runs if r[1] not in ENTITY_POOLS]
    for some in [group[at:at + RUNS_AT_ONCE] for group in (across, within) for at in range(0, len(group), RUNS_AT_ONCE)]:
        # Only what these runs read goes on, and of pools within dams moves, once for all of them.
        read = [in_place(i).alias(f"_base_{i}") for i in dict.fromkeys(r[2] for r in some)]
        rows = part.select(*[c for c in SLIM if c not in BASELINES], *read)
        rows = with_baselines(rows.repartition("dam") if some[0][1] in ENTITY_POOLS else rows)
        shrunk = values(some, lambda i: F.col(f"_base_{i}"))
        for pooling in dict.fromkeys(r[1] for r in some):
            sums = {}
            for run, value in [(run, value) for run, p, value in shrunk if p == pooling]:
                losses = scaled_losses({"_shrunk": value, **{b: F.col(b) for b in BASELINES}})
                sums |= {f"{n}_{run}": loss for n, loss in losses.items()}
            rows = with_pool_sums(rows, pooling, sums)
        past = [lambda run, n=n: F.col(f"_loss_{n}_{run}").alias(f"_loss_{n}") for n in names]
        parts.append(long(rows, shrunk, *past))
    return reduce(DataFrame.unionByName, parts)


def _errors(table: DataFrame, models: Sequence[str], split: str | None, done: DataFrame | None,
            experts: Experts | None, grid: dict, strict: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """Errors under the number `_config` of their configuration, and the configurations.

    Numbers, not names, go with the rows through joins and aggregates. Configurations of
    families that fail are left out, unless `strict`; None if none is left.
    """
    spark = table.sparkSession
    todo = pending(spark, done, models=models, **{"poolings": ("all",), "scales": (True,), **grid})
    if not todo:
        raise ValueError("no configuration to run")
    family_of = lambda c: tuple(c[CONFIG.index(f)] for f in FAMILY)
    run_of = lambda c: (family_of(c), c[CONFIG.index("shrink")])
    families = list(dict.fromkeys(map(family_of, todo)))
    if experts is None:
        crossed = any(f[FAMILY.index("interactions")] for f in families)
        experts = Experts(functools.cache(lambda: prepared(table, crossed, families)))
    experts.fill(families)
    broken = [experts.failed[f] for f in families if f in experts.failed]
    if broken and strict:
        raise ValueError(broken[0])
    todo = [c for c in todo if family_of(c) not in experts.failed]
    if not todo:
        return None
    runs = {v: i for i, v in enumerate(dict.fromkeys(map(run_of, todo)))}
    configs = spark.createDataFrame([(i, runs[run_of(c)], *c) for i, c in enumerate(todo)], "_config int, _run int, " + CONFIG_SCHEMA)
    # Past losses do not depend on the rate: one pass serves every blend.
    blended = any(c[CONFIG.index("blend")] > 0.0 for c in todo)
    parts = []
    for bases, part in experts.wide(list(dict.fromkeys(map(family_of, todo)))):
        mine = [(i, f[FAMILY.index("pooling")], bases[f], shrink) for (f, shrink), i in runs.items() if f in bases]
        parts.append(_shrunk(part, mine, blended))
    shrunk, value = reduce(DataFrame.unionByName, parts), F.col("_shrunk")
    if blended:
        experts_ = ["_shrunk", *BASELINES]
        weights = expert_weights(experts_, F.col("blend"))
        mixed = sum((weights[e] * F.col(e) for e in experts_), F.lit(0.0))
        value = F.when(F.col("blend") > 0.0, mixed).otherwise(value)
    # The configurations are as few as the grid's lists make them.
    final = shrunk.join(F.broadcast(configs.select("_run", "_config", "blend")), "_run").withColumn("_final", value)
    errors = with_errors(final.withColumn("actual", F.col("target_delta")), "_final")
    keep = ["_config", "split", *KEYS, "abs_err_model", *[f"abs_err_{b}" for b in BASELINES]]
    return split_tag(errors, split or SPLIT_DATE).select(*keep), configs.select("_config", *CONFIG)


def sweep_errors(table: DataFrame, models: Sequence[str], split: str | None = None, done: DataFrame | None = None,
                 experts: Experts | None = None, **grid) -> DataFrame:
    """Errors of every configuration of a grid that `done` lacks, one row per labelled forecast.

    `experts` holds the base predictions where several sweeps share them.
    """
    errors, configs = _errors(table, models, split, done, experts, grid)
    return errors.join(F.broadcast(configs), "_config").select(*CONFIG, *[c for c in errors.columns if c != "_config"])


def _scores(errors: DataFrame, configs: DataFrame) -> DataFrame:
    wide = dev_and_holdout(config_scores(errors, ["_config"])[1], ["_config"])
    return configs.join(wide, "_config").drop("_config")


def sweep(table: DataFrame, models: Sequence[str], split: str | None = None, done: DataFrame | None = None,
          experts: Experts | None = None, **grid) -> DataFrame:
    """Dev and holdout scores of every configuration, one row each."""
    return _scores(*_errors(table, models, split, done, experts, grid))


CONFIG_SCHEMA = ("model string, features string, pooling string, scale_target boolean, interactions boolean, "
                 "shrink double, blend double, stack_baseline boolean")
FAILURES = f"stage string, {CONFIG_SCHEMA}, error string"


def staged_search(table: DataFrame, models: Sequence[str], split: str | None = None,
                  poolings: Sequence[str] = POOLINGS, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every model over a small grid, the leading families over the full one, and
    the best of them hedged against the baselines or fed with their answer.

    Returns the scored configurations and one row per configuration that could not run,
    with its error; the others of its model and stage go on. What `done`, the scores of a
    former search, or an earlier stage holds is not run again. Only names and failures pass through the driver.
    """
    spark = table.sparkSession
    experts = Experts(functools.cache(lambda: prepared(table, any(m != "mean" for m in models))))
    results, failed = done, []

    def run(stage: str, names: Sequence[str]) -> None:
        nonlocal results
        for model in names:
            grid = dict(models=(model,), poolings=poolings, scales=(False, True), **STAGES[stage])
            todo = pending(spark, results, **grid)
            if not todo:
                continue
            try:
                scored = _errors(table, split=split, done=results, experts=experts, strict=False,
                                 models=(model,), grid={k: v for k, v in grid.items() if k != "models"})
                found = None if scored is None else materialise(_scores(*scored), f"search-{stage}")
            except Exception as error:  # noqa: BLE001 - an error becomes rows, the other models go on
                failed.extend((stage, *c, f"{type(error).__name__}: {error}") for c in todo)
                continue
            for config in todo:
                family = tuple(config[CONFIG.index(f)] for f in FAMILY)
                if family in experts.failed:
                    failed.append((stage, *config, experts.failed[family]))
            if found is not None:
                results = found if results is None else results.unionByName(found)

    run("coarse", models)
    if results is None:
        raise ValueError("no configuration ran")
    leading = [r.model for r in leading_families(results, REFINE_FAMILIES).collect()]
    run("fine", leading)
    run("blend", leading[:BLEND_FAMILIES])
    run("stack", leading[:BLEND_FAMILIES])
    return results, spark.createDataFrame(failed, FAILURES)
