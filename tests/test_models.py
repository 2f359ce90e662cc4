"""Fitted operators against plain loops."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headwater.operators import causal, neighbours, ridge
from headwater.operators.search import holdout_reads, incumbent, top_configs
from headwater.plans import backtest, search, walkforward
from headwater.plans.roles import events_table

DAY = dt.date(2026, 1, 1)
FEATURES = ["a", "b", "horizon"]
SCHEMA = "dam string, date date, horizon int, label_date date, target_delta double, a double, b double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for dam in ("x", "y", "z"):
        for n in range(40):
            if rng.random() < 0.2:
                continue
            a, b = rng.normal(50, 9), None if rng.random() < 0.3 else rng.normal(0, 2)
            for h in (1, 3, 7):
                target = 0.4 * (a - 50) + 0.8 * h + 0.5 * (b or 0) + rng.normal(0, 1)
                known = rng.random() < 0.85
                out.append((dam, DAY + dt.timedelta(n), h, DAY + dt.timedelta(n + h), float(target) if known else None, float(a), None if b is None else float(b)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_ridge(rows, pool, penalty):
    """Standardised ridge by rows: fit on labels known at each issue date."""
    value = lambda r: np.array([r[5], np.nan if r[6] is None else r[6], r[2]], float)
    out = {}
    for r in rows:
        past = [q for q in rows if pool(q) == pool(r) and q[4] is not None and q[3] <= r[1]]
        if len(past) < 2:
            out[r[:3]] = 0.0
            continue
        x, y = np.array([value(q) for q in past]), np.array([q[4] for q in past])
        with np.errstate(invalid="ignore"):
            seen = ~np.isnan(x)
            n = np.maximum(seen.sum(0), 1)
            mu = np.where(seen, x, 0).sum(0) / n
            sd = np.sqrt((np.where(seen, x - mu, 0) ** 2).sum(0) / n)
        ok = sd > np.maximum(1e-6, 1e-6 * np.abs(mu))
        sd = np.where(ok, sd, 1.0)
        z = np.where(seen & ok, (x - mu) / sd, 0.0)
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ y)
        v = value(r)
        mine = np.where(np.isnan(v) | ~ok, 0.0, np.clip((v - mu) / sd, -5, 5))
        out[r[:3]] = float(y.mean() + mine @ beta)
    return out


@pytest.mark.parametrize("pooling, pool", [
    ("all", lambda r: 0), ("dam", lambda r: r[2]), ("horizon", lambda r: r[0]), ("none", lambda r: (r[0], r[2]))])
def test_ridge_is_label_gated(table, rows, pooling, pool):
    got = {(r.dam, r.date, r.horizon): r.model for r in ridge.ridge(table, FEATURES, pooling, 2.0, scaled=False).collect()}
    want = plain_ridge(rows, pool, 2.0)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-7), key


def test_subset_of_features_from_the_same_sums(table):
    few = ridge.ridge(table, ["a", "horizon"], "all", 2.0, scaled=False)
    some = ridge.ridge(table, FEATURES, "all", 2.0, scaled=False, use=["a", "horizon"])
    a = {(r.dam, r.date, r.horizon): r.model for r in few.collect()}
    b = {(r.dam, r.date, r.horizon): r.model for r in some.collect()}
    assert all(b[k] == pytest.approx(v, abs=1e-9) for k, v in a.items())


def test_warm_start_from_stored_blocks(table):
    ready = ridge.ready_rows(table, FEATURES, scaled=False)
    cut = ready.agg(F.percentile_approx("label_day", 0.5)).first()[0]
    both = ridge.add_blocks(
        ridge.cross_product_blocks(ready.filter(F.col("label_day") <= cut), FEATURES).unionByName(
            ridge.cross_product_blocks(ready.filter(F.col("label_day") > cut), FEATURES)))
    a = {(r.pool, r.day): r for r in ridge.pooled_models(ready, FEATURES, 1.0).collect()}
    b = {(r.pool, r.day): r for r in ridge.models_of(both, FEATURES, 1.0).collect()}
    assert a.keys() == b.keys()
    for key in a:
        np.testing.assert_allclose(a[key].beta, b[key].beta, atol=1e-9)


def test_blocks_hang_on_no_order_of_rows(spark):
    drawn = np.random.default_rng(5)
    rows = [("x", DAY, 1, DAY + dt.timedelta(1 + n % 2), float(drawn.normal(0, 9)), 1.0 - float(drawn.random()) * 1e-3, float(drawn.normal(60, 30)))
            for n in range(400)]
    seen = set()
    for parts in (1, 2, 7):
        for some in (rows, rows[::-1]):
            ready = ridge.ready_rows(spark.createDataFrame(some, SCHEMA).repartition(parts), FEATURES, scaled=False)
            seen.add(tuple(sorted((r.day, r.cell, r.part) for r in ridge.cross_product_blocks(ready, FEATURES).collect())))
    assert len(seen) == 1


def test_values_beyond_the_grid_still_count(spark):
    rows = [("x", DAY, 1, DAY + dt.timedelta(1), 2.0, a, 1e-9) for a in (3e200, 1e13, 0.1)]
    ready = ridge.ready_rows(spark.createDataFrame(rows[1:], SCHEMA), FEATURES, scaled=False)
    got = {r.cell: r.part for r in ridge.cross_product_blocks(ready, FEATURES).collect() if r.part}
    assert got[0] == pytest.approx(1e26 + 0.01, rel=1e-15) and got[1] == pytest.approx(1e-9 * (1e13 + 0.1), rel=1e-15)
    ready = ridge.ready_rows(spark.createDataFrame(rows, SCHEMA), FEATURES, scaled=False)
    assert max(r.part for r in ridge.cross_product_blocks(ready, FEATURES).collect()) == float("inf")


def test_horizon_reaches_a_pooled_model_and_cold_start_is_zero(spark):
    rows = []
    for n in range(30):
        for h, delta in ((1, 0.1), (7, 2.0)):
            date = DAY + dt.timedelta(n)
            rows.append(("x", date, h, date + dt.timedelta(h), delta, 10.0 + n, None))
    got = ridge.ridge(spark.createDataFrame(rows, SCHEMA), FEATURES, "all", 0.1, scaled=False)
    by_day = {(r.date, r.horizon): r.model for r in got.collect()}
    assert by_day[(DAY, 1)] == 0.0 and by_day[(DAY, 7)] == 0.0
    last = DAY + dt.timedelta(29)
    assert by_day[(last, 7)] > by_day[(last, 1)] + 1.0


def test_later_labels_do_not_change_earlier_predictions(spark, folder):
    table = events_table(spark, folder)
    cut = F.lit("2024-01-16").cast("date")
    moved = table.withColumn("target_delta", F.when(F.date_add("date", F.col("horizon")) > cut, F.col("target_delta") + 40).otherwise(F.col("target_delta")))
    early = lambda t: {(r.dam, r.date, r.horizon): r.model for r in backtest.predictions(t).filter(F.col("date") <= cut).select("dam", "date", "horizon", "model").collect()}
    a, b = early(table), early(moved)
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-9) for k, v in a.items())
    assert any(v != 0 for v in a.values())


def test_target_scale_is_causal(table, rows):
    got = {(r.dam, r.date): r for r in causal.target_scale(table).collect()}
    for dam, date in {(r[0], r[1]) for r in rows}:
        past = [q[4] for q in rows if q[0] == dam and q[4] is not None and q[3] <= date]
        row = got[(dam, date)]
        assert row.label_n == len(past)
        if len(past) >= 2:
            assert row.scale == pytest.approx(np.std(past))
        else:
            assert row.scale is None


def test_blend_equals_the_sequential_update(spark):
    """One horizon of one day, so that labels arrive in row order."""
    rng = np.random.default_rng(5)
    rows = [("x", DAY + dt.timedelta(n), 1, DAY + dt.timedelta(n + 1), *map(float, rng.normal(0, 1, 4))) for n in range(50)]
    df = spark.createDataFrame(rows, "dam string, date date, horizon int, label_date date, target_delta double, e1 double, e2 double, e3 double")
    got = {r.date: r.blended for r in causal.expert_blend(df, ["e1", "e2", "e3"], 0.6, ["horizon"]).collect()}
    w = np.ones(3) / 3
    for r in rows:
        e = np.array(r[5:])
        assert got[r[1]] == pytest.approx(w @ e, abs=1e-9)
        loss = np.abs(e - r[4])
        w = w * np.exp(-0.6 * loss / max(loss.max(), 1e-6))
        w /= w.sum()


@pytest.mark.parametrize("pooling, memory, block_days", [("dam", None, 30), ("all", None, 30), ("dam", 1000, 30), ("dam", 12, 5), ("dam", 12, 30), ("horizon", None, 30), ("none", None, 30)])
def test_neighbours_against_brute_force(table, rows, pooling, memory, block_days):
    got = {(r.dam, r.date, r.horizon): r.model for r in neighbours.causal_knn(
        table, ["a", "b"], ["dam", "date", "horizon"], pooling, 3, memory, block_days, scaled=False).collect()}
    pool = {"all": lambda q: 0, "dam": lambda q: q[2], "horizon": lambda q: q[0], "none": lambda q: (q[0], q[2])}[pooling]
    order_of = lambda q: hashlib.md5("|".join(map(str, q[:3])).encode()).hexdigest()
    point = lambda r: np.array([r[5], r[6] or 0.0])
    for r in rows:
        past = sorted((q for q in rows if pool(q) == pool(r) and q[4] is not None and q[3] <= r[1]), key=lambda q: (q[3], order_of(q)))
        past = past[-memory:] if memory else past
        if not past:
            assert got[r[:3]] == 0.0
            continue
        order = sorted(range(len(past)), key=lambda i: (round(((point(past[i]) - point(r)) ** 2).sum(), 9), i))
        assert got[r[:3]] == pytest.approx(np.mean([past[i][4] for i in order[:3]])), r


@pytest.mark.parametrize("pooling", ["all", "horizon"])
def test_variants_equal_ridges_of_their_own(table, pooling):
    rows = causal.with_target_scale(table)
    variants = [(1.0, None), (50.0, FEATURES[:1])]
    got = {(r.variant, r.dam, r.date, r.horizon): r.model for r in ridge.ridge_variants(rows, FEATURES, variants, pooling).collect()}
    for number, (penalty, use) in enumerate(variants):
        alone = ridge.ridge(rows, use or FEATURES, pooling, penalty).collect()
        assert alone and all(got[number, r.dam, r.date, r.horizon] == pytest.approx(r.model, abs=1e-9) for r in alone)
    assert len(got) == 2 * len(alone)


def test_finished_configurations_are_not_pending(spark):
    grid = dict(models=("mean", "ridge"), features=("base", "lean"), poolings=("all",), scales=(True,), shrinks=(1.0, 0.5))
    everything = search.pending(spark, **grid)
    assert len(everything) == 2 + 4  # the mean reads no features
    done = spark.createDataFrame(everything[:4], search.CONFIG_SCHEMA)
    assert search.pending(spark, done, **grid) == everything[4:]
    assert search.pending(spark, spark.createDataFrame(everything, search.CONFIG_SCHEMA), **grid) == []


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_over_many_cells_are_exact(spark, monkeypatch, hot):
    """Cells of few labels, blocks and groups of few rows, a third of all rows at one point."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        day = DAY + dt.timedelta(int(rng.integers(0, 30)))
        point = (0.0, 0.0) if hot and i % 3 == 0 else map(float, rng.normal(0, 1, 2))
        rows.append((f"d{i}", day, 1, day + dt.timedelta(1), float(rng.normal()), *point))
    for name, value in (("CELL_LABELS", 25), ("BLOCK_LABELS", 10), ("QUERIES_PER_TASK", 15)):
        monkeypatch.setattr(neighbours, name, value)
    got = {r.dam: r.model for r in neighbours.causal_knn(
        spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], ["dam", "date", "horizon"], "dam", 4, scaled=False).collect()}
    order_of = lambda q: hashlib.md5("|".join(map(str, q[:3])).encode()).hexdigest()
    for r in rows:
        past = sorted((q for q in rows if q[3] <= r[1]), key=lambda q: (q[3], order_of(q)))
        order = sorted(range(len(past)), key=lambda i: (round(((np.array(past[i][5:]) - r[5:]) ** 2).sum(), 9), i))
        assert got[r[0]] == pytest.approx(np.mean([past[i][4] for i in order[:4]]) if past else 0.0), r


def test_bagging_is_repeatable(table):
    keys = ["dam", "date", "horizon"]
    rows = causal.with_target_scale(table)
    one = {(r.dam, r.date, r.horizon): r.model for r in ridge.bagged_ridge(rows, FEATURES, keys).collect()}
    two = {(r.dam, r.date, r.horizon): r.model for r in ridge.bagged_ridge(rows.repartition(5), FEATURES, keys).collect()}
    assert len(one) == rows.count() and all(two[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())


@pytest.mark.parametrize("estimator", ["forest10", "tree", "boosted"])
def test_walk_forward_uses_earlier_blocks_only(spark, table, estimator):
    rows = causal.with_target_scale(table)
    cut = F.lit("2026-01-19").cast("date")
    moved = rows.withColumn("target_delta", F.when(F.col("label_date") >= cut, F.col("target_delta") * 3 + 9).otherwise(F.col("target_delta")))
    # The scale is kept, so only the labels differ.
    run = lambda t: {(r.dam, r.date, r.horizon): r.model for r in walkforward.walk_forward(t, ["a", "b"], estimator, walkforward.week_start()).collect()}
    a, b = run(rows), run(moved)
    early = [k for k in a if k[1] < dt.date(2026, 1, 26) and k[1] >= dt.date(2026, 1, 12)]
    assert len(a) == rows.count() and early
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in early)
    assert any(not math.isclose(a[k], 0.0) for k in early)


def test_sweep_covers_the_grid(spark, folder):
    wide = search.sweep(events_table(spark, folder), split="2024-01-21", models=("mean", "ridge", "knn5", "bagged", "huber"), features=("tiny",),
                        poolings=("all",), scales=(True,), shrinks=(1.0, 0.5), blends=(0.0, 0.6))
    got = wide.collect()
    assert len(got) == 5 * 2 * 2
    assert all(r.dev_mean_ratio > 0 and r.holdout_mean_ratio > 0 and r.dev_n_horizons == 7 for r in got)


def test_trees_and_neighbours_in_every_pooling(spark, folder):
    got = search.sweep(events_table(spark, folder), split="2024-01-21", models=("forest10", "knn5"), features=("tiny",),
                       poolings=causal.POOLINGS, scales=(True,)).collect()
    assert {(r.model, r.pooling) for r in got} == {(m, p) for m in ("forest10", "knn5") for p in causal.POOLINGS}
    assert all(r.dev_mean_ratio > 0 and r.dev_n_horizons == 7 for r in got)


def test_ensemble_reads_the_experts_of_the_stage(spark, folder, monkeypatch):
    """ewa fits nothing that was fitted, and equals the sequential blend of its members."""
    table = events_table(spark, folder)
    experts = search.Experts(lambda: search.prepared(table, False))
    family = ("ewa", "tiny", "dam", True, False, False)
    members = [(m, *family[1:]) for m in search.ENSEMBLE]
    experts.fill(members)
    fitted = []
    monkeypatch.setattr(search, "_base_rows", lambda *a: fitted.append(a))
    experts.fill([family])
    assert not fitted and family in experts.numbers
    get = lambda f: {(r.dam, r.date, r.horizon): r for r in experts.read([f]).collect()}
    blended, each = get(family), [get(m) for m in members]
    assert blended.keys() == each[0].keys()
    for key in sorted(blended)[::37]:
        now, losses = blended[key], np.zeros(3)
        for k, r in each[0].items():
            if r._pool == now._pool and r.label_date <= now.date:
                miss = np.array([abs(e[k]._base - r.target_delta) for e in each])
                losses += miss / max(miss.max(), 1e-6)
        w = np.exp(-search.ENSEMBLE_RATE * (losses - losses.min()))
        assert now._base == pytest.approx(w @ [e[key]._base for e in each] / w.sum(), abs=1e-9)


def test_a_failing_configuration_costs_no_other(spark, folder, monkeypatch):
    plain = search.base_predictions

    def fragile(rows, model, features, pooling, *rest):
        if model == "bagged" and features == "lean":
            raise RuntimeError("no bags today")
        return plain(rows, model, features, pooling, *rest)

    monkeypatch.setattr(search, "base_predictions", fragile)
    monkeypatch.setattr(search, "STAGES", {k: dict(features=("tiny", "lean")) for k in search.STAGES})
    results, failed = search.staged_search(events_table(spark, folder), ["mean", "bagged"], "2024-01-21", poolings=("all",))
    bad = failed.collect()
    assert {(r.model, r.features, r.stage) for r in bad} == {("bagged", "lean", s) for s in search.STAGES} and "no bags" in bad[0].error
    assert {r.features for r in results.filter("model = 'bagged'").collect()} == {"tiny"}


def test_staged_search_survives_failures(spark, folder):
    results, failed = search.staged_search(events_table(spark, folder), ["mean", "nosuch"], "2024-01-21", poolings=("all",))
    bad = failed.collect()
    assert {(r.model, r.stage) for r in bad} == {("nosuch", "coarse")} and "unknown model" in bad[0].error
    shrinks = {r.shrink for r in results.filter("blend = 0 and not stack_baseline").select("shrink").distinct().collect()}
    assert {1.0, 0.8, 0.6, 0.4, 0.2, 0.5} == shrinks
    assert {r.blend for r in results.select("blend").distinct().collect()} == {0.0, 0.3, 0.6, 1.0, 2.0}
    assert incumbent(results, model="mean", shrink=1.0, blend=0.0, scale_target=True).count() >= 1
    assert holdout_reads(top_configs(results, 1), "r1", "ratio").first().rule == "ratio"


def _odd_rows(spark):
    """Rows of two dams and of none, a row twice, one without a date and unlabelled ones."""
    import datetime as dt
    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(dam, day(n), h, float((7 * n + 3 * h) % 11) if (n + h) % 4 else None, 2.0) for dam in ("1", "2", None) for n in range(9) for h in (1, 3)]
    rows += [rows[2], ("1", None, 1, 4.0, 2.0)]
    table = spark.createDataFrame(rows, "dam string, date date, horizon int, target_delta double, scale double")
    return table.withColumn("label_date", F.date_add("date", F.col("horizon")))


@pytest.mark.parametrize("pooling", causal.POOLINGS)
def test_sums_beside_the_rows_equal_those_of_the_prefix(spark, pooling):
    rows = _odd_rows(spark)
    sums = {"n": F.lit(1.0), "y": F.col("target_delta")}
    keyed = rows.withColumn("_pool", causal.pool_key(pooling))
    joined = keyed.join(causal.label_prefix(keyed, ["_pool"], sums), ["_pool", "date"], "left")
    shown = lambda t: sorted(map(str, t.select("dam", "date", "horizon", "target_delta", "n", "y").collect()))
    assert shown(causal.with_pool_sums(rows.repartition("dam"), pooling, sums)) == shown(joined)


def test_sweep_moves_rows_once(spark, folder):
    """However many families and runs there are, rows are not shuffled for each of them, nor joined by a shuffle."""
    errors = search.sweep_errors(events_table(spark, folder), ["mean"], "2024-01-21", poolings=causal.POOLINGS, scales=(False, True),
                                 shrinks=(1.0, 0.5), blends=(0.0, 0.6))
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    executed = errors._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in executed and executed.count("Exchange hashpartitioning") == plan.count("RepartitionByExpression") == 1


@pytest.fixture
def no_small_tables(spark):
    """Spark takes no table for small enough to be broadcast."""
    former = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", former)


def test_rows_stay_whatever_spark_takes_for_small(spark, folder, table, no_small_tables):
    """Sums and models of pools over many dams go to the rows; no row, and no run of a row, is shuffled to them."""
    errors = search.sweep_errors(events_table(spark, folder), ["mean"], "2024-01-21", poolings=("dam", "all"), shrinks=(1.0, 0.5), blends=(0.0, 0.6))
    rows = ridge.ridge_matrix(causal.with_target_scale(table).localCheckpoint(), FEATURES, [(1.0, None), (50.0, FEATURES[:1])], "dam")
    for df in (errors, rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("at_once", [1, 3, 16])
def test_blends_do_not_depend_on_the_runs_summed_together(spark, folder, monkeypatch, at_once):
    """Each run's blend equals one from its own past losses, row by row."""
    grid = dict(split="2024-01-21", poolings=("dam", "all"), shrinks=(1.0, 0.5), blends=(0.6,))
    shown = lambda t: {(*r[:-1],): r.e for r in t.select("pooling", "scale_target", "shrink", "dam", "date", "horizon", F.col("abs_err_model").alias("e")).collect()}
    table = events_table(spark, folder)
    monkeypatch.setattr(search, "RUNS_AT_ONCE", at_once)
    got = shown(search.sweep_errors(table, ["mean"], **grid))
    rows = search.prepared(table, crossed=False)
    for pooling, shrink in (("dam", 0.5), ("all", 1.0)):
        base = search.causal_mean(rows, pooling, True, "base").withColumn("base", F.col("base") * shrink).withColumn("_pool", causal.pool_key(pooling))
        mixed = causal.expert_blend(base, ["base", *search.BASELINES], 0.6, ["_pool"], "mixed")
        alone = mixed.select("dam", "date", "horizon", F.abs(F.col("mixed") - F.col("target_delta")).alias("e")).collect()
        assert alone and all(got[pooling, True, shrink, r.dam, r.date, r.horizon] == pytest.approx(r.e, abs=1e-9) for r in alone)


def test_a_query_and_its_neighbours_are_one_row():
    """Neighbours travel as arrays, without the query's columns or the labels' keys."""
    queries = pd.DataFrame({"dam": ["a", "b", "c"], "day": [5, 5, 0], "x0": [0.0, 9.0, 0.0], "bound": [1 << 62] * 3})
    labels = pd.DataFrame({"label_day": [1, 2, 9, 1], "age": [3, 7, 9, 1], "y": [1.0, 2.0, 3.0, 4.0], "x0": [1.0, 8.0, 0.0, 1.0]})
    near = neighbours._near(queries, labels, ["x0"], ["dam"], 2)
    assert list(near.columns) == ["dam", "_far", "_age", "_y"] and list(near["dam"]) == ["a", "b"]
    best = [sorted(zip(*map(list, r))) for r in near[["_far", "_age", "_y"]].itertuples(index=False)]
    assert best == [[(10**9, 1, 4.0), (10**9, 3, 1.0)], [(10**9, 7, 2.0), (64 * 10**9, 1, 4.0)]]


def test_nearest_labels_against_all_pairs():
    """Ties to nine places, days out of order, days without labels, and bounds."""
    rng = np.random.default_rng(3)
    places = np.round(rng.normal(0, 1, (400, 3)), 1)
    places[50:60] = places[50] + rng.normal(0, 1e-11, (10, 3))
    known = np.sort(rng.integers(1, 20, 400))
    points, days = np.vstack([places[rng.integers(0, 400, 250)], np.round(rng.normal(0, 1, (100, 3)), 1)]), rng.integers(0, 22, 350).astype(float)
    days[7], bound = np.nan, np.where(rng.random(350) < 0.3, 10**8, 1 << 62)
    row, at, far = neighbours._nearest(points, days, bound, places, known, 5)
    got = {}
    for r, *label in zip(row.tolist(), far.tolist(), at.tolist()):
        got.setdefault(r, []).append(tuple(label))
    for i in range(350):
        nine = np.rint(sum((points[i, j] - places[:, j]) ** 2 for j in range(3)) * 1e9).astype(np.int64)
        want = sorted((int(nine[j]), j) for j in range(400) if known[j] <= days[i] and nine[j] <= bound[i])[:5]
        assert got.get(i, []) == want, i


def test_queries_whose_cell_knows_too_little_ask_few_cells(spark, monkeypatch):
    """Far from all that is known yet, a query is bound by a cell's farthest corner."""
    rows = [(f"d{i}", DAY, 1, DAY + dt.timedelta(1), float(i), float(i), 0.0) for i in range(400)]
    rows += [(f"late{i}", DAY + dt.timedelta(9), 1, DAY + dt.timedelta(10), 1.0, 900.0 + i, 0.0) for i in range(40)]
    rows += [(f"early{i}", DAY + dt.timedelta(5), 1, DAY + dt.timedelta(6), None, 910.0 + i, 0.0) for i in range(20)]
    asking = []

    def noted(df, label, write=neighbours.materialise, **options):
        out = write(df, label, **options)
        if label == "asking":
            asking.extend(out.filter("dam like 'early%'").collect())
        return out

    monkeypatch.setattr(neighbours, "materialise", noted)
    monkeypatch.setattr(neighbours, "CELL_LABELS", 20)
    got = {r.dam: r.model for r in neighbours.causal_knn(
        spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["dam", "date", "horizon"], "dam", 4, scaled=False).collect()}
    assert all(got[f"early{i}"] == 397.5 for i in range(20))
    assert len(asking) == 20 and max(len(r.cells) for r in asking) <= 3


@pytest.mark.parametrize("keys", [["horizon"], []])
def test_statistics_of_few_keys_are_written(table, keys, monkeypatch):
    written = []
    monkeypatch.setattr(causal, "materialise", lambda df, label, write=causal.materialise: written.append(label) or write(df, label))
    few, many = (causal.with_causal_z(table, ["a", "b"], keys, **more).select("dam", "date", "horizon", "z_a", "z_b").collect() for more in ({"few": True}, {}))
    assert sorted(few, key=str) == sorted(many, key=str) and len(few) == table.count() and written == ["moments"]


def test_rows_from_files_carry_no_zeros(table):
    """Issue dates are read apart; sums stay what they were, also without a date, a label date or a target."""
    rows = table.unionByName(table.limit(3).withColumn("label_date", F.lit(None).cast("date"))).unionByName(
        table.limit(2).withColumn("date", F.lit(None).cast("date"))).withColumn("_pool", F.col("horizon"))
    sums = {"n": F.lit(1.0), "total": F.col("a"), "loss": F.abs("target_delta")}
    exploded, apart = (causal.label_prefix(rows, ["_pool"], sums, written=w) for w in (False, True))
    key = lambda r: (r["_pool"], r["date"])
    one, two = ({key(r): tuple(r) for r in df.collect()} for df in (exploded, apart))
    assert one.keys() == two.keys() and all(two[k][2:] == pytest.approx(v[2:], abs=1e-9) for k, v in one.items())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan(exploded) and "Generate" not in plan(apart)


def test_a_matrix_of_ridges_is_its_variants(spark, folder):
    """Models hold only their own terms: NULL, NaN and far features count as they do alone."""
    rows = search.prepared(events_table(spark, folder), crossed=False).withColumn(
        "odd", F.when(F.col("horizon") == 1, F.lit(None)).when(F.col("horizon") == 2, F.lit(float("nan"))).otherwise(F.col("rwl_m") * 1e6))
    variants = [(1.0, ["rwl_m", "horizon"]), (100.0, ["rwl_m", "rain_3d", "horizon", "odd"])]
    used = list(dict.fromkeys(c for _, use in variants for c in use))
    keys = ["dam", "date", "horizon"]
    got = {tuple(r)[:3]: r.m for r in ridge.ridge_matrix(rows, used, variants, "all", True, "m").select(*keys, "m").collect()}
    assert got and ridge.ridge_variants(rows, used, variants, "all", True).count() == 2 * len(got)
    for r in ridge.ridge_variants(rows, used, variants, "all", True).select(*keys, "variant", "model").collect():
        assert got[r.dam, r.date, r.horizon][r.variant] == r.model
