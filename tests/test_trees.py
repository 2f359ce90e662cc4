"""Histogram trees against a plain recursive tree."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import trees
from headwater.plans import walkforward

DAY = dt.date(2026, 1, 1)
SCHEMA = "dam string, date date, horizon int, label_date date, target_delta double, a double, b double"
KEYS = ["dam", "date", "horizon"]
POOL = {"all": lambda r: 0, "dam": lambda r: r[2], "horizon": lambda r: r[0], "none": lambda r: (r[0], r[2])}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for dam in ("x", "y", "z"):
        for n in range(35):
            for h in (1, 3):
                # Few different values: every cut between them is tried.
                a, b = float(rng.integers(0, 9)), None if rng.random() < 0.2 else float(rng.integers(0, 5))
                y = 2.0 * (a > 4) * (1 if b is None else b) + 0.3 * h + round(float(rng.normal(0, 0.3)), 3)
                out.append((dam, DAY + dt.timedelta(n), h, DAY + dt.timedelta(n + h), y if rng.random() < 0.9 else None, a, b))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def features(r):
    return [r[5], -np.inf if r[6] is None else r[6], float(r[2])]


def plain_tree(x, y, depth):
    """A function from a row to its prediction, by trying every cut."""
    best, base = None, ((y - y.mean()) ** 2).sum()
    for j in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = base - sum(((p - p.mean()) ** 2).sum() for p in (y[left], y[~left]))
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                best = gain, j, cut
    if best is None:
        return lambda v, m=y.mean(): m
    _, j, cut = best
    left = x[:, j] <= cut
    low, high = plain_tree(x[left], y[left], depth - 1), plain_tree(x[~left], y[~left], depth - 1)
    return lambda v: low(v) if v[j] <= cut else high(v)


def monday(day):
    return day - dt.timedelta(day.weekday())


def plain(rows, pooling, depth, rates=(1.0,)):
    out, pool = {}, POOL[pooling]
    for group in {(pool(r), monday(r[1])) for r in rows}:
        mine = [r for r in rows if (pool(r), monday(r[1])) == group]
        past = [r for r in rows if pool(r) == group[0] and r[4] is not None and r[3] < group[1]]
        if len(past) < 2:
            out |= {r[:3]: None for r in mine}
            continue
        x, left = np.array([features(r) for r in past]), np.array([r[4] for r in past])
        total = dict.fromkeys([r[:3] for r in mine], 0.0)
        for rate in rates:
            tree = plain_tree(x, left, depth)
            left = left - rate * np.array([tree(v) for v in x])
            for r in mine:
                total[r[:3]] += rate * tree(features(r))
        out |= total
    return out


def run(table, spec, pooling):
    found = trees.walk(table, ["a", "b", "horizon"], KEYS, spec, pooling, F.col("target_delta"), F.trunc("date", "week"))
    return {(r.dam, r.date, r.horizon): r._trees for r in found.collect()}


@pytest.mark.parametrize("pooling", list(POOL))
def test_tree_equals_plain(table, rows, pooling):
    got, want = run(table, trees.Trees(depth=3), pooling), plain(rows, pooling, 3)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-5)), key


def test_boosted_equals_plain(table, rows):
    rates = (1.0, 0.4, 0.4)
    for pooling in ("dam", "horizon"):
        got, want = run(table, trees.Trees(depth=2, rates=rates), pooling), plain(rows, pooling, 2, rates)
        assert all(got[k] == (None if v is None else pytest.approx(v, abs=1e-4)) for k, v in want.items())


def test_learners_in_turns_are_the_same(table, monkeypatch):
    spec = trees.Trees(3, depth=3, share=0.5, drawn=True)
    once = run(table, spec, "dam")
    monkeypatch.setattr(trees, "HELD_CELLS", 1)
    monkeypatch.setattr(trees, "HELD_ROWS", 20)
    assert run(table.repartition(7), spec, "dam") == once


def test_shared_and_local_forests_are_the_same(table):
    """One dam alone: its pool over all horizons is the same learner either way."""
    spec, one = trees.Trees(4, depth=3, share=0.5, drawn=True), table.filter("dam = 'x'")
    assert run(one, spec, "all") == pytest.approx(run(one, spec, "horizon"))


def test_draws_are_poisson():
    seeds = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200_000)
    w = trees.weights(seeds, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and (w != trees.weights(seeds, 4)).mean() > 0.5


def test_quantiles_where_values_are_many():
    column = np.concatenate([np.arange(10_000.0), [np.nan] * 50])[:, None]
    edges = trees.edges_of(column)
    assert len(edges[0]) == trees.BINS - 1 and trees.binned(column, edges).max() == trees.BINS
    assert np.ptp(np.bincount(trees.binned(column, edges)[:10_000, 0])[1:]) <= 2


def test_empty_and_unlabelled_tables(spark, table):
    for pooling in POOL:
        assert run(table.limit(0), trees.Trees(), pooling) == {}
        assert set(run(table.withColumn("target_delta", F.lit(None).cast("double")), trees.Trees(), pooling).values()) == {None}


@pytest.mark.parametrize("pooling", list(POOL))
@pytest.mark.parametrize("estimator", ["forest10", "boosted"])
def test_walk_forward_pools(table, rows, pooling, estimator):
    scored = walkforward.walk_forward(table, ["a", "b"], estimator, walkforward.week_start(), scaled=False, pooling=pooling).collect()
    assert len(scored) == len(rows)
    late = [r for r in scored if r.target_delta is not None and r.date > DAY + dt.timedelta(20)]
    mean = np.mean([r.target_delta for r in late])
    assert np.mean([abs(r.model - r.target_delta) for r in late]) < 0.8 * np.mean([abs(mean - r.target_delta) for r in late])


def learners_of(count):
    rng, parts = np.random.default_rng(4), []
    for at in range(count):
        n = int(rng.integers(40, 120))
        x = np.round(rng.normal(size=(n + 3, 3)) * [1, 100, 1], 1)
        x[rng.random(x.shape) < 0.1] = np.nan
        parts.append((np.full(n + 3, at), x, rng.integers(-10**6, 10**6, n + 3), rng.integers(0, 1 << 62, n + 3), np.arange(n + 3) < n))
    return [np.concatenate(p) for p in zip(*parts)]


@pytest.mark.parametrize("spec", [trees.Trees(3, depth=3, share=0.5, drawn=True), trees.Trees(depth=3, rates=(1.0, 0.3, 0.3))])
def test_learners_together_are_the_same_as_alone_and_cost_no_step_each(spec, monkeypatch):
    steps, plain_count = [], np.bincount
    monkeypatch.setattr(trees.np, "bincount", lambda *a, **k: steps.append(1) or plain_count(*a, **k))
    of, x, y, seed, known = learners_of(40)
    bins = trees.bins_of_each(of, x, known)
    together = trees.grow_each(spec, of, bins, y, seed, known)
    for_all = len(steps)
    for at in range(40):
        mine = of == at
        edges = trees.edges_of(x[mine & known])
        assert (bins[mine] == trees.binned(x[mine], edges)).all()
        alone = trees.grow_each(spec, of[mine] - at, trees.binned(x[mine], edges), y[mine], seed[mine], known[mine])
        assert (alone == together[mine]).all()
    assert for_all < 3 * (len(steps) - for_all) / 40


def test_packed_rows_are_a_prefix_of_each_blocks_cells():
    import pandas as pd
    _, x, y, seed, _ = learners_of(5)
    frame = pd.DataFrame({"_pool": np.where(np.arange(len(y)) % 2, "1", "2"), "_label": np.arange(len(y))[::-1] % 20, "_y": y, "_seed": seed,
                          **{f"_x{j}": x[:, j] for j in range(3)}})
    learners = [("1", 0), ("1", 7), ("1", 30), ("2", 7)]
    edges = {s: trees.edges_of(x[frame["_label"].to_numpy() < s]) for s in (0, 7, 30)}
    (packed,) = trees.packer(3, learners, edges, True)([frame])
    assert {r.pool: r.starts for r in packed.itertuples()} == {"1": [7, 30], "2": [7]}
    for r in packed.itertuples():
        mine = frame[frame["_pool"] == r.pool].sort_values("_label", kind="stable")
        for start, cells in zip(r.starts, r.cells):
            past = mine[mine["_label"] < start]
            assert (np.frombuffer(cells, np.uint8).reshape((-1, 3), order="F") == trees.binned(past[["_x0", "_x1", "_x2"]].to_numpy(), edges[start])).all()
            assert (np.frombuffer(r.y, np.int64)[:len(past)] == past["_y"]).all() and (np.frombuffer(r.seed, np.int64)[:len(past)] == past["_seed"]).all()
