"""Robust and logistic regression against plain loops over rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import reweighted

DAY = dt.date(2026, 1, 1)
SCHEMA = "dam string, date date, horizon int, label_date date, target_delta double, a double, b double, hit int"
POOL = {"all": lambda r: 0, "dam": lambda r: r[2], "horizon": lambda r: r[0], "none": lambda r: (r[0], r[2])}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for dam in ("x", "y"):
        for n in range(30):
            for h in (1, 4):
                a, b = float(rng.normal(50, 9)), None if rng.random() < 0.2 else float(rng.normal(0, 2))
                y = 0.4 * (a - 50) + 0.8 * h + (b or 0) + float(rng.normal(0, 0.5)) + (30.0 if rng.random() < 0.08 else 0.0)
                hit = None if rng.random() < 0.1 else int(rng.random() < 1 / (1 + np.exp(-0.2 * (a - 50) - (b or 0))))
                out.append((dam, DAY + dt.timedelta(n), h, DAY + dt.timedelta(n + h), y if rng.random() < 0.9 else None, a, b, hit))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def inputs(r):
    return np.array([r[5], np.nan if r[6] is None else r[6], r[2]], float)


def plain_fit(rows, pool, y, w, penalty=1.0):
    """Each row's prediction by weighted ridge on the labels known at its date; None without two by weight."""
    out = []
    for r in rows:
        past = [i for i, q in enumerate(rows) if pool(q) == pool(r) and y[i] is not None and q[3] <= r[1]]
        v = np.array([w[i] for i in past])
        if v.sum() < 2:
            out.append(None)
            continue
        x, t = np.array([inputs(rows[i]) for i in past]), np.array([y[i] for i in past])
        seen = ~np.isnan(x)
        mass = np.maximum((v[:, None] * seen).sum(0), 1e-300)
        mu = (v[:, None] * np.where(seen, x, 0)).sum(0) / mass
        sd = np.sqrt((v[:, None] * np.where(seen, x - mu, 0) ** 2).sum(0) / mass)
        ok = sd > np.maximum(1e-6, 1e-6 * np.abs(mu))
        z = np.where(seen & ok, (x - mu) / np.where(ok, sd, 1), 0.0)
        beta = np.linalg.solve(z.T @ (v[:, None] * z) + penalty * np.eye(3), z.T @ (v * t))
        mine = inputs(r)
        mine = np.where(np.isnan(mine) | ~ok, 0.0, np.clip((mine - mu) / np.where(ok, sd, 1), -5, 5))
        out.append(float((v * t).sum() / v.sum() + mine @ beta))
    return out


@pytest.mark.parametrize("pooling", list(POOL))
def test_huber_equals_plain(table, rows, pooling):
    pool, w = POOL[pooling], [1.0] * len(rows)
    y = [r[4] for r in rows]
    for step in range(3):
        fit = [f or 0.0 for f in plain_fit(rows, pool, y, w)]
        miss = [None if t is None else abs(t - f) for t, f in zip(y, fit)]
        for i, r in enumerate(rows):
            if y[i] is not None:
                usual = np.mean([miss[j] for j, q in enumerate(rows) if pool(q) == pool(r) and y[j] is not None and q[3] <= r[3]])
                w[i] = min(1.0, 1.35 * usual / miss[i]) if miss[i] else 1.0
    got = {(r.dam, r.date, r.horizon): r.model for r in reweighted.huber(table, ["a", "b", "horizon"], pooling, scaled=False).collect()}
    assert got == {r[:3]: pytest.approx(f, abs=1e-6) for r, f in zip(rows, fit)}


@pytest.mark.parametrize("pooling", list(POOL))
def test_logistic_equals_plain_newton_steps(table, rows, pooling):
    fit, label = [0.0] * len(rows), [r[7] for r in rows]
    for step in range(3):
        at = np.clip([f or 0.0 for f in fit], -6, 6)
        p = 1 / (1 + np.exp(-at))
        target = [None if k is None else a + (k - q) / (q * (1 - q)) for k, a, q in zip(label, at, p)]
        fit = plain_fit(rows, POOL[pooling], target, 4 * p * (1 - p))
    got = {(r.dam, r.date, r.horizon): r.prob for r in reweighted.logistic(table, ["a", "b", "horizon"], "hit", pooling).collect()}
    want = {r[:3]: None if f is None else pytest.approx(1 / (1 + np.exp(-np.clip(f, -30, 30))), abs=1e-7) for r, f in zip(rows, fit)}
    assert got == want


def test_outliers_pull_less(table, rows):
    """A spike of thirty in some labels: the robust fit stays nearer to the rest."""
    from headwater.operators.ridge import ridge

    plain = [r[4] is not None and abs(r[4] - 0.4 * (r[5] - 50) - 0.8 * r[2] - (r[6] or 0)) < 5 for r in rows]
    clean = {r[:3] for r, ok in zip(rows, plain) if ok and r[1] > DAY + dt.timedelta(10)}
    error = lambda df: np.mean([abs(r.model - r.target_delta) for r in df.collect() if (r.dam, r.date, r.horizon) in clean])
    assert error(reweighted.huber(table, ["a", "b", "horizon"], scaled=False)) < 0.9 * error(ridge(table, ["a", "b", "horizon"], scaled=False))


def test_later_labels_change_nothing_earlier(table):
    cut = F.lit("2026-01-20").cast("date")
    moved = table.withColumn("target_delta", F.when(F.col("label_date") > cut, F.col("target_delta") + 90).otherwise(F.col("target_delta")))
    moved = moved.withColumn("hit", F.when(F.col("label_date") > cut, 1 - F.col("hit")).otherwise(F.col("hit")))
    for run, name in ((lambda t: reweighted.huber(t, ["a"], scaled=False), "model"), (lambda t: reweighted.logistic(t, ["a"], "hit"), "prob")):
        one, two = ({(r.dam, r.date, r.horizon): r[name] for r in run(t).filter(F.col("date") <= cut).collect()} for t in (table, moved))
        assert one.keys() == two.keys() and all(v == (None if two[k] is None else pytest.approx(two[k], abs=1e-9)) for k, v in one.items())
