"""Regression trees of many learners at once, grown level by level from histograms.

A learner is a pool at the start of a calendar block: it knows the labels dated before.
All learners, and the replicas of a forest, grow together: for each level one pass over
the rows reduces them, inside the tasks, to histograms per (learner, replica, node), a
shuffle adds these up, and the best cuts go to the next level. Only cuts pass through the
driver. The rows that every pass reads are packed once: chunks of cells of a byte, ordered by
label day, so that a learner's are a prefix. Pools within one entity, which the calendar
bounds, grow inside a task, those of a bucket together.

Targets are rounded to whole units of UNIT, so sums are exact in any order, and a rerun
or a lost task changes no tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.operators.causal import pool_key
from headwater.session import materialise

UNIT = 1e-6
BINS = 32  # of a feature, beside the one of missing values
EDGE_ROWS = 20_000  # labelled rows, chosen by hash, whose quantiles are the cuts that shared pools try
HELD_CELLS = 1 << 24  # histogram cells that a task holds: more learners grow in turns
HELD_ROWS = 200_000  # rows that a task reads into memory at once
ENTITY_POOLS = ("none", "horizon")


@dataclass(frozen=True)
class Trees:
    """What to grow: replicas that are averaged, or with `rates` one after the other on what is left."""

    replicas: int = 1
    depth: int = 5
    share: float = 1.0  # of the features that each node may cut
    drawn: bool = False  # rows drawn with replacement, by Poisson weights
    rates: tuple[float, ...] = ()
    seed: int = 7

    @property
    def size(self) -> int:
        return (2 << self.depth) - 1

    @property
    def count(self) -> int:
        return len(self.rates) or self.replicas


def weights(seeds: np.ndarray, replica: int) -> np.ndarray:
    """Poisson(1) draws that follow from the rows' hashes."""
    with np.errstate(over="ignore"):
        h = seeds.astype(np.uint64) + np.uint64(replica + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = (h ^ (h >> np.uint64(31))) / float(1 << 64)
    # Upper ends of the Poisson(1) probabilities of 0 to 6.
    return np.searchsorted([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676], uniform, "right")


def edges_of(known: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts to try for each column: its quantiles, all but the last value where these are few."""
    found = []
    for column in known.T:
        column = np.sort(column[~np.isnan(column)])
        at = (np.arange(1, bins) * len(column)) // bins
        edges = np.unique(column) if len(np.unique(column)) <= bins else np.unique(column[at])
        found.append(edges[edges < column[-1]] if len(column) else column)
    return found


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """0 for missing, then 1 for values up to the first edge, and so on."""
    out = np.zeros(x.shape, np.uint8, order="F")
    for j, cuts in enumerate(edges):
        seen = ~np.isnan(x[:, j])
        out[seen, j] = 1 + np.searchsorted(cuts, x[seen, j])
    return out


class Tree:
    """Cuts by heap position; a node without one is a leaf."""

    __slots__ = ("cut", "feature", "value")

    def __init__(self, size: int):
        self.feature, self.cut, self.value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size)

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node; whole columns of bytes are compared, a cut at a time."""
        kind = np.uint8 if len(self.feature) <= 255 else np.int64
        node = np.zeros(len(bins), kind)
        for at in range((1 << levels) - 1):
            if self.feature[at] >= 0:
                here = node == at if at else np.ones(len(bins), bool)
                right = here & (bins[:, self.feature[at]] > self.cut[at])
                node += here.astype(kind) * kind(at + 1)
                node += right.astype(kind)
        return node


def allowed(spec: Trees, features: int, replica: int, node: int) -> np.ndarray:
    """The features that a node may cut."""
    if spec.share >= 1.0:
        return np.arange(features)
    some = max(1, int(np.ceil(spec.share * features)))
    return np.sort(np.random.default_rng([spec.seed, replica, node]).permutation(features)[:some])


def histograms(spec: Trees, replica: int, tree: Tree, level: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray | None):
    """(node, counts, sums) of the open nodes of a level; both flat over (allowed feature, bin). No `w`: every row counts once."""
    node, first = tree.place(bins, level), (1 << level) - 1
    inside = np.flatnonzero(node >= first if w is None else (w > 0) & (node >= first))
    order = inside[np.argsort(node[inside], kind="stable")]
    counted = np.bincount(node[order], minlength=2 * first + 1)
    weight = None if w is None else w[order].astype(float)
    value = y[order].astype(float) if w is None else (w[order] * y[order]).astype(float)
    stop = 0
    for at in np.flatnonzero(counted).tolist():
        begin, stop = stop, stop + int(counted[at])
        rows, each = order[begin:stop], None if w is None else weight[begin:stop]
        features = allowed(spec, bins.shape[1], replica, at)
        n, s = np.empty((len(features), BINS + 1), np.int64), np.empty((len(features), BINS + 1), np.int64)
        for i, j in enumerate(features):
            cells = bins[:, j][rows]
            n[i], s[i] = np.bincount(cells, each, BINS + 1), np.bincount(cells, value[begin:stop], BINS + 1)
        yield at, n.ravel(), s.ravel()


def best_cut(features: np.ndarray, n: np.ndarray, s: np.ndarray):
    """(feature, bin, [count, sum] left, [count, sum] in all): the cut that leaves least squared error, or feature -1.

    Of cuts that are equal but for rounding the first feature's lowest counts.
    """
    n, s = n.reshape(len(features), -1), s.reshape(len(features), -1)
    total, whole = n[0].sum(), s[0].sum()
    left, below = np.cumsum(n, 1)[:, :-1], np.cumsum(s, 1)[:, :-1]
    valid = (left > 0) & (left < total)
    none = -1, 0, (0, 0), (int(total), int(whole))
    if not valid.any():
        return none
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, below.astype(float) ** 2 / left + (whole - below).astype(float) ** 2 / (total - left), -np.inf)
    base = float(whole) ** 2 / float(total)
    best = score.max()
    if best - base <= 1e-9 * max(base, 1.0):
        return none
    at = int(np.argmax(score >= best - 1e-9 * (best - base)))
    j, b = divmod(at, score.shape[1])
    return int(features[j]), b, (int(left[j, b]), int(below[j, b])), (int(total), int(whole))


def apply_cut(tree: Tree, node: int, cut) -> None:
    feature, b, (n_left, s_left), (n, s) = cut
    if node == 0:
        tree.value[0] = s / n
    if feature >= 0:
        tree.feature[node], tree.cut[node] = feature, b
        tree.value[2 * node + 1] = s_left / n_left
        tree.value[2 * node + 2] = (s - s_left) / (n - n_left)


def predicted(spec: Trees, trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """Sum of the trees grown so far, each times its rate, or the mean of the replicas."""
    out = np.zeros(len(bins))
    for k, tree in enumerate(trees):
        out += (spec.rates[k] if spec.rates else 1.0 / len(trees)) * tree.value[tree.place(bins, spec.depth)]
    return out


def bins_of_each(learner: np.ndarray, x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """`binned` by the `edges_of` each learner's known rows, for rows of many learners at once."""
    out = np.zeros(x.shape, np.uint8, order="F")
    count = int(learner.max()) + 1 if len(learner) else 0
    for j in range(x.shape[1]):
        seen = np.flatnonzero(~np.isnan(x[:, j]))
        if not len(seen):
            continue
        order = seen[np.lexsort((x[seen, j], learner[seen]))]
        of, value, mine = learner[order], x[order, j], known[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(fresh) - 1  # of equal values of a learner
        group_of = of[fresh]
        among = np.bincount(group, mine, group[-1] + 1) > 0  # values that the learner knows
        distinct, total = np.bincount(group_of, among, count).astype(np.int64), np.bincount(of, mine, count).astype(np.int64)
        last = np.full(count, -1)
        last[group_of[among]] = np.flatnonzero(among)
        # Quantiles by a row's place among the known ones of its learner.
        so_far = np.cumsum(mine)
        place = so_far - 1 - (np.cumsum(total) - total)[of]
        most = np.maximum(total[of], 1)
        k = -(-place * BINS // most)
        at = mine & (k >= 1) & (k < BINS) & ((k * most) // BINS == place)
        edge = np.where(distinct[group_of] <= BINS, among, np.bincount(group, at, group[-1] + 1) > 0)
        edge[last[last >= 0]] = False
        below = np.cumsum(edge) - edge
        first = np.zeros(count, np.int64)
        first[group_of[::-1]] = below[::-1]
        out[order, j] = 1 + (below - first[group_of])[group]
    return out


def best_cuts(features: np.ndarray, n: np.ndarray, s: np.ndarray):
    """`best_cut` of many nodes: arrays of feature, bin, count and sum left, count and sum in all. n and s: (node, feature, bin)."""
    total, whole = n[:, 0].sum(1), s[:, 0].sum(1)
    left, below = np.cumsum(n, 2)[:, :, :-1], np.cumsum(s, 2)[:, :, :-1]
    size, over = total[:, None, None], whole[:, None, None]
    valid = (left > 0) & (left < size)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, below.astype(float) ** 2 / left + (over - below).astype(float) ** 2 / (size - left), -np.inf).reshape(len(n), -1)
        base = whole.astype(float) ** 2 / total.astype(float)
        best = score.max(1)
        cut = valid.reshape(len(n), -1).any(1) & ~(best - base <= 1e-9 * np.maximum(base, 1.0))
        at = np.argmax(score >= (best - 1e-9 * (best - base))[:, None], axis=1)
    j, b = np.divmod(at, left.shape[2])
    rows = np.arange(len(n))
    return np.where(cut, features[j], -1), b, left[rows, j, b], below[rows, j, b], total, whole


def grow_each(spec: Trees, learner: np.ndarray, bins: np.ndarray, y: np.ndarray, seeds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Predictions of all rows, each by the trees that its learner grows from its known rows.

    Rows come in the order of their learners. One pass over them serves a node of all learners.
    """
    out = np.zeros(len(y))
    for replica in range(spec.count):
        w = np.where(known, weights(seeds, replica) if spec.drawn else 1, 0)
        left = y - np.rint(out).astype(np.int64) if spec.rates else y
        node, value = np.zeros(len(y), np.int64), np.zeros(len(y))
        weight, weighted = w.astype(float), (w * left).astype(float)
        for at in range((1 << spec.depth) - 1):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            features, of = allowed(spec, bins.shape[1], replica, at), learner[rows]
            place = np.cumsum(np.diff(of, prepend=of[0]) != 0)
            many = int(place[-1]) + 1
            shape = many, len(features), BINS + 1
            n, s = np.empty(shape, np.int64), np.empty(shape, np.int64)
            for i, j in enumerate(features):
                cells = place * (BINS + 1) + bins[:, j][rows]
                n[:, i] = np.bincount(cells, weight[rows], many * (BINS + 1)).reshape(many, -1)
                s[:, i] = np.bincount(cells, weighted[rows], many * (BINS + 1)).reshape(many, -1)
            feature, b, n_left, s_left, total, whole = best_cuts(features, n, s)
            if at == 0:
                value[rows] = (whole / np.maximum(total, 1))[place]
            cut = feature[place] >= 0
            rows, place = rows[cut], place[cut]
            right = bins[rows, feature[place]] > b[place]
            node[rows] = 2 * at + 1 + right
            low, high = s_left / np.maximum(n_left, 1), (whole - s_left) / np.maximum(total - n_left, 1)
            value[rows] = np.where(right, high[place], low[place])
        out += (spec.rates[replica] if spec.rates else 1.0 / spec.count) * value
    return out


def in_units(y: Column) -> Column:
    return F.round(y.cast("double") / F.lit(UNIT)).cast("long")


def slim(rows: DataFrame, features: Sequence[str], keys: Sequence[str], pool: Column, y: Column, block: Column) -> DataFrame:
    """The learner's view: pool, first day of the block, label day, target in units, row hash, keys and features."""
    return rows.select(
        pool.alias("_pool"), F.unix_date(block).alias("_block"), F.unix_date("label_date").alias("_label"), in_units(y).alias("_y"),
        F.xxhash64(*keys).alias("_seed"), *keys, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])


def walk(rows: DataFrame, features: Sequence[str], keys: Sequence[str], spec: Trees, pooling: str, y: Column, block: Column) -> DataFrame:
    """(keys, _trees): predictions by trees that know the labels dated before each row's block.

    Missing features fall below every cut. NULL where a learner knows fewer than two labels.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _trees double"
    ready = slim(rows, features, keys, pool_key(pooling), y, block)
    if pooling in ENTITY_POOLS:
        return _within(ready, len(features), list(keys), spec, schema)
    return _shared(materialise(ready, "trees"), len(features), list(keys), spec, schema)


def _matrix(frame: pd.DataFrame, count: int) -> np.ndarray:
    return frame[[f"_x{i}" for i in range(count)]].to_numpy(float)


def _within(ready: DataFrame, count: int, keys: list[str], spec: Trees, schema: str) -> DataFrame:
    """Pools that one task holds: learners grow where their rows are."""
    buckets = 4 * int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def some(x, y, labelled, label, seed, pool, starts, wanted) -> np.ndarray:
        """Predictions of the rows of a few pools; `wanted` are the pools."""
        out, parts = np.full(len(y), np.nan), []
        for start in np.unique(starts):
            past, mine = np.flatnonzero(labelled & (label < start)), np.flatnonzero(starts == start)
            enough = np.bincount(pool[past], minlength=wanted) >= 2
            past, mine = past[enough[pool[past]]], mine[enough[pool[mine]]]
            parts.append((np.concatenate([past, mine]), np.repeat([True, False], [len(past), len(mine)]), start))
        rows, known = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        learner = np.concatenate([pool[p[0]] + i * wanted for i, p in enumerate(parts)])
        order = np.argsort(learner, kind="stable")
        rows, known, learner = rows[order], known[order], learner[order]
        if len(rows):
            grown = grow_each(spec, learner, bins_of_each(learner, x[rows], known), y[rows], seed[rows], known)
            out[rows[~known]] = grown[~known] * UNIT
        return out

    # The pools of a call grow together: one call for each, or a step for each of its nodes, would cost more than their trees.
    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["_pool"].notna()]
        pool = pd.factorize(frame["_pool"])[0]
        frame = frame.iloc[np.argsort(pool, kind="stable")]
        pool, out = np.sort(pool), np.full(len(frame), np.nan)
        x, label, seed, starts = _matrix(frame, count), frame["_label"].to_numpy(), frame["_seed"].to_numpy(), frame["_block"].to_numpy()
        labelled, y = frame["_y"].notna().to_numpy(), frame["_y"].fillna(0).to_numpy().astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(pool)) + 1, len(pool))
        begin = 0
        while begin < len(pool):
            # Whole pools of some HELD_ROWS / 4 rows, which a few blocks' learners read.
            end = int(ends[min(np.searchsorted(ends, begin + max(1, HELD_ROWS // 4)), len(ends) - 1)])
            part = slice(begin, end)
            out[part] = some(x[part], y[part], labelled[part], label[part], seed[part], pool[part] - pool[begin], starts[part], int(pool[end - 1] - pool[begin]) + 1)
            begin = end
        return frame[keys].assign(_trees=out)

    found = ready.withColumn("_bucket", F.pmod(F.xxhash64("_pool"), F.lit(buckets))).groupBy("_bucket").applyInPandas(bucket, schema)
    return found.withColumn("_trees", F.when(~F.isnan("_trees"), F.col("_trees")))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for frame in batches:
        held.append(frame)
        size += len(frame)
        if size >= HELD_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _shared(ready: DataFrame, count: int, keys: list[str], spec: Trees, schema: str) -> DataFrame:
    """Pools over many entities: as few as there are horizons, each of any size."""
    # What the passes read: keys stay behind.
    known = ready.filter("_y is not null").select("_pool", "_label", "_y", "_seed", *[f"_x{i}" for i in range(count)])
    learners = ready.select("_pool", "_block").distinct().collect()  # pools over entities times the calendar's blocks
    learners = sorted((r["_pool"], r["_block"]) for r in learners)
    total = known.count()
    share = min(1.0, EDGE_ROWS / max(1, total))
    sample = known.filter(F.pmod(F.xxhash64(F.col("_seed"), F.lit(spec.seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).toPandas()
    sample_x, sample_label = _matrix(sample, count), sample["_label"].to_numpy()
    cells = max(1, spec.replicas * (1 << max(0, spec.depth - 1)) * max(1, int(np.ceil(spec.share * count))) * (BINS + 1))
    turn = max(1, HELD_CELLS // cells)
    parts = []
    for at in range(0, len(learners), turn):
        some = learners[at : at + turn]
        starts = sorted({s for _, s in some})
        edges = {s: edges_of(sample_x[sample_label < s]) for s in starts}
        parts.append(_predict(ready, count, keys, spec, schema, some, edges, _grow_all(known, count, spec, some, edges)))
    out = ready.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def packer(count: int, learners: list, edges: dict, seeds: bool):
    """Rows to chunks of a pool, ordered by label day: targets, draws' seeds, and for each block's cuts
    the bytes of the rows that it knows, a prefix, feature by feature."""
    pools = {pool: sorted(s for p, s in learners if p == pool) for pool, _ in learners}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _chunks(batches):
            out = []
            for pool, at in frame.groupby("_pool", sort=False, dropna=False).indices.items():
                part = frame.iloc[at[np.argsort(frame["_label"].to_numpy()[at], kind="stable")]]
                x, label = _matrix(part, count), part["_label"].to_numpy()
                cells = {s: binned(x[:stop], edges[s]) for s in pools.get(pool, ()) if (stop := int(np.searchsorted(label, s)))}
                if cells:
                    most = max(map(len, cells.values()))
                    seed = part["_seed"].to_numpy(np.int64)[:most].tobytes() if seeds else b""
                    out.append((pool, list(cells), [c.tobytes(order="F") for c in cells.values()], part["_y"].to_numpy(np.int64)[:most].tobytes(), seed))
            if out:
                yield pd.DataFrame(out, columns=["pool", "starts", "cells", "y", "seed"])

    return pack


PACKED = "pool string, starts array<int>, cells array<binary>, y binary, seed binary"
PACKED_GROUP = 32 << 20  # bytes of a row group, which a task holds at once


def _grow_all(known: DataFrame, count: int, spec: Trees, learners: list, edges: dict) -> dict:
    """Trees of each learner; {} for one that knows fewer than two labels."""
    rounds = [[k] for k in range(len(spec.rates))] if spec.rates else [list(range(spec.replicas))]
    grown = {learner: [] for learner in learners}
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.filter(F.col("_label") < max(s for _, s in learners))
    counted = known.groupBy("_pool", "_label").count().collect()  # a row per pool and day
    seen = {(p, s): sum(r["count"] for r in counted if r["_pool"] == p and r["_label"] < s) for p, s in learners}
    # Every pass reads the same rows again: their cells are looked up and written once.
    packed = materialise(known.mapInPandas(packer(count, learners, edges, spec.drawn), PACKED), "packed", **{"parquet.block.size": PACKED_GROUP})
    for replicas in rounds:
        trees = {(i, k): Tree(spec.size) for i, learner in enumerate(learners) if seen[learner] >= 2 for k in replicas}
        for level in range(spec.depth):
            cuts = _level(packed, count, spec, learners, trees, grown, level, tasks)
            for i, k, node, *cut in cuts:
                apply_cut(trees[i, k], node, (cut[0], cut[1], cut[2:4], cut[4:6]))
            if not any(c[3] >= 0 for c in cuts):
                break
        for (i, _), tree in sorted(trees.items()):
            grown[learners[i]].append(tree)
    return grown


def _level(packed: DataFrame, count: int, spec: Trees, learners, trees, grown, level: int, tasks: int) -> list:
    numbers = {learner: i for i, learner in enumerate(learners)}
    replicas = {i: [k for j, k in trees if j == i] for i in range(len(learners))}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                pool, starts = batch["pool"][row].as_py(), batch["starts"][row].as_py()
                y, cells = np.frombuffer(batch["y"][row].as_buffer(), np.int64), batch["cells"][row].values
                seed = np.frombuffer(batch["seed"][row].as_buffer(), np.int64)
                draws = {k: weights(seed, k) for k in {k for _, k in trees}} if spec.drawn else {}
                for at, start in enumerate(starts):
                    i = numbers[pool, start]
                    if not replicas[i]:
                        continue
                    bins = np.frombuffer(cells[at].as_buffer(), np.uint8).reshape((-1, count), order="F")
                    target = y[:len(bins)]
                    if spec.rates:
                        target = target - np.rint(predicted(spec, grown[learners[i]], bins)).astype(np.int64)
                    for k in replicas[i]:
                        for node, n, s in histograms(spec, k, trees[i, k], level, bins, target, draws[k][:len(bins)] if spec.drawn else None):
                            key, both = (i, k, node), np.stack([n, s])
                            if key in held:
                                held[key] += both
                            else:
                                held[key] = both
        if held:
            ids = [pa.array([key[j] for key in held], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["learner", "replica", "node", "cells"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for i, k, node, cells in frame.itertuples(index=False):
                part = np.frombuffer(cells, np.int64)
                key = i, k, node
                sums[key] = sums[key] + part if key in sums else part
        out = []
        for (i, k, node), both in sums.items():
            n, s = both.reshape(2, -1)
            feature, b, left, whole = best_cut(allowed(spec, count, k, node), n, s)
            out.append((i, k, node, feature, b, *left, *whole))
        yield pd.DataFrame(out, columns=["learner", "replica", "node", "feature", "bin", "n_left", "s_left", "n", "s"])

    partial = packed.mapInArrow(reduce, "learner int, replica int, node int, cells binary")
    chosen = partial.repartition(tasks, "learner", "replica", "node").mapInPandas(
        choose, "learner int, replica int, node int, feature int, bin int, n_left long, s_left long, n long, s long")
    return [tuple(r) for r in chosen.collect()]  # one cut per open node


def _predict(ready: DataFrame, count: int, keys: list[str], spec: Trees, schema: str, learners, edges, grown) -> DataFrame:
    wanted = set(learners)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, mine = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, bool)
            x = np.column_stack([batch[f"_x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(count)])
            of = pd.DataFrame({"pool": batch["_pool"].to_pandas(), "block": batch["_block"].to_pandas()})
            for key, rows in of.groupby(["pool", "block"], sort=False).indices.items():
                if key in wanted:
                    mine[rows] = True
                    if grown[key]:
                        values[rows] = predicted(spec, grown[key], binned(x[rows], edges[key[1]])) * UNIT
            # The keys pass as they are.
            found = pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(values)], names=[*keys, "_trees"])
            yield found if mine.all() else found.filter(pa.array(mine))

    blocks = sorted({start for _, start in learners})
    found = ready.filter(F.col("_block").isin(blocks)).mapInArrow(predict, schema)
    return found.withColumn("_trees", F.when(~F.isnan("_trees"), F.col("_trees")))
