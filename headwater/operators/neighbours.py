"""Nearest neighbours among the labels known at issue time.

Pools within one entity hold a row per day and horizon, so the calendar bounds
them: their rows meet all labels known so far. Pools over many entities grow with
these, and all their pairs are no longer a plan. Their labels are dealt into cells of
near points. A query first asks the cell it lies in, which bounds how far its neighbours
can be, then all cells whose box begins within that bound; the best k of each cell
merge by a second top-k. This is exact, and nothing is forgotten.

With a stated memory a learner keeps only its latest labels, of which those of one day
are chosen by a hash of their key. Days are then grouped into blocks; a block's queries,
split into groups of bounded size, meet the rows its days may remember, and the exact
memory of each day is taken inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.numeric import finite_or_zero
from headwater.operators.causal import ENTITY_POOLS, pool_key, scaled_target, unscaled
from headwater.operators.ridge import in_buckets
from headwater.session import materialise

QUERIES_PER_TASK = 20_000
SALTS = 32
CELL_LABELS = 1_000  # labels that a cell should hold
MOST_CELLS = 4_096  # of all pools: their boxes travel with the tasks
SAMPLE = 65_536  # labels, chosen by hash, that place the cells' borders
BLOCK_LABELS = 20_000  # of a cell that meet queries at once: larger cells come in blocks
PAIRS = 1 << 18  # of queries and labels that are compared at once
BESIDE = 16  # labels of which only the nearest counts for a first bound


def nearest_mean(queries: np.ndarray, known: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Mean target of the k nearest known rows; equal distances favour the older.

    Distances are compared to nine places. Place and age form one integer key
    per pair, so that a partial selection is exact and has no ties.
    """
    if len(known) <= k:
        return np.full(len(queries), y.mean())
    out = np.empty(len(queries))
    age = np.arange(len(known))
    for start in range(0, len(queries), 256):
        part = queries[start:start + 256]
        distance = np.zeros((len(part), len(known)))
        for j in range(known.shape[1]):
            distance += (part[:, j, None] - known[None, :, j]) ** 2
        order = np.rint(distance * 1e9).astype(np.int64) * len(known) + age
        near = np.argpartition(order, k - 1, axis=1)[:, :k]
        out[start:start + 256] = y[near].mean(axis=1)
    return out


def _answers(queries: pd.DataFrame, known: pd.DataFrame, x: Sequence[str], keys: Sequence[str], k: int,
             memory: int | None) -> pd.DataFrame:
    """The keys of the queries and the mean of each one's neighbours, NaN without any."""
    known = known.sort_values(["label_day", "order", *keys], kind="stable")
    labels, places, y = known["label_day"].to_numpy(), known[x].to_numpy(float), known["y"].to_numpy(float)
    values = np.full(len(queries), np.nan)
    days, points = queries["day"].to_numpy(), queries[x].to_numpy(float)
    for day in np.unique(days):
        stop = np.searchsorted(labels, day, side="right")
        start = 0 if memory is None else max(stop - memory, 0)
        if stop > start:
            mine = days == day
            values[mine] = nearest_mean(points[mine], places[start:stop], y[start:stop], k)
    return queries[list(keys)].assign(_knn=values)


def causal_knn(table: DataFrame, features: Sequence[str], keys: Sequence[str], pooling: str = "dam", k: int = 5,
               memory: int | None = None, block_days: int = 30, scaled: bool = True, name: str = "model") -> DataFrame:
    """Add the mean target of each row's nearest remembered neighbours.

    Features should be z-scores; a missing one counts as 0. Without any
    remembered row the prediction is no change. Every label is remembered unless
    `memory` says how many of a pool are.
    """
    features, keys = list(features), list(keys)
    rows = table.select(
        pool_key(pooling).alias("pool"), F.unix_date("date").alias("day"), F.unix_date("label_date").alias("label_day"),
        F.md5(F.concat_ws("|", *keys)).alias("order"), scaled_target(scaled).alias("y"), *keys,
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)],
    )
    x = [f"x{i}" for i in range(len(features))]
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _knn double"
    if memory is None and pooling not in ENTITY_POOLS:
        answers = _everything(rows, x, keys, k, schema)
    elif memory is None:
        def within(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([_answers(part, part[part["y"].notna()], x, keys, k, None) for _, part in frame.groupby("pool", sort=False)])

        answers = in_buckets(rows).applyInPandas(within, schema)
    else:
        answers = _remembering(rows, x, keys, k, memory, block_days, schema)
    answers = answers.withColumn("_knn", F.when(~F.isnan("_knn"), F.col("_knn")))
    value = finite_or_zero(unscaled(F.col("_knn")) if scaled else F.col("_knn"))
    return table.join(answers, keys, "left").withColumn(name, value).drop("_knn")


def _remembering(rows: DataFrame, x: Sequence[str], keys: Sequence[str], k: int, memory: int, block_days: int,
                 schema: str) -> DataFrame:
    """Answers of learners that remember their pool's latest `memory` labels."""
    block_of = lambda day: F.floor(F.col(day) / block_days).cast("int")

    # A day's labels beyond the memory can never be remembered. Spark turns a
    # row_number filter into a partial limit before the shuffle; the salted step
    # keeps what is left of a large pool's day from meeting in one task.
    newest_first = [F.col(c).desc() for c in ["order", *keys]]

    def newest(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(*newest_first)
        return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= memory).drop("_r")

    known = rows.filter(F.col("y").isNotNull())
    salted = known.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    known = newest(salted, "pool", "label_day", "_salt").drop("_salt")
    remembered = newest(known, "pool", "label_day").withColumn("block", block_of("label_day"))
    queries = rows.withColumn("block", block_of("day"))

    # Blocks per pool, numbered; how far the rows of each may be remembered.
    counts = (
        remembered.select("pool", "block", F.lit(1).alias("labels"), F.lit(0).alias("queries"))
        .unionByName(queries.select("pool", "block", F.lit(0).alias("labels"), F.lit(1).alias("queries")))
        .groupBy("pool", "block").agg(F.sum("labels").alias("labels"), F.sum("queries").alias("queries"))
    )
    in_order = Window.partitionBy("pool").orderBy("block")
    numbered = counts.withColumns(
        {
            "number": F.row_number().over(in_order),
            "so_far": F.sum("labels").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            "last": F.count(F.lit(1)).over(Window.partitionBy("pool")).cast("int"),
        }
    )
    within = Window.partitionBy("pool").orderBy("so_far").rangeBetween(0, memory - 1)
    # Written, so that joins know their size: a few per pool, and the queries need not move for them.
    blocks = materialise(numbered.select(
        "pool", "block", "number",
        F.least(F.max("number").over(within) + 1, F.col("last")).alias("reach"),
        F.greatest(F.ceil(F.col("queries") / QUERIES_PER_TASK).cast("int"), F.lit(1)).alias("groups"),
    ), "blocks")
    groups = blocks.select("pool", F.col("number").alias("at"), "groups")
    asked = (
        queries.join(blocks.select("pool", "block", F.col("number").alias("at"), "groups"), ["pool", "block"])
        .withColumn("group", F.pmod(F.xxhash64("day", *keys), F.col("groups")).cast("int"))
    )
    offered = (
        remembered.join(blocks.select("pool", "block", "number", "reach"), ["pool", "block"])
        .withColumn("at", F.explode(F.sequence("number", "reach")))
        .join(groups, ["pool", "at"])
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .select(*[F.col(c).alias(c) for c in ["pool", "at", "group", "label_day", "order", "y", *keys, *x]])
    )

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _answers(left, right, x, keys, k, memory)

    return (
        asked.select("pool", "at", "group", "day", *keys, *x).groupBy("pool", "at", "group")
        .cogroup(offered.groupBy("pool", "at", "group")).applyInPandas(answer, schema)
    )


class Cells:
    """Borders of the cells of one pool: a tree of median cuts along the widest side."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.feature, self.cut, self.child, self.count = [], [], [], 0
        self._split(points, leaf)

    def _split(self, points: np.ndarray, leaf: int) -> None:
        open_ = [(self._node(), points)]
        while open_:
            at, some = open_.pop()
            side = np.ptp(some, axis=0) if len(some) else np.zeros(1)
            j = int(side.argmax())
            left = some[:, j] <= np.median(some[:, j]) if len(some) > leaf and side[j] > 0 else np.ones(len(some), bool)
            if left.all() and len(some) > leaf and side[j] > 0:
                left = some[:, j] < some[:, j].max()
            if left.all():
                self.feature[at], self.child[at] = -1, self.count
                self.count += 1
                continue
            self.feature[at], self.cut[at], self.child[at] = j, float(some[left, j].max()), len(self.feature)
            first = self._node()
            open_ += [(first, some[left]), (self._node(), some[~left])]

    def _node(self) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append(0)
        return len(self.feature) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while (inner := feature[node] >= 0).any():
            right = points[rows, feature[node]] > cut[node]
            node = np.where(inner, child[node] + right, node)
        return child[node]


def _nearest(points: np.ndarray, days: np.ndarray, bound: np.ndarray, places: np.ndarray, known: np.ndarray,
             k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, label, distance to nine places) of the k nearest labels that each query knows, no farther than
    its bound; the rows of a query follow each other. Labels come in the order of age, their days `known` rise.

    A product of matrices gives distances but for rounding. The k-th least of the minima over disjoint
    labels bounds how far neighbours can be, and only labels within that are compared exactly.
    """
    rows = np.flatnonzero(~np.isnan(days.astype(float)))
    rows = rows[np.argsort(days[rows], kind="stable")]
    stops = np.searchsorted(known, days[rows], side="right")
    rows, stops = rows[stops > 0], stops[stops > 0]
    square = (places ** 2).sum(axis=1)
    sides, most = np.vstack([places.T, square]), square.max(initial=0.0)
    even = np.isfinite(points[rows]).all() and np.isfinite(sides).all()
    out, start = [[np.zeros(0, np.int64)] * 3], 0
    while start < len(rows):
        step = max(16, PAIRS // int(stops[min(start + 256, len(rows)) - 1]))
        mine, stop = rows[start:start + min(step, 256)], stops[start:start + min(step, 256)]
        start, first, last, asked = start + len(mine), stop[0], stop[-1], points[mine]
        if even:
            about = np.column_stack([asked * -2.0, np.ones(len(mine))]) @ sides[:, :last]
            about[:, first:][np.arange(first, last) >= stop[:, None]] = np.inf
            size = (asked ** 2).sum(axis=1)
            limit = (bound[mine] + 0.5) / 1e9 - size
            if (blocks := last // BESIDE) >= k:
                least = about[:, :blocks * BESIDE].reshape(len(mine), BESIDE, blocks).min(axis=1)
                limit = np.minimum(limit, np.partition(least, k - 1, axis=1)[:, k - 1])
            # What nine places hide, and what rounding of the product may add.
            limit += 2e-9 + 1e-14 * (points.shape[1] + 4) * (size + most)
            row, at = np.nonzero(about <= np.minimum(limit, 1e300)[:, None])
        else:
            row, at = np.nonzero(np.arange(last) < stop[:, None])
        distance = np.zeros(len(row))
        for j in range(points.shape[1]):
            distance += (asked[row, j] - places[at, j]) ** 2
        nine = np.rint(distance * 1e9).astype(np.int64)
        within = nine <= bound[mine][row]
        row, at, nine = row[within], at[within], nine[within]
        order = np.lexsort((at, nine, row))
        row, at, nine = row[order], at[order], nine[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append([mine[row[best]], at[best], nine[best]])
    return tuple(np.concatenate(c) for c in zip(*out))


def _met(queries: pa.Table, labels: pa.Table, x: Sequence[str], keys: Sequence[str], k: int) -> pa.Table:
    """Up to k nearest known labels of each query among those given, no farther than its `bound`: a row
    for each query that has any, with arrays of their distances, ages and targets."""
    of = lambda table, name: table.column(name).to_numpy()
    labels = labels.sort_by("age")
    points, places = (np.column_stack([of(t, c).astype(float) for c in x]) for t in (queries, labels))
    row, at, far = _nearest(points, of(queries, "day"), of(queries, "bound"), places, of(labels, "label_day"), k)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    offsets = pa.array(np.append(first, len(row)), pa.int32())
    found = queries.select(list(keys)).take(pa.array(row[first]))
    for name, values in (("_far", far), ("_age", of(labels, "age")[at]), ("_y", of(labels, "y")[at])):
        found = found.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(values)))
    return found


def _near(queries: pd.DataFrame, labels: pd.DataFrame, x: Sequence[str], keys: Sequence[str], k: int) -> pd.DataFrame:
    """`_met` of frames."""
    return _met(pa.Table.from_pandas(queries), pa.Table.from_pandas(labels), x, keys, k).to_pandas()


def _everything(rows: DataFrame, x: Sequence[str], keys: Sequence[str], k: int, schema: str) -> DataFrame:
    """Answers of learners over many entities that remember every label.

    A label's place in the order of age stands for its day and key, and a query's best labels
    travel as arrays in one row: neither texts nor the query's own columns go with each of them.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.concat_ws("|", *keys))
    # Of labels at one point the first k come before all others in any answer, however many repeat it.
    at_point = Window.partitionBy("pool", *x).orderBy("label_day", "order", "key")
    first = rows.filter("y is not null and label_day is not null").withColumn("_r", F.row_number().over(at_point)).filter(F.col("_r") <= k).drop("_r")
    labels = materialise(first, "labels")
    total = max(1, labels.count())
    share = min(1.0, SAMPLE / total)
    sample = labels.filter(F.pmod(F.xxhash64("key", "pool", F.lit("cells")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("pool", *x).toPandas()
    leaf = max(1, int(max(CELL_LABELS, total / MOST_CELLS) * len(sample) / total))
    # In a fixed order, so that a repeated job finds the same borders.
    trees = {p: Cells(np.array(sorted(map(tuple, some[list(x)].to_numpy(float)))), leaf) for p, some in sample.groupby("pool")}
    no_tree = Cells(np.zeros((0, len(x))), leaf)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            cell = np.zeros(len(frame), np.int64)
            for pool, at in frame.groupby("pool", sort=False).indices.items():
                cell[at] = trees.get(pool, no_tree).of(frame[list(x)].to_numpy(float)[at])
            yield frame.assign(cell=cell)

    kinds = dict(rows.dtypes)
    placed = lambda df: ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + ", cell long"
    asked = rows.drop("y", "label_day", "order", "key")
    asked = materialise(asked.mapInPandas(place, placed(asked)), "asked")
    # Ids rise with the order of the sorted rows.
    aged = labels.orderBy("label_day", "order", "key").withColumn("age", F.monotonically_increasing_id())
    aged = aged.select("pool", "label_day", "age", "y", *x)
    labels = materialise(aged.mapInPandas(place, placed(aged)), "cells")
    # A row per cell: since when it has a label, since when k of them, and its box.
    sides = [f(c).alias(f"{n}_{c}") for c in x for n, f in (("low", F.min), ("high", F.max))]
    days = labels.groupBy("pool", "cell", "label_day").agg(F.count("*").alias("n"), *sides)
    days = days.withColumn("so_far", F.sum("n").over(Window.partitionBy("pool", "cell").orderBy("label_day")))
    boxes = days.groupBy("pool", "cell").agg(
        F.sum("n").alias("n"), F.min("label_day").alias("since"), F.min(F.when(F.col("so_far") >= k, F.col("label_day"))).alias("full"),
        F.array(*[F.min(f"low_{c}") for c in x]).alias("low"), F.array(*[F.max(f"high_{c}") for c in x]).alias("high")).collect()
    by_pool = {p: [b for b in boxes if b["pool"] == p] for p in {b["pool"] for b in boxes}}
    box = {p: (np.array([b["cell"] for b in some]), np.array([b["since"] for b in some]), np.array([np.inf if b["full"] is None else b["full"] for b in some]),
               np.array([b["low"] for b in some]), np.array([b["high"] for b in some])) for p, some in by_pool.items()}
    blocks = spark.createDataFrame([(b["pool"], b["cell"], -(-b["n"] // BLOCK_LABELS)) for b in boxes], "pool string, cell long, blocks int")
    spots = ["pool", "cell", "block", "group"]
    labels = labels.join(F.broadcast(blocks), ["pool", "cell"]).withColumn("block", F.pmod(F.xxhash64("age"), F.col("blocks")).cast("int")).drop("blocks")
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    partial = f"{named}, _far array<long>, _age array<long>, _y array<double>"

    def meet(queries: DataFrame) -> DataFrame:
        """Best labels of each (query, cell): cells come in blocks of labels, their queries in groups."""
        many = queries.groupBy("pool", "cell").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("groups"))
        # A row per cell, written: the queries are counted once and stay where they are until they meet the labels.
        many = F.broadcast(materialise(many.join(F.broadcast(blocks), ["pool", "cell"]), "groups"))
        queries = queries.join(many, ["pool", "cell"]).withColumn("group", F.pmod(F.xxhash64(*keys, F.lit("group")), F.col("groups")).cast("int"))
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups")
        offered = labels.join(many.drop("blocks"), ["pool", "cell"])
        offered = offered.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return queries.groupBy(*spots).cogroup(offered.groupBy(*spots)).applyInArrow(lambda a, b: _met(a, b, x, keys, k), partial)

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query's arrays, nearest first, then oldest."""
        every = F.flatten(F.collect_list(F.arrays_zip("_far", "_age", "_y")))
        near = found.groupBy(*keys).agg(F.slice(F.array_sort(every), 1, k).alias("_best"))
        return near.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in ("_far", "_age", "_y")])

    open_ = F.lit((1 << 62)).cast("long")
    home = materialise(best(meet(asked.withColumn("bound", open_))), "home")
    bound = home.filter(F.size("_far") == k).select(*keys, F.element_at("_far", k).alias("bound"))
    others = asked.join(bound, list(keys), "left").withColumn("bound", F.coalesce("bound", open_))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query, how far its neighbours can be, and the further cells that it asks.

        The farthest corner of a cell with k known labels is a bound as well, which matters most where
        the query's own cell knows fewer: without it such a query would ask every cell.
        """
        for batch in batches:
            of = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("pool", "cell", "day", "bound", *x)}
            points, bound, rows, cells = np.column_stack([of[c] for c in x]).astype(float), of["bound"].copy(), [], []
            for pool in set(of["pool"].tolist()) & box.keys():
                cell, since, full, low, high = box[pool]
                at = np.flatnonzero(of["pool"] == pool)
                for some in np.array_split(at, -(-len(at) // 256)):
                    day, apart, across = of["day"][some, None], *np.zeros((2, len(some), len(cell)))
                    for j in range(len(x)):
                        below, above = low[None, :, j] - points[some, j, None], points[some, j, None] - high[None, :, j]
                        across += np.minimum(below, above) ** 2
                        apart += np.maximum(np.maximum(below, above), 0.0) ** 2
                    # A little less than the least distance and more than the largest, for what rounding may add.
                    least = np.floor(apart * 1e9) - 1
                    most = np.ceil(np.where(full[None] <= day, across, np.inf).min(axis=1) * (1e9 + 1e-3)) + 1
                    nearer = most < bound[some]
                    bound[some[nearer]] = most[nearer].astype(np.int64)
                    hit = (least <= bound[some, None]) & (since[None] <= day) & (cell[None] != of["cell"][some, None])
                    row, which = np.nonzero(hit)
                    rows.append(some[row])
                    cells.append(cell[which])
            rows, cells = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (rows, cells))
            offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows)))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells[np.argsort(rows, kind="stable")]))
            columns = [pa.array(bound) if c == "bound" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, listed], [*batch.schema.names, "cells"])

    kinds_of = ", ".join(f"`{c}` {kind}" for c, kind in others.dtypes)
    # Written: they are counted by cell before they go there.
    asking = materialise(others.mapInArrow(reach, f"{kinds_of}, cells array<long>").filter("size(cells) > 0"), "asking")
    further = meet(asking.withColumn("cell", F.explode("cells")).drop("cells"))
    merged = best(home.unionByName(further))
    mean = F.aggregate("_y", F.lit(0.0), lambda a, b: a + b) / F.size("_y")
    return merged.select(*keys, mean.alias("_knn"))
