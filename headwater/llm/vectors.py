"""Near-duplicate embeddings by counted collisions of sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.graph import components
from headwater.session import materialise

COSINE = 0.95
RECALL = 0.98  # of pairs just at the threshold that share a cell of some table
WIDTH = 2.0  # of a cell along one projection
WINDOW = 0.75  # half-width of a query-centred window
COUNTED = 32  # projections on which collisions are counted
MISSED = 1e-3  # of pairs at the threshold that the count may miss
CROWD = 64.0  # far vectors that a cell may hold by chance
PART = 2_048  # vectors of a cell that are compared in one task with another part
BATCH = 16_384  # rows compared at once, at most by one group more
SEED = 42


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that two points `distance` apart fall in one cell of a random projection."""
    x = width / distance
    normal = 0.5 * (1 + math.erf(x / math.sqrt(2)))
    return 2 * normal - 1 - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def calibrated(count: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """(projections per table, tables, least collisions) for `count` vectors.

    Each further projection thins out a cell's far vectors, so their number follows the
    logarithm of the count and cells stay small at any size; tables make up for the near
    pairs that are parted; the least number of collisions is a binomial quantile.
    """
    near = math.sqrt(2 - 2 * cosine)
    in_window = math.erf(WINDOW / near / math.sqrt(2))
    per_table = max(1, math.ceil(math.log(max(count, 2) / CROWD) / -math.log(same_cell(math.sqrt(2)))))
    one = same_cell(near) ** per_table * in_window
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))
    chance, least = 0.0, 0
    while True:
        chance += math.comb(COUNTED, least) * in_window**least * (1 - in_window) ** (COUNTED - least)
        if chance > MISSED:
            return per_table, tables, least
        least += 1


class Projections:
    """Seeded lines of one dimension: for each table a cell and a sorted value, and counted values."""

    def __init__(self, size: int, per_table: int, tables: int):
        draw = np.random.default_rng([SEED, size])
        self.cells = draw.standard_normal((size, tables * per_table))
        self.offsets = draw.uniform(0, WIDTH, tables * per_table)
        self.values = draw.standard_normal((size, tables))
        self.counted = draw.standard_normal((size, COUNTED))
        self.mix = draw.integers(1, 1 << 62, per_table, dtype=np.int64) | 1
        self.shape = tables, per_table
        self.size = size

    def table_cells(self, units: np.ndarray) -> np.ndarray:
        at = np.floor((units @ self.cells + self.offsets) / WIDTH).astype(np.int64)
        cells = (at.reshape(len(units), *self.shape) * self.mix).sum(axis=2)
        return cells ^ cells >> 31 ^ self.size


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it has no direction."""
    if vector is None or any(v is None for v in vector):
        return None
    values = np.asarray(vector, float)
    if not len(values) or not np.isfinite(values).all() or not values.any():
        return None
    values = values / np.abs(values).max()
    return values / np.sqrt((values * values).sum())


def compare(rows: dict[str, np.ndarray], units: np.ndarray, lines: Projections, least: int, cosine: float):
    """(row a, row b) of linked pairs of one batch, each pair in the first table it meets in only.

    Rows stand in the order of group and value. Step by step each row meets the row s
    places on, while both are in one group and one window. Their collisions on the
    counted projections decide whether the cosine is computed.
    """
    group, table, value, part = (rows[c] for c in ("group", "table", "value", "part"))
    counted, cells, values = units @ lines.counted, lines.table_cells(units), units @ lines.values
    alive, step, found = np.arange(len(group)), 0, []
    while True:
        step += 1
        alive = alive[alive + step < len(group)]
        other = alive + step
        keep = (group[alive] == group[other]) & (value[other] - value[alive] <= WINDOW)
        alive = alive[keep]
        if not len(alive):
            break
        a = alive[(part[alive] != part[alive + step]) | ~rows["crossing"][alive]]
        for k in range(0, COUNTED, 8):
            seen = (np.abs(counted[a, k : k + 8] - counted[a + step, k : k + 8]) <= WINDOW).sum(axis=1)
            hits = seen if k == 0 else hits[kept] + seen
            kept = hits + COUNTED - k - 8 >= least
            a = a[kept]
        a = a[(units[a] * units[a + step]).sum(axis=1) >= cosine]
        b = a + step
        met = (cells[a] == cells[b]) & (np.abs(values[a] - values[b]) <= WINDOW)
        first = ~(met & (np.arange(cells.shape[1]) < table[a][:, None])).any(axis=1)
        found.append((a[first], b[first]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable over the pairs (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def links(classes: DataFrame, count: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (node, n, embedding): (node, links) and the edges (a, b) of a forest.

    Every vector is projected and put into a cell of each table. A cell's vectors are
    sorted along a line of their own and compared within windows. Cells of more than
    PART vectors are dealt out as pairs of parts, so no task holds a crowded cell. Tasks
    return sums per vector and a spanning forest, never the pairs.
    """
    per_table, tables, least = calibrated(count, cosine, recall)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, Projections] = {}
        for batch in batches:
            cells, values = [], []
            for vector in batch.column(2).to_pylist():
                one = unit(vector)
                line = lines.get(len(one)) or lines.setdefault(len(one), Projections(len(one), per_table, tables))
                cells.append(line.table_cells(one[None])[0])
                values.append(one @ line.values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))],
                [*batch.schema.names, "cells", "values"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = materialise(classes.select("node", "n", "embedding").mapInArrow(
        project, f"node long, n long, embedding {kind}, cells array<long>, values array<double>"), "projections")
    spread = placed.select("node", "n", F.posexplode(F.arrays_zip("cells", "values")).alias("table", "at")).select(
        "node", "n", "table", F.col("at.cells").alias("cell"), F.col("at.values").alias("value"))
    sizes = spread.groupBy("table", "cell").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    rows = spread.join(sizes, ["table", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", other).join(placed.select("node", "embedding"), "node").select(
        "table", "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "value", "node", "n", "part", "embedding")
    rows = rows.repartition("table", "cell", "low", "high").sortWithinPartitions("table", "cell", "low", "high", "value", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, Projections] = {}

        def settle(held):
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("table", "cell", "low", "high")]
            size = len(table.column("embedding")[0])
            units = np.stack([unit(v) for v in table.column("embedding").to_pylist()])
            changed = np.zeros(len(units), bool)
            for key in keys:
                changed[1:] |= key[1:] != key[:-1]
            given = {"group": np.cumsum(changed), "table": keys[0], "value": table.column("value").to_numpy(),
                     "part": table.column("part").to_numpy(), "crossing": keys[2] != keys[3]}
            line = lines.get(size) or lines.setdefault(size, Projections(size, per_table, tables))
            a, b = compare(given, units, line, least, cosine)
            n = table.column("n").to_numpy()
            sums = np.bincount(a, n[b], len(units)) + np.bincount(b, n[a], len(units))
            at = np.flatnonzero(sums)
            node = table.column("node").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(sums[at].astype(np.int64)), pa.array(node[_roots(len(units), a, b)[at]])],
                                              ["node", "links", "root"])

        held, rows, last = [], 0, None
        for batch in batches:
            names = ("table", "cell", "low", "high")
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)))
            lengths = pc.list_value_length(batch.column(batch.schema.get_field_index("embedding"))).to_pylist()
            keys = [(*k, size) for k, size in zip(keys, lengths)]
            begin = 0
            for i, key in enumerate(keys):
                if last is not None and key != last and (rows + i - begin >= BATCH or key[-1] != last[-1]):
                    held.append(batch.slice(begin, i - begin))
                    yield settle(held)
                    held, rows, begin = [], 0, i
                last = key
            held.append(batch.slice(begin))
            rows += batch.num_rows - begin
        if held and rows:
            yield settle(held)

    found = materialise(rows.mapInArrow(search, "node long, links long, root long"), "links")
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.select("node", "root")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Rows link at a cosine of `cosine` or more in double precision; none below is linked,
    and a pair at the threshold is found with about the chance `recall`, closer ones
    almost surely. Equal vectors are one class that carries its count; all of a class
    link with one another. Vectors that are NULL, of length zero or hold NULL or a
    non-finite number link with nothing, as do those of different dimensions. Repeated
    vec_ids are separate rows. Classes are told apart by a 64-bit hash of their vector.
    """
    @F.pandas_udf("boolean")
    def directed(column: pd.Series) -> pd.Series:
        return column.map(lambda v: unit(v) is not None).astype(bool)

    rows = vectors.select("vec_id", "embedding").withColumn(
        "node", F.when(directed("embedding"), F.xxhash64("embedding")))
    rows = materialise(rows, "vectors")
    classes = rows.filter("node is not null").groupBy("node", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialise(classes, "classes")
    near, edges = links(classes, classes.count(), cosine, recall)
    groups = materialise(components(edges), "groups")
    least = classes.join(groups, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.select("node", "n", "least").join(near, "node", "left").join(groups, "node", "left").join(least, "component", "left")
    named = named.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    found = rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
