"""Near-duplicate texts by SimHash, found through tables of distances to pivots."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.graph import components
from headwater.session import materialise, unsent

SHINGLE = 4
SEED = 42
DISTANCE = 4  # fingerprints link at so many differing bits or fewer
BLOCKS = 7  # of the 64 bits; BLOCKS - DISTANCE of them agree in any linked pair
PIVOTS = 8  # reference fingerprints


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    over = min(words_per_shingle, len(words)) - 1
    starts, ends = starts[: len(starts) - over].tolist(), ends[over:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        block = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, *keep) -> DataFrame:
    """(doc_id, *keep, fp): one row per row of `docs`; a NULL text counts as empty."""

    @F.pandas_udf("bigint")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select("doc_id", *keep, of_texts("text").alias("fp"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _pivot_values(pivots: int) -> list[int]:
    draw = random.Random(SEED)
    return [_signed(draw.getrandbits(64)) for _ in range(pivots)]


def _within(distance: int, pivots: int):
    """Pairs (a, b) that no pivot tells apart and that then pass the exact count.

    By the triangle inequality two fingerprints at `distance` or less differ by no
    more than that in their distance to any pivot: the largest coordinate
    difference discards the rest before bits are counted.
    """
    near = F.lit(True)
    for i in range(pivots):
        near = near & (F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= distance)
    return near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)


def linked(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """(fp, component) of the distinct values `prints.fp` that link to another value.

    Pivot distances alone keep about half of all pairs each, so pairs are first
    brought together by the bits of `blocks - distance` whole blocks, one of whose
    choices every linked pair agrees on. Values that share a bucket are joined in two
    steps, neither of which lists the pairs of a group of copies: each is linked with
    the least and the greatest value of its bucket where these are near; only buckets
    that then still hold several components are searched for pairs across them,
    through the pivot table. All links count; no bucket is cut.

    A value has a row for each choice of blocks, which Spark's sizes leave out; no join
    of values broadcasts a side.
    """
    reference = _pivot_values(pivots)
    masks = _block_masks(blocks)
    keys = [_signed(sum(masks[i] for i in chosen)) for chosen in itertools.combinations(range(blocks), blocks - distance)]
    fp = F.col("fp")
    table = materialise(prints.select("fp").distinct().select(
        "fp", *(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint").alias(f"p{i}") for i, p in enumerate(reference))), "pivots")
    bucket = F.explode(F.array(*(
        F.struct(F.lit(i).cast("smallint").alias("choice"), fp.bitwiseAND(F.lit(k)).alias("bits")) for i, k in enumerate(keys))))
    spread = table.select("fp", bucket.alias("bucket")).select("fp", "bucket.*")
    ends = spread.groupBy("choice", "bits").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    members = materialise(spread.join(unsent(ends), ["choice", "bits"]), "buckets")

    def to(end: str) -> DataFrame:
        near = F.bit_count(fp.bitwiseXOR(F.col(end))) <= distance
        return members.filter((fp != F.col(end)) & near).select(F.col(end).alias("a"), fp.alias("b"))

    stars = components(to("low").union(to("high")).distinct())
    named = members.join(unsent(stars.withColumnRenamed("node", "fp")), "fp", "left").select(
        "choice", "bits", "fp", F.coalesce("component", "fp").alias("component"))
    mixed = named.groupBy("choice", "bits").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    open_rows = materialise(named.join(unsent(mixed.select("choice", "bits")), ["choice", "bits"]).join(unsent(table), "fp"), "open")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    across = a.join(unsent(b), (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits"))
                    & (F.col("a.component") < F.col("b.component")) & _within(distance, pivots))
    across = components(across.select(F.col("a.component").alias("u"), F.col("b.component").alias("v")).distinct())
    across = across.select(F.col("node").alias("component"), F.col("component").alias("root"))
    lone = across.select(F.col("component").alias("fp"), "component", "root").join(unsent(stars.select(F.col("node").alias("fp"))), "fp", "left_anti")
    joined = stars.withColumnRenamed("node", "fp").join(across, "component", "left").unionByName(lone, allowMissingColumns=True)
    return joined.select("fp", F.coalesce("root", "component").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over fingerprints that differ in
    `distance` bits or fewer. Texts without words have fingerprint 0 and link like
    any other; repeated rows share a component; rows whose component has no doc_id
    get NULL; an empty table gives an empty one. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = materialise(linked(prints, distance, blocks), "linked")
    least = groups.join(unsent(first), "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = first.join(unsent(groups), "fp", "left").join(least, "component", "left")
    named = named.select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(unsent(named), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """`docs` with one row of each component: that of its smallest doc_id.

    Of rows that repeat this doc_id, and of those of a component without doc_ids, the one
    of the least hash of its text stays. Components are told apart by their fingerprints,
    so rows of other components stay whatever their doc_id. Rows stay as they are.
    """
    seal = F.coalesce(F.sha2("text", 256), F.lit(""))
    prints = materialise(fingerprints(docs, seal.alias("seal")), "fingerprints")
    key = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "seal")).alias("least")
    first = prints.groupBy("fp").agg(key)
    groups = materialise(linked(prints, distance, blocks), "linked")
    first = first.join(unsent(groups), "fp", "left").select(F.coalesce("component", "fp").alias("component"), "least.*")
    chosen = first.groupBy("component").agg(key).select("least.doc_id", "least.seal").alias("chosen")
    # The row goes as one value, so no name of a column can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), seal.alias("seal")).alias("rows")
    same = F.col("row.doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("rows.seal") == F.col("chosen.seal"))
    kept = rows.join(unsent(chosen), same, "left_semi").withColumn("doc", F.col("row.doc_id")).dropDuplicates(["doc", "seal"])
    return kept.select("row.*")
