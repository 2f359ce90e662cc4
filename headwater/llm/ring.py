"""Shards of equal row counts by a consistent-hash ring with bounded loads."""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 4096  # places on the ring
VIRTUAL = 64  # places that each shard takes
PARTS = 32  # of a place's rows, sorted apart


def ring(shards: int, points: int = POINTS, virtual: int = VIRTUAL) -> list[int]:
    """The shard that owns each place: that of the first virtual node at it or after it.

    A virtual node whose place is taken moves on to the next free one. A further shard
    adds nodes and moves none.
    """
    virtual = max(1, min(virtual, points // shards))
    node = [-1] * points
    for shard in range(shards):
        for copy in range(virtual):
            at = xxhash.xxh64_intdigest(f"{shard}/{copy}".encode()) % points
            while node[at] >= 0:
                at = (at + 1) % points
            node[at] = shard
    owner, last = [0] * points, next(n for n in node if n >= 0)
    for at in reversed(range(points)):
        last = node[at] if node[at] >= 0 else last
        owner[at] = last
    return owner


def place(counts: dict[int, int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (point, from_rank, to_rank, shard, first_slot) that hold every key.

    Keys stay at home while their shard has room; what is over goes on clockwise to the
    next shard with room. `counts` has an entry per place at most, however many keys.
    """
    used, pieces, over = [0] * len(room), [], []

    def put(point, begin, rows, shard):
        if rows:
            pieces.append((point, begin, begin + rows, shard, used[shard]))
            used[shard] += rows

    for point in sorted(counts):
        shard = owner[point]
        stay = min(counts[point], room[shard] - used[shard])
        put(point, 0, stay, shard)
        if stay < counts[point]:
            over.append((point, stay, counts[point] - stay))
    for point, begin, left in over:
        at = point
        while left:
            at = (at + 1) % len(owner)
            take = min(left, room[owner[at]] - used[owner[at]])
            put(point, begin, take, owner[at])
            begin, left = begin + take, left - take
    return pieces


def shard(docs: DataFrame, shards: int = 24, points: int = POINTS, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    Law `rows`: the bound on a shard's load is its fair share, n // shards or one more,
    so counts differ by one at most and all rows find room. size is the text's bytes
    and 8; a NULL text has none and the checksum of nothing. slot counts a shard's rows
    from 0 without gaps. Rows with equal or NULL doc_id lie side by side on the ring and
    may be parted by a full shard; a place's rows are ranked in PARTS by a hash of the row, each after
    the counts of those before it, so one doc_id is no single sort. An empty table gives an empty one.

    One count per place on the ring (`points`, fixed) reaches the driver; the walk over
    full shards is done on these counts, and rows look up their piece by rank.
    """
    spark = docs.sparkSession
    at = F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 20), F.lit(points)).cast("int")
    counts = {r["point"]: r["n"] for r in docs.groupBy(at.alias("point")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = json.dumps(place(counts, ring(shards, points, virtual)[:], room))
    table = spark.range(1).select(F.explode(F.from_json(F.lit(pieces), "array<array<bigint>>")).alias("p")).select(
        *(F.col("p")[i].alias(c) for i, c in enumerate(("point", "begin", "end", "shard", "first_slot"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), at.cast("bigint").alias("point"),
                       F.pmod(F.xxhash64("doc_id", text), F.lit(PARTS)).alias("part"))
    sizes = rows.groupBy("point", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("point").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A count per place and part of it: points * PARTS rows, whatever the data.
    offsets = sizes.select("point", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("point", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(order).cast("bigint") - 1).join(F.broadcast(offsets), ["point", "part"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("before"))
    # The pieces are a few per place on the ring: a bound that no data moves.
    found = ranked.join(F.broadcast(table), "point").filter("rank >= begin and rank < end")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        (F.col("first_slot") + F.col("rank") - F.col("begin")).alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
