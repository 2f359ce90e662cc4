"""Collocations from a weighted de Bruijn graph of the corpus.

Nodes are pairs of adjacent words, edges triples: the pair that begins a triple leads to
the pair that ends it. Every word of the corpus begins exactly one row of the edge
table: its triple, or what there is of it where its piece ends. So the count of a
shorter phrase is the flow out of its node plus the piece ends there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.words import classes, cut, steps
from headwater.session import materialise

LEAST = 10  # occurrences of a candidate
SHARE = 50  # percent: a phrase goes if a longer candidate around it has this share of its count
LIMIT = 2_000  # phrases of each language
NO_LANG = "und"
KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
MOST_BITS = 25  # of a bucket number of the sketch: 32 MB of counts in a task, 4 MB of bits
SLICE_BITS = 16
TASK_WORDS = (1 << 21) - 4  # distinct words that a task numbers before it hands on its edges, and
TASK_EDGES = 1_000_000  # distinct edges that it holds
SHARES = 16  # buckets that the edges of one first word are dealt to by their second words
SALTS = 16  # places where a language's phrases first meet
ROUNDS = 6  # of path compaction; each joins paths at nodes that only they touch
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _read(batch: pa.RecordBatch) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language and word of each distinct pair, number of the pair of each word of the texts, whether it begins a piece, hashes of the pairs)."""
    langs = batch.column(0).dictionary_encode()
    names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    words, word, row, new = cut(batch.column(1), KINDS)
    distinct, pair = np.unique(word * len(names) + lang_of[row], return_inverse=True)
    lang, word = [names[k] for k in (distinct % len(names)).tolist()], [words[k] for k in (distinct // len(names)).tolist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(f"{a}\t{b}") for a, b in zip(lang, word)], np.uint64)
    return lang, word, pair, new, hashes


def _grams(h: np.ndarray, new: np.ndarray):
    """(whether a pair begins at each word, whether a triple does, hashes of both), from hashes of the words."""
    two, three = np.zeros(len(h), bool), np.zeros(len(h), bool)
    two[:-1] = ~new[1:]
    three[:-2] = ~new[1:-1] & ~new[2:]
    pairs, triples = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    pairs[:-1] = _mixed(h[:-1] * MIX + h[1:])
    triples[:-2] = _mixed(pairs[:-2] * MIX + h[2:])
    return two, three, pairs, triples


class Numbers:
    """Numbers, from 1, of the (language, word) pairs that a task has met."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.of: list[dict[str, int]] = []  # for each language
        self.count = 0

    def __call__(self, lang: list[str], word: list[str]) -> np.ndarray:
        found = np.empty(len(word), np.int64)
        for i, (name, text) in enumerate(zip(lang, word)):
            at = self.langs.get(name)
            if at is None:
                at = self.langs[name] = len(self.of)
                self.of.append({})
            number = self.of[at].get(text)
            if number is None:
                self.count += 1
                number = self.of[at][text] = self.count
            found[i] = number
        return found

    def columns(self) -> tuple[np.ndarray, list[str], pa.Array, np.ndarray]:
        """Language (its place in a list, and these) and word of each number, and a hash of the word; for 0 the empty word, which no text holds."""
        lang, word, crc = np.zeros(self.count + 1, np.int64), [""] * (self.count + 1), np.zeros(self.count + 1, np.int64)
        for name, at in self.langs.items():
            for text, number in self.of[at].items():
                lang[number], word[number], crc[number] = at, text, zlib.crc32(text.encode())
        return lang, list(self.langs), pa.array(word, pa.string()), crc


def _packed_counts(part: np.ndarray) -> bytes:
    """Its counts over 0 with the gaps before them, byte by byte: most gaps take one."""
    at = np.flatnonzero(part)
    gaps = (np.diff(at, prepend=-1) - 1).astype(np.uint16)
    return np.concatenate([(gaps & 255).astype(np.uint8), (gaps >> 8).astype(np.uint8), part[at]]).tobytes()


def _unpacked_counts(data: bytes, size: int) -> np.ndarray:
    low, high, n = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    part = np.zeros(size, np.uint16)
    part[np.cumsum((low | high << 8) + 1) - 1] = n
    return part


def _packed_edges(keys: np.ndarray, n: np.ndarray, numbers: Numbers, buckets: int) -> pa.Table:
    """(lang, bucket, a, b, c, n): a task's edges of each bucket in one row, their words and counts joined by spaces.

    An edge's words alone tell its bucket. Those of one first word stay together, so that it compresses.
    """
    lang, names, word, crc = numbers.columns()
    a, b, c = (keys >> s & (1 << 21) - 1 for s in (42, 21, 0))
    row = lang[a] * buckets + (crc[a] + crc[b] % SHARES) % buckets
    order = np.argsort(row, kind="stable")
    row = row[order]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    edges = pa.array(np.append(begins, len(row)), pa.int64())

    def joined(strings: pa.Array) -> pa.Array:
        return pa.compute.binary_join(pa.LargeListArray.from_arrays(edges, strings.take(pa.array(order))), " ")

    first = row[begins]
    columns = [pa.array([names[k] for k in (first // buckets).tolist()], pa.string()), pa.array(first % buckets)]
    columns += [joined(word.take(pa.array(x))) for x in (a, b, c)] + [joined(pa.array(n).cast(pa.string()))]
    return pa.table(columns, names=["lang", "bucket", "a", "b", "c", "n"])


def _sketch(texts: DataFrame, bits: int, least: int) -> tuple[bytes, bytes]:
    """For pairs and for triples one bit per hash bucket: it holds `least` occurrences or more.

    Buckets are counted over all texts, each task's counts in slices that a shuffle adds
    up. A bucket may be counted up by several phrases, so the bits only ever say too
    much; they are 2 ** `bits` in number whatever the input.
    """
    size = 1 << min(SLICE_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, shift = [np.zeros(1 << bits, np.uint8) for _ in range(2)], np.uint64(64 - bits)
        for batch in steps(batches, 1):
            _, _, pair, new, hashes = _read(batch)
            two, three, pairs, triples = _grams(hashes[pair], new)
            for table, hashes in zip(tables, (pairs[two], triples[three])):
                bucket, n = np.unique(hashes >> shift, return_counts=True)
                bucket = bucket.astype(np.int64)
                table[bucket] = np.minimum(table[bucket] + n, 255)
        packer = zstandard.ZstdCompressor(level=1)
        for kind, table in enumerate(tables):
            for at, part in enumerate(table.reshape(-1, size)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind << 32 | at]), pa.array([packer.compress(_packed_counts(part))], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for at, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = _unpacked_counts(unpacker.decompress(data), size)
                sums[at] = np.minimum(sums[at] + part, 255) if at in sums else part
        for at, total in sums.items():
            full = np.packbits(total >= min(least, 255), bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([full], pa.binary())], ["slice", "counts"])

    schema = "slice long, counts binary"
    parts = texts.mapInArrow(count, schema).repartition(min(64, 2 << max(0, bits - SLICE_BITS)), "slice").mapInArrow(add, schema)
    tables = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(2)]
    for row in parts.collect():  # the bits, at most 2 * 2 ** MOST_BITS of them
        part = np.frombuffer(row["counts"], np.uint8)
        at = (row["slice"] & 0xFFFFFFFF) * size // 8
        tables[row["slice"] >> 32][at : at + len(part)] = part
    return tables[0].tobytes(), tables[1].tobytes()


def edges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, a, b, c, n): how often each row begins at a word of the corpus.

    A row is the triple (a, b, c), the pair (a, b) where its piece ends or the triple is
    too rare, or the word a alone likewise. Counts of words are exact sums over `a`, and so are those of
    pairs and triples that occur `least` times or more; of rarer ones only a part may show.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(12, min(MOST_BITS, (size // 8).bit_length()))
    often = _sketch(texts, bits, least)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, shift, found = Numbers(), np.uint64(64 - bits), []
        tables = [np.frombuffer(t, np.uint8) for t in often]

        def may(table, hashes):
            bucket = hashes >> shift
            return (table[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)

        def rows():
            return _packed_edges(*merged(), numbers, buckets).to_batches(max_chunksize=1_000)

        for batch in steps(batches, 1):
            lang, word, pair, new, hashes = _read(batch)
            two, three, pairs, triples = _grams(hashes[pair], new)
            two &= may(tables[0], pairs)
            three[:-1] &= two[:-1] & two[1:]
            three &= may(tables[1], triples)
            # A text of any length: so many words at a time, and the two after them.
            for at in range(0, len(pair), TASK_EDGES):
                distinct, number = np.unique(pair[at : at + TASK_EDGES + 2], return_inverse=True)
                if found and numbers.count + len(distinct) > TASK_WORDS:
                    yield from rows()
                    numbers, found = Numbers(), []
                number = np.append(numbers([lang[i] for i in distinct], [word[i] for i in distinct])[number], [0, 0])
                size = min(TASK_EDGES, len(pair) - at)
                key = number[:size] << 42
                key |= np.where(two[at : at + size], number[1 : size + 1] << 21, 0)
                key |= np.where(three[at : at + size], number[2 : size + 2], 0)
                found.append(np.unique(key, return_counts=True))
                if sum(len(k) for k, _ in found) > TASK_EDGES:
                    found = [merged()]
                    if len(found[0][0]) > TASK_EDGES:
                        yield from rows()
                        numbers, found = Numbers(), []
        if found:
            yield from rows()

    # Edges travel packed, and unpacked they already lie where their counts add up.
    packed = texts.mapInArrow(collect, "lang string, bucket long, a string, b string, c string, n string").repartition("lang", "bucket")
    each = F.explode(F.arrays_zip(*[F.split(x, " ").alias(x) for x in "abcn"]))
    rows = packed.select("lang", "bucket", each.alias("e")).select("lang", "bucket", "e.*")
    rows = rows.withColumns({x: F.when(F.col(x) != "", F.col(x)) for x in "bc"} | {"n": F.col("n").cast("long")})
    return rows.groupBy("lang", "bucket", "a", "b", "c").agg(F.sum("n").alias("n")).drop("bucket")


def flows(graph: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, a, b, f): nodes and their counts of `least` or more: flow out plus piece ends."""
    return graph.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def paths(graph: DataFrame, nodes: DataFrame, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(lang, words, n, f_first, f_last): edges of `least` or more, unary paths joined to one row.

    A node is unary where one edge takes in, and one takes out, all of its count. Paths
    meet there pairwise: in each round one half of the paths, by a hash, take up their
    successors of the other half. A path's pairs but the first and last occur n times;
    those two occur f_first and f_last times. Any number of rounds gives right counts.
    """
    first = nodes.select("lang", "a", "b", F.col("f").alias("f_first"))
    last = nodes.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_last"))
    found = graph.filter(F.col("c").isNotNull() & (F.col("n") >= least)).join(first, ["lang", "a", "b"]).join(last, ["lang", "b", "c"])
    found = materialise(found.select("lang", F.array("a", "b", "c").alias("words"), "n", "f_first", "f_last"), "paths")
    ends = F.col("n") == F.col("f_last"), F.col("n") == F.col("f_first")
    total = found.count()
    for round_ in range(rounds):
        takes = F.pmod(F.xxhash64(F.slice("words", 1, 2), F.lit(round_)), F.lit(2)) == 0
        left = found.filter(ends[0] & takes).select("lang", F.col("words").alias("head"), F.slice("words", -2, 2).alias("node"), "n", "f_first")
        right = found.filter(ends[1] & ~takes).select("lang", F.col("words").alias("tail"), F.slice("words", 1, 2).alias("node"), F.col("f_last").alias("to"))
        pairs = left.join(right, ["lang", "node"])
        joined = pairs.select("lang", F.concat("head", F.slice("tail", F.lit(3), F.size("tail"))).alias("words"), "n", "f_first", F.col("to").alias("f_last"))
        gone = pairs.select("lang", F.explode(F.array(F.slice("head", 1, 3), F.slice("tail", 1, 3))).alias("edge"))
        stay = found.withColumn("edge", F.slice("words", 1, 3)).join(gone, ["lang", "edge"], "left_anti").drop("edge")
        found = materialise(stay.unionByName(joined), "paths")
        before, total = total, found.count()
        if total > 0.95 * before:
            break
    return found


def _floor_share(a, l, r):
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words.

    Counts go over all texts, overlaps included, within pieces between punctuation and
    line breaks. A phrase of a occurrences is cut where a * a / (l * r) is least, the
    first such cut counting; it goes if a longer candidate around it has `share` percent
    of its count. NULL texts are empty, a NULL lang is `und`, repeated rows count as
    often as they occur; other columns are ignored; an empty table gives an empty one.
    """
    graph = materialise(edges(docs, least), "edges")
    words = materialise(graph.groupBy("lang", F.col("a").alias("word")).agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least)
    nodes = materialise(flows(graph, least), "nodes")
    joined = paths(graph, nodes, least)
    at = F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("at")
    triples = joined.select("*", at).select(
        "lang", F.slice("words", F.col("at") + 1, F.lit(3)).alias("words"), F.col("n").alias("a"),
        F.when(F.col("at") == 0, F.col("f_first")).otherwise(F.col("n")).alias("front"),
        F.when(F.col("at") == F.size("words") - 3, F.col("f_last")).otherwise(F.col("n")).alias("back"))
    triples = materialise(triples, "triples")
    longer = triples.select("lang", "a", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("words"))
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    pairs = nodes.select("lang", F.array("a", "b").alias("words"), F.col("f").alias("a")).join(longer, ["lang", "words"], "left")
    pairs = pairs.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    none = F.lit(None).cast("long")
    every = triples.unionByName(pairs.select("lang", "words", "a", none.alias("front"), none.alias("back")))
    every = every.select("*", F.col("words")[0].alias("one"), F.element_at("words", -1).alias("other"))
    every = every.join(words.select("lang", F.col("word").alias("one"), F.col("f").alias("f_one")), ["lang", "one"])
    every = every.join(words.select("lang", F.col("word").alias("other"), F.col("f").alias("f_other")), ["lang", "other"])
    early = F.coalesce("back", "f_other")
    first, second = _floor_share(F.col("a"), F.col("f_one"), early), _floor_share(F.col("a"), F.col("front"), F.col("f_other"))
    late = F.coalesce(second < first, F.lit(False))
    scored = every.select(
        "lang", F.concat_ws(" ", "words").alias("phrase"), "a", F.when(late, F.col("front")).otherwise(F.col("f_one")).alias("l"),
        F.when(late, F.col("f_other")).otherwise(early).alias("r"), F.when(late, second).otherwise(first).alias("score"))
    order = F.desc("score"), F.desc("a"), "phrase"
    # A language's phrases of all tasks meet in SALTS places first, then the best of each.
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= limit)
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
