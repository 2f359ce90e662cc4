"""Passages of test items in training texts: rare seeds, then local alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.words import classes, cut, steps
from headwater.session import materialise, unsent

SIMILARITY = 0.6  # of the alignment score to that of an exact copy
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
ITEMS = 20_000  # test items in a block; each block reads the texts twice
SALTS = 16  # places that documents of one passage are dealt out to
EDGE = re.compile(r"^\W+|\W+$")
MARKS = ".,;:!?"
HITS = 3  # seeds that a passage holds; short items have fewer
HELD_WORDS = 150_000  # words that a task keeps numbered; more only cost time
SPACES = classes(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")


def plain(word: str) -> str:
    return EDGE.sub("", word.lower())


class Block:
    """Test items as numbers of their words."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.names, self.words = [], []
        for item, text in items:
            words = [w for w in map(plain, (text or "").split()) if w]
            if words:
                self.names.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))

    def number(self, word: str) -> int:
        """The number of a word as it stands in a text, 0 for one of no item; -1 if white space parts it."""
        if word.isalnum():
            return self.vocabulary.get(word.lower(), 0)
        if word[:-1].isalnum() and word[-1] in MARKS:
            return self.vocabulary.get(word[:-1].lower(), 0)
        if len(word.split()) != 1:
            return -1
        return self.vocabulary.get(plain(word), 0)

    def ids(self, column: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word of the texts, 0 for words of no item, its row, its place in the row)."""
        words, word, row, _ = cut(column, SPACES)
        found = list(map(known.get, words))
        odd: dict[int, list[int]] = {}  # words with white space that is no single byte
        for i, number in enumerate(found):
            if number is None:
                number = found[i] = self.number(words[i])
                if number < 0:
                    odd[i] = [self.number(w) for w in words[i].split()]
                    found[i] = 0
                elif len(known) < HELD_WORDS:
                    known[words[i]] = number
        ids = np.array(found, np.int32)[word] if words else np.empty(0, np.int32)
        if odd:
            parts = [odd.get(w, [n]) for w, n in zip(word.tolist(), ids.tolist())]
            row = np.repeat(row, [len(p) for p in parts])
            ids = np.array([n for p in parts for n in p], np.int32)
        first = np.searchsorted(row, np.arange(len(column)))
        return ids, row, np.arange(len(ids)) - first[row] if len(ids) else row

    def needed(self, similarity: float, hits: int = HITS) -> np.ndarray:
        """How many seeds of each item a passage must hold."""
        return np.array([min(hits, math.ceil(similarity * len(w) - 1e-9)) for w in self.words], np.int64)

    def seeds(self, counts: np.ndarray, similarity: float, hits: int = HITS) -> dict[int, list[int]]:
        """The items that each word leads to: for every item the rarest of its words, by `counts`.

        A passage that scores `similarity` has at least that share of the item's words. So if all but
        that many are seeds, and `needed` more, it holds as many seeds at least, whatever its edits.
        """
        found: dict[int, list[int]] = {}
        for i, (words, need) in enumerate(zip(self.words, self.needed(similarity, hits).tolist())):
            spared = max(0, math.ceil(similarity * len(words) - 1e-9) - need)
            order = np.lexsort((words, counts[words]))
            for word in np.unique(words[order[: len(words) - spared]]).tolist():
                found.setdefault(word, []).append(i)
        return found


def reach(size: int, similarity: float) -> int:
    """Words of text that a passage scoring `similarity` can span at most."""
    return size + int((1 - similarity) * size / -GAP + 1e-9)


def bound(hits: np.ndarray) -> float:
    """No alignment in a text scores more than its best stretch does if every word of the item counts
    as a match wherever it stands, and every other word as the cheapest edit."""
    total = np.cumsum(np.where(hits, MATCH, max(MISMATCH, GAP)))
    return float((total - np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))).max())


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: the best score and the passage [begin, end) that has it."""
    steps_ = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1)
    above_from = steps_.copy()
    best = 0.0, 0, 0
    for word in item:
        gain = np.where(text == word, MATCH, MISMATCH)
        here, origin = np.zeros(len(text) + 1), steps_.copy()
        for value, start in ((above[:-1] + gain, above_from[:-1]), (above[1:] + GAP, above_from[1:])):
            better = value > here[1:]
            here[1:][better], origin[1:][better] = value[better], start[better]
        # Gaps along the text: the running maximum of what a gap costs to reach here.
        gone = here - GAP * steps_
        top = np.maximum.accumulate(gone)
        source = np.maximum.accumulate(np.where(gone >= top, steps_, 0))
        by_gap = top + GAP * steps_
        better = by_gap > here
        here[better], origin[better] = by_gap[better], origin[source[better]]
        if here.max() > best[0]:
            end = int(here.argmax())
            best = float(here[end]), int(origin[end]), end
        above, above_from = here, origin
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_per_block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): test items that texts contain.

    score is the best local alignment against an exact copy's, `similarity` or more;
    first_word and n_words give the passage, the earlier of two that score alike. Words are
    compared in lower case without punctuation at their ends. Nothing is lost on the way to the alignment: seeds are chosen so
    that every such passage holds one (`Block.seeds`), however common all its words are
    and however many documents repeat it; equal passages are aligned once. NULL or empty texts and items have
    none; of repeated items each counts; repeated rows of one doc_id make one row.
    """
    rows = benchmark.select("item_id", "text").filter("item_id is not null").distinct()
    blocks = -(-rows.count() // items_per_block)
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    found = docs.sparkSession.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, score double, first_word long, n_words long")
    for number in range(blocks):
        chosen = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        found = found.unionByName(_block_leaks(docs, chosen.toArrow(), similarity, found.schema))
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "n_words")).alias("m")
    best = found.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "m.score", (-F.col("m.at")).alias("first_word"), "m.n_words")


def _block_leaks(docs: DataFrame, chosen: pa.Table, similarity: float, schema) -> DataFrame:
    block = Block(list(zip(chosen["item_id"].to_pylist(), chosen["text"].to_pylist())))
    names = pa.array(block.names, chosen["item_id"].type)
    id_type = schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(len(block.vocabulary) + 1, np.int64), {}
        for batch in steps(batches, 1):
            total += np.bincount(block.ids(batch.column(1), known)[0], minlength=len(total))
        at = np.flatnonzero(total[1:]) + 1
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    # One count per word of the block: bounded by the block's vocabulary.
    counted = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(block.vocabulary) + 1, np.int64)
    for row in counted:
        counts[row["word"]] = row["n"]
    seeded = {w: np.array(items, np.int64) for w, items in block.seeds(counts, similarity).items()}
    is_seed = np.zeros(len(counts), bool)
    is_seed[list(seeded)] = True
    need = block.needed(similarity) if block.words else np.ones(1, np.int64)
    spans = np.array([reach(len(w), similarity) for w in block.words] or [0])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, known = np.zeros(len(counts), bool), {}
        for batch in steps(batches, 1):
            ids, row, place = block.ids(batch.column(1), known)
            at = np.flatnonzero(is_seed[ids])
            many = np.array([len(seeded[w]) for w in ids[at].tolist()], np.int64)
            item = np.concatenate([seeded[w] for w in ids[at].tolist()]) if len(at) else at
            at = np.repeat(at, many)
            order = np.lexsort((at, item, row[at]))
            at, item = at[order], item[order]
            # Only where the last of the needed seeds is as near to the first as a passage reaches.
            last = np.arange(len(at)) + need[item] - 1 if len(at) else at
            first = np.flatnonzero(last < len(at))
            last = last[first]
            near = (item[last] == item[first]) & (row[at[last]] == row[at[first]]) & (at[last] - at[first] < spans[item[first]])
            at, item = at[first[near]], item[first[near]]
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            begin = np.maximum(at - spans[item] + 1, edge[row[at]])
            end = np.minimum(at + spans[item], edge[row[at] + 1])
            # Stretches of one item that overlap are one.
            new = np.ones(len(at), bool)
            new[1:] = (item[1:] != item[:-1]) | (row[at[1:]] != row[at[:-1]]) | (begin[1:] >= end[:-1])
            heads = np.flatnonzero(new)
            out = []
            for k, last in zip(heads.tolist(), [*(heads[1:] - 1).tolist(), len(at) - 1]):
                a, b, i = int(begin[k]), int(end[last]), int(item[k])
                words = block.words[i]
                mark[words] = True
                hits = mark[ids[a:b]]
                mark[words] = False
                if np.count_nonzero(hits) >= similarity * len(words) - 1e-9 and bound(hits) >= similarity * MATCH * len(words) - 1e-9:
                    # Words of other items are any words here: more passages are equal.
                    out.append((int(row[a]), i, int(place[a]), np.where(hits, ids[a:b], 0)))
            if out:
                rows, items, places, passages = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(items, pa.int32()), pa.array(places, pa.int64()),
                     pa.array(passages, pa.list_(pa.int32()))], ["doc_id", "item", "at", "ids"])

    regions = materialise(texts.mapInArrow(seek, f"doc_id {id_type}, item int, at long, ids array<int>"), "regions")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for k, item in enumerate(batch.column(0).to_pylist()):
                words = block.words[item]
                value, begin, end = align(flat[offsets[k] : offsets[k + 1]], words)
                if value >= similarity * MATCH * len(words) - 1e-9:
                    row.append(k)
                    out.append((value / (MATCH * len(words)), begin, end - begin))
            kinds = (pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row, pa.int64())) for c in batch.columns), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))],
                ["item", "ids", "score", "begin", "n_words"])

    distinct = regions.groupBy("item", "ids").count().select("item", "ids")
    # Spread anew: what aligns long is not where it was counted.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passages = distinct.repartition(tasks, "item", "ids").mapInArrow(score, "item int, ids array<int>, score double, begin long, n_words long")
    # Back to the documents by 128 bits of hash of the passage: rows of a few numbers.
    seals = F.xxhash64("ids").alias("seal"), F.xxhash64(F.lit("second"), "ids").alias("second")
    passages = materialise(passages.select("item", *seals, "score", "begin", "n_words"), "passages")
    passages = passages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    salt = F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).alias("salt")
    found = regions.select("doc_id", "item", "at", *seals, salt).join(unsent(passages), ["item", "seal", "second", "salt"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(batch.column(1)), *batch.columns[2:]], schema.names)

    return found.select("doc_id", "item", "score", (F.col("at") + F.col("begin")).alias("first_word"), "n_words").mapInArrow(name, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the rows that contain a test item; all others stay as they are. Rows
    are told apart by doc_id and text, so those that share a doc_id have their own verdicts.
    """
    key = F.sha2(F.concat(F.xxhash64("doc_id").cast("string"), F.lit(" "), F.col("text")), 256)
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, similarity)
    # The row goes as one value, so no name of a column can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")
