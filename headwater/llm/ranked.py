"""Ranked lexical search for a set of items over a trie of restricted document vectors.

Each document keeps only the items' terms, the commonest first, so that documents share
the beginnings of their paths in a trie (an FP-tree). Every subtree knows the largest
count of each term and the least length weight below it. Together these bound the
score of all documents there, and a depth-first search per item leaves out subtrees that
cannot reach its tenth best document so far.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.words import classes, cut, steps
from headwater.session import materialise

BEST = 10  # documents of each item
ITEMS = 20_000  # in a block; each block reads the texts once
LEAF = 48  # documents that a subtree is split above
TREE_ENTRIES = 3_000_000  # terms of the documents that one trie holds; a task may make several
SALTS = 64  # places where an item's documents of all tasks first meet
KINDS = classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
# Capitals are letters: they are lower-cased before the classes are looked up.


def terms_of(texts: list[str | None]) -> list[list[str]]:
    """The different terms of each text, in order."""
    words, word, row, _ = cut(pa.array(texts, pa.string()), KINDS)
    found = [dict() for _ in texts]
    for w, r in zip(word.tolist(), row.tolist()):
        found[r][words[w]] = None
    return [list(f) for f in found]


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms of each text, and the vocabulary's among them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = len(vocabulary) + 1
        for batch in steps(batches, 1):
            words, word, row, _ = cut(batch.column(1), KINDS)
            n = np.bincount(row, minlength=batch.num_rows)
            known = np.array([vocabulary.get(w, -1) for w in words], np.int64)[word] if words else word
            pair, tf = np.unique(row[known >= 0] * base + known[known >= 0], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(batch.num_rows + 1) * base).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (pair % base, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, n long, terms array<int>, tfs array<int>").filter("n > 0")


def part(tf, m):
    """What a term adds to a score, before its weight: grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Node:
    __slots__ = ("begin", "children", "doc", "end", "m", "terms", "tf")


class Tree:
    """The trie of some documents: ranks of terms ascending, counts beside them, m."""

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray):
        order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        self.ranks, self.tfs, self.m = [ranks[i] for i in order], [tfs[i] for i in order], m[self.order]
        self.root = self._build()

    def _build(self) -> Node:
        root, open_, made = self._node(0, len(self.ranks)), [], []
        open_.append((root, 0))
        while open_:
            node, depth = open_.pop()
            made.append(node)
            first, last = self.ranks[node.begin], self.ranks[node.end - 1]
            if node.end - node.begin <= LEAF:
                continue
            same = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:same] != last[depth:same])
            depth = depth + int(differ[0]) if len(differ) else same  # the path that all below share
            if depth == len(last):
                continue  # equal documents: no path parts them
            step = np.array([r[depth] if len(r) > depth else -1 for r in self.ranks[node.begin : node.end]])
            edges = [node.begin, *(node.begin + 1 + np.flatnonzero(np.diff(step))).tolist(), node.end]
            begin = edges[0]
            for at, end in zip(edges, edges[1:]):
                # Small branches side by side make one leaf.
                if end - begin > LEAF and at > begin:
                    node.children.append(self._node(begin, at))
                    begin = at
                if end - begin > LEAF or end == node.end:
                    node.children.append(self._node(begin, end))
                    begin = end
            if len(node.children) == 1:
                node.children = []
            open_ += [(child, depth) for child in node.children]
        for node in reversed(made):  # children before parents
            self._sum_up(node)
        return root

    @staticmethod
    def _node(begin: int, end: int) -> Node:
        node = Node()
        node.begin, node.end, node.children = begin, end, []
        return node

    def _sum_up(self, node: Node) -> None:
        """A leaf's entries by term, or an inner node's largest count of each term; the least m."""
        if node.children:
            terms = np.concatenate([c.terms for c in node.children])
            tf = np.concatenate([c.tf for c in node.children])
        else:
            terms = np.concatenate(self.ranks[node.begin : node.end])
            tf = np.concatenate(self.tfs[node.begin : node.end])
            sizes = [len(r) for r in self.ranks[node.begin : node.end]]
            doc = np.repeat(np.arange(node.end - node.begin), sizes)
        by_term = np.argsort(terms, kind="stable")
        terms, tf = terms[by_term], tf[by_term]
        node.m = int(self.m[node.begin : node.end].min())
        if not node.children:
            node.doc = doc[by_term], terms, tf
        if len(terms):
            heads = np.concatenate(([0], np.flatnonzero(np.diff(terms)) + 1))
            terms, tf = terms[heads], np.maximum.reduceat(tf, heads)
        node.terms, node.tf = terms, tf

    @staticmethod
    def _bound(node: Node, terms: np.ndarray, weights: np.ndarray) -> int:
        """No document below scores more: every term at its largest count, with the least m."""
        if not len(node.terms):
            return 0
        at = np.minimum(np.searchsorted(node.terms, terms), len(node.terms) - 1)
        hit = node.terms[at] == terms
        return int((weights[hit] * part(node.tf[at[hit]], node.m)).sum())

    def _leaf(self, node: Node, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        doc, sorted_terms, tf = node.doc
        begin, end = np.searchsorted(sorted_terms, terms), np.searchsorted(sorted_terms, terms, "right")
        sizes = end - begin
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        scores = np.zeros(node.end - node.begin, np.int64)
        np.add.at(scores, doc[at], np.repeat(weights, sizes) * part(tf[at], self.m[node.begin : node.end][doc[at]]))
        return scores

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, keys: list, limit: int) -> int:
        """Bring `best`, ascending (-score, key of the document), up to date; returns leaves read."""
        open_, read = [(self._bound(self.root, terms, weights), self.root)], 0
        while open_:
            bound, node = open_.pop()
            if bound <= 0 or len(best) == limit and bound < -best[-1][0]:
                continue
            if node.children:
                # The most promising child last, so that it is the next.
                open_ += sorted(((self._bound(c, terms, weights), c) for c in node.children), key=lambda x: x[0])
                continue
            read += 1
            scores = self._leaf(node, terms, weights)
            least = max(1, -best[-1][0]) if len(best) == limit else 1
            for i in np.flatnonzero(scores >= least).tolist():
                entry = -int(scores[i]), keys[self.order[node.begin + i]]
                if len(best) < limit or entry < best[-1]:
                    insort(best, entry)
                    del best[limit:]
        return read


def search(docs: DataFrame, items: DataFrame, limit: int = BEST, items_per_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `limit` documents of the highest score above 0.

    All rows of `docs` compete. Equal scores rank by ascending doc_id, NULL ids last;
    rows that share a doc_id each have a place. NULL and empty texts have no terms: such documents rank
    nowhere, such items find nothing. Rows of `items` that repeat count once; texts that
    share an item_id are found for together, with the terms of all. Other columns are ignored.
    """
    rows = items.select("item_id", "text").distinct()
    blocks = -(-rows.count() // items_per_block)
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    found = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for number in range(blocks):
        chosen = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        found = found.unionByName(_search_block(docs, chosen.toArrow(), limit, found.schema))
    return found


def _search_block(docs: DataFrame, chosen: pa.Table, limit: int, schema) -> DataFrame:
    of_item: dict = {}
    for item, terms in zip(chosen["item_id"].to_pylist(), terms_of(chosen["text"].to_pylist())):
        of_item.setdefault(item, {}).update(dict.fromkeys(terms))
    names = pa.array(list(of_item), chosen["item_id"].type)
    vocabulary: dict[str, int] = {}
    wanted = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64) for terms in of_item.values()]
    vector = materialise(vectors(docs, vocabulary), "vectors")
    total = vector.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    count, length = total["docs"], total["terms"] or 1
    # One count per term of the block: bounded by the block's vocabulary.
    counted = vector.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for row in counted:
        df[row["term"]] = row["df"]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))  # the commonest term first
    weight = [math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()]
    queries = [(rank[t], np.array([weight[i] for i in t], np.int64)) for t in wanted]
    id_type = schema["doc_id"].dataType.simpleString()

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        keys, ranks, tfs, sizes = [], [], [], []

        def flush():
            tree = Tree(ranks, tfs, 10 + 90 * np.array(sizes, np.int64) * count // length)
            for (terms, weights), some in zip(queries, best):
                tree.search(terms, weights, some, keys, limit)

        held, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            edges = batch.column(2).offsets.to_numpy()
            terms, tf = rank[batch.column(2).values.to_numpy()], batch.column(3).values.to_numpy().astype(np.int64)
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                begin, end = edges[i], edges[i + 1]
                if begin == end:
                    continue
                by_rank = np.argsort(terms[begin:end])
                keys.append((doc is None, doc))
                ranks.append(terms[begin:end][by_rank])
                tfs.append(tf[begin:end][by_rank])
                sizes.append(n)
                held += end - begin
                if held >= TREE_ENTRIES:
                    flush()
                    keys, ranks, tfs, sizes, held = [], [], [], [], 0
        if keys:
            flush()
        out = [(i, key[1], -score) for i, some in enumerate(best) for score, key in some]
        if out:
            item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    found = vector.mapInArrow(seek, f"item int, doc_id {id_type}, score long")
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    # An item's finds of all tasks meet in SALTS places first, then its best of each.
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("place") <= limit)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= limit)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([names.take(batch.column(0)), *batch.columns[1:]], ["item_id", "rank", "doc_id", "score"])

    return found.select("item", "rank", "doc_id", "score").mapInArrow(name, schema)
