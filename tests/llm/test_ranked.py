"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from headwater.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, limit=10):
    read = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    read = [(d, c) for d, c in read if c]
    count, length = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(terms(text))
    for item, wanted in by_item.items():
        found = []
        for doc, c in read:
            m = 10 + (90 * sum(c.values()) * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:limit], 1)]
    return sorted(out, key=str)


def made(seed, documents=700):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ß9", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(pick.choices(words, weights, k=pick.randint(0, 80)))) for i in range(documents)]
    docs += [(10_000 + i, docs[5][1] + " W3-w3/w59") for i in range(200)]  # copies: equal scores
    docs += [(None, None), (None, "w1 w2 w59 the"), (3, ""), (3, "..."), (4, "w59 " * 3000)]
    items = [(i, " ".join(pick.choices(words, k=12))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "nothing known here"), (None, "w59 w7"), items[0], (1, "w40 more")]


@pytest.mark.parametrize(("seed", "blocks", "entries"), [(1, 20_000, 3_000_000), (2, 4, 900)])
def test_search_equals_all_scores(spark, monkeypatch, seed, blocks, entries):
    docs, items = made(seed)
    monkeypatch.setattr(ranked, "TREE_ENTRIES", entries)
    table = spark.createDataFrame([(*d, 1, "x", 3) for d in docs], "doc_id long, text string, n long, terms string, item_id long").repartition(4)
    found = ranked.search(table, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score long"), items_per_block=blocks)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, items)


def test_subtrees_are_left_out():
    pick = random.Random(3)
    ranks = [np.unique(np.array([pick.randrange(40) for _ in range(pick.randint(1, 12))])) for _ in range(4000)]
    tfs = [np.ones(len(r), np.int64) for r in ranks]
    tree = ranked.Tree(ranks, tfs, np.array([10 + pick.randrange(300) for _ in ranks]))
    leaves, open_ = 0, [tree.root]
    while open_:
        node = open_.pop()
        open_ += node.children
        leaves += not node.children
    best: list = []
    read = tree.search(np.array([1, 2, 39]), np.array([900, 800, 4000]), best, [(False, i) for i in range(4000)], 10)
    assert len(best) == 10 and read < leaves / 2


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "TWO")], "item_id string, text string")
    assert [r["doc_id"] for r in ranked.search(docs, items).orderBy("rank").collect()] == ["a", "b"]
    assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []
