"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from headwater.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=10, share=50, limit=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = set()
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * candidates[q] >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates):
                continue
            score, _, l, r = min(((1_000_000 * a * a) // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:limit], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


def made(seed, documents=60):
    pick = random.Random(seed)
    words = ["the", "of", "Élan", "été", "x", "NEW", "york", "city", "a", " b", "ß", "c d"]
    passage = "in the beginning there was one long passage that many rows repeat word by word"
    rows = []
    for i in range(documents):
        parts = [pick.choice(words) + pick.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(pick.randint(0, 120))]
        if i % 3 == 0:
            parts.insert(len(parts) // 2, f" {passage}. ")
        rows.append((i, "".join(parts), pick.choice(["en", "fr", None])))
    return rows + [(None, None, "en"), (99, "", None), (99, "x x x x " * 40, "en"), (99, "x x x x " * 40, "en"), (7, "word " * 30, "only")]


@pytest.mark.parametrize(("seed", "least", "share"), [(1, 10, 50), (2, 3, 50), (3, 10, 90)])
def test_collocations_equal_plain_counts(spark, seed, least, share):
    rows = made(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = phrases.collocations(docs, least=least, share=share)
    assert {tuple(r) for r in found.collect()} == plain(rows, least, share)
    assert plain(rows, least, share)


def test_first_of_each_language(spark):
    rows = made(4)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=3, limit=5)
    assert {tuple(r) for r in found.collect()} == plain(rows, 3, 50, 5)


def test_small_tasks_hand_on_their_edges(spark, monkeypatch):
    rows = made(5)
    monkeypatch.setattr(phrases, "TASK_EDGES", 50)
    monkeypatch.setattr(phrases, "TASK_WORDS", 70)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).coalesce(1), least=3)
    assert {tuple(r) for r in found.collect()} == plain(rows, 3)


def test_crowded_sketch_only_adds_work(spark, monkeypatch):
    rows = made(6)
    monkeypatch.setattr(phrases, "MOST_BITS", 3)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=10)
    assert {tuple(r) for r in found.collect()} == plain(rows, 10)


def test_unary_paths_are_joined(spark):
    rows = [(i, "one two three four five six seven eight nine ten", "en") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    graph = phrases.edges(docs, 10).cache()
    found = phrases.paths(graph, phrases.flows(graph, 10), 10, rounds=30)
    whole = sorted((len(r["words"]), r["n"]) for r in found.collect())
    assert len(whole) < 8 and all(n == 12 for _, n in whole) and sum(size - 2 for size, _ in whole) == 8


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", edge long, a long, n long, words long, rank long")
    assert phrases.collocations(empty).collect() == []
    rows = [(*r, 1, 2, 3, 4, 5) for r in made(7)]
    docs = spark.createDataFrame(rows, empty.schema)
    assert {tuple(r) for r in phrases.collocations(docs).collect()} == plain([r[:3] for r in rows])


def test_packed_counts_are_read_back_and_small():
    pick = np.random.default_rng(1)
    part = np.where(pick.random(1 << 16) < 0.05, pick.integers(1, 4, 1 << 16), 0).astype(np.uint8)
    last = np.zeros(1 << 16, np.uint8)
    last[-1] = 255
    for counts in (part, last, np.full(8, 255, np.uint8)):
        assert (phrases._unpacked_counts(phrases._packed_counts(counts), len(counts)) == counts).all()
    packer = zstandard.ZstdCompressor(level=1)
    assert 1.3 * len(packer.compress(phrases._packed_counts(part))) < len(packer.compress(part.tobytes()))


def test_edges_travel_packed(spark):
    """One row for each task and bucket, and no second shuffle to add up their counts."""
    docs = spark.createDataFrame(made(8), SCHEMA).repartition(2).localCheckpoint()
    graph = phrases.edges(docs, 3)
    plan = graph._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(lang" in plan and "bucket" in plan
    numbers = phrases.Numbers()
    a, b, c = numbers(["en", "fr", "fr"], ["x", "y", "z"]).tolist()
    keys = np.array([a << 42, b << 42 | c << 21, b << 42 | c << 21 | b, c << 42])
    rows = phrases._packed_edges(keys, np.array([1, 20, 3, 4]), numbers, 1).to_pylist()
    assert [(r["lang"], r["a"], r["b"], r["c"], r["n"]) for r in rows] == [("en", "x", "", "", "1"), ("fr", "y y z", "z z ", " y ", "20 3 4")]
