"""Embedding near-duplicates against all cosines, components against union-find, the pipeline as a whole."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from headwater.llm import graph, vectors
from tests.llm.test_text import table


def near_copies(size=400, width=24, groups=6, copies=12, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((size, width))
    more = [v + draw.standard_normal(width) * 0.03 for v in base[:groups] for _ in range(copies)]
    return np.concatenate([base, more, base[:3], base[:1] * 2]).astype(np.float32)


def test_vectors_equal_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 8)  # crowded cells are dealt out in parts
    x = near_copies()
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [None] * 24, 0), (1004, [], 0), (1005, x[0].tolist()[:12], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(7)).repartition(4)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    links = sum(found[i].n_links for i in range(len(x)))
    assert 0.95 * near.sum() <= links <= near.sum()
    assert all(found[i].n_links <= near[i].sum() for i in range(len(x)))
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert np.mean([found[i].component_id == int(np.flatnonzero(reach[i])[0]) for i in range(len(x))]) > 0.98
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(2)
    a = draw.standard_normal((600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((600, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in vectors.near_duplicates(df).collect()) >= 0.9 * 1200


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert found == {n: find(n) for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_keeps_columns_and_clean_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = corpus_pipeline.run(spark, folder).collect()
    left = {r.doc_id for r in rows}
    assert len(left) == len(rows) and 0.5 * before < len(rows) <= before
    toxic = duckdb.sql(f"SELECT doc_id FROM '{folder}/labels.parquet' WHERE toxic = 1").fetchall()
    assert np.mean([d[0] in left for d in toxic]) < 0.2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), folder).count() == 0
