"""The whole pipeline against its stages done by hand."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from headwater.llm import bpe, decontamination, toxicity
from tests.llm.test_text import SCHEMA, brute_groups, prose


def fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def without_passages(texts):
    places = [[m.span() for m in re.finditer(r"\S+", t or "")] for t in texts]
    words = [[t[a:b] for a, b in p] for t, p in zip(texts, places)]
    counts = collections.Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    out = []
    for text, at, w in zip(texts, places, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if counts[tuple(w[i : i + 51])] > 1:
                gone[i : i + 51] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        for begin, end in reversed(list(zip(edges[::2], edges[1::2]))):
            text = text[: at[begin][0]] + text[at[end - 1][1] :]
        out.append(text)
    return out


def leaking(text, items):
    words = [w for w in map(decontamination.plain, (text or "").split())]
    ids = {}
    number = np.array([ids.setdefault(w, len(ids) + 1) for w in words])
    for item in items:
        wanted = [w for w in map(decontamination.plain, (item or "").split()) if w]
        if wanted and len(number):
            score = decontamination.align(number, np.array([ids.get(w, 0) or -1 - i for i, w in enumerate(wanted)]))[0]
            if score >= 0.6 * len(wanted):
                return True
    return False


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    draw = random.Random(5)
    clean, bad = prose(61, 150, length=70), [t.replace(" ", " scumbag ", 3) + " rotten scumbag" for t in prose(62, 60, length=70)]
    passage, item = prose(63, 1, length=60)[0], prose(64, 1, length=25)[0]
    texts = clean + bad
    labels = [(i, 1, int(i >= 150)) for i in range(len(texts))]
    texts += [f"{t} {passage} {u}" for t, u in zip(prose(65, 6), prose(66, 6))]
    texts += [f"{prose(67, 1)[0]} {item}", " ".join(w if i % 6 else "changed" for i, w in enumerate(item.split())), *clean[:4], clean[7].replace(" ", "  "), None, "", "short"]
    draw.shuffle(labels)
    ids = [*range(len(texts) - 2), 3, None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)

    table = spark.read.parquet(f"{folder}/documents.parquet")
    score = {r.text: r.predicted for r in toxicity.scores(table.withColumn("doc_id", F.col("doc_id")), spark.read.parquet(f"{folder}/labels.parquet")).join(
        table, "doc_id").collect() if r.doc_id is not None}
    rows = [(i, t) for i, t in zip(ids, texts) if not score.get(t, 0)]
    assert {t for _, t in rows}.isdisjoint(bad) and set(clean) <= {t for _, t in rows}
    order = {i: k for k, i in enumerate(sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)))}
    groups = brute_groups([fingerprint(t) for _, t in rows], [order[k] for k in range(len(rows))], 4)
    rows = [rows[k] for k in range(len(rows)) if groups[k] == order[k]]
    rows = list(zip([i for i, _ in rows], without_passages([t for _, t in rows])))
    rows = [(i, t) for i, t in rows if not leaking(t, [item, None])]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in rows:
        tokens = library.encode_ordinary(text or "")
        want.append((i, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
