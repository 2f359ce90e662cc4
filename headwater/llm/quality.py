"""Text quality from the sizes that texts compress to with good and bad dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.learning import TRAINING_ROWS, Logistic, fold, training_rows
from headwater.session import materialise

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
LEVEL = 3
BLOCK = 2048  # bytes compressed at a time: the whole text, block by block
DICTIONARY = 1 << 17  # bytes of each dictionary
EXCERPT = 1024  # bytes of the excerpts that a dictionary is made of, from all over the training texts
FEATURES = 7


def dictionary(excerpts: list[bytes]) -> bytes:
    """Excerpts joined up to DICTIONARY bytes, as raw content: what a kind of text holds."""
    return b"\n".join(excerpts)[-DICTIONARY:] or b"\n" * 8


def excerpts(rows: DataFrame) -> DataFrame:
    """(label, seal, excerpt): whole texts cut into EXCERPT bytes, equal ones once, with their hash."""
    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        whole = [(t or "").encode() for t in texts]
        return pd.Series([[d[i : i + EXCERPT] for i in range(0, len(d), EXCERPT)] for d in whole], dtype=object)

    found = rows.select("label", F.explode(cut("text")).alias("excerpt"))
    return found.select("label", F.xxhash64("excerpt").alias("seal"), "excerpt").dropDuplicates(["label", "seal"])


class Sizer:
    """Compressed sizes of a text's blocks without and with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def packer(data):
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=content, write_content_size=False)

        self.packers = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), packer(good), packer(bad)]

    def features(self, text: str | None) -> list[float]:
        """Normalised size differences over the blocks, plain ratios, and the length."""
        data = (text or "").encode()
        if not data:
            return [0.0] * FEATURES
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        plain, good, bad = (np.array([len(p.compress(b)) for b in blocks], float) for p in self.packers)
        apart = (bad - good) / np.maximum(bad, good)
        total = (bad.sum() - good.sum()) / max(bad.sum(), good.sum())
        size = np.array([len(b) for b in blocks])
        return [total, apart.min(), apart.max(), plain.sum() / size.sum(), (plain / size).min(),
                good.sum() / size.sum(), float(np.log1p(len(data)))]


def scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`, by its text alone.

    The dictionaries and the calibration learn from about `rows` labelled documents outside
    the held-out fold, each for one of the two, from whole texts and in any order of the rows alike. NULL and empty texts score by the
    features of nothing; without labels of both kinds every score is the prior rate.
    Repeated rows score alike; other columns are ignored; an empty table gives an empty one.
    """
    sample = materialise(training_rows(docs, labels, "quality", FOLDS, HELD, rows), "quality")
    builds = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(10))
    # The excerpts of the least hashes: from all parts of all texts, in an order of their own.
    pieces, texts = excerpts(sample.filter(builds < 4)), {}
    for label in (0, 1):
        some = pieces.filter(F.col("label") == label).orderBy("seal", "excerpt").limit(DICTIONARY // EXCERPT)
        texts[label] = dictionary([bytes(r["excerpt"]) for r in some.collect()])

    @F.pandas_udf("array<double>")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(texts[1], texts[0])
        for column in batches:
            yield pd.Series([[float(v) for v in sizer.features(t)] for t in column], dtype=object)

    known = sample.filter(builds >= 4).select("doc_id", "label", of_texts("text").alias("features")).collect()  # numbers only
    known = sorted(known, key=lambda r: str(r["doc_id"]))  # sums do not depend on which task answers first
    model = Logistic(np.array([r["features"] for r in known]).reshape(-1, FEATURES), np.array([r["label"] for r in known], float))

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(features)) if len(features) else [], dtype="float64")

    found = docs.select("doc_id", of_texts("text").alias("features")).withColumn("score", score("features"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
