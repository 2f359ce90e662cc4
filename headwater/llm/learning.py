"""Bounded samples of labelled rows, and a logistic fit on a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 20_000  # labelled rows that a classifier learns from, at most about


def fold(doc_id, folds: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold, about `rows` of them.

    doc_ids are taken by a hash at one rate for both labels, so the sample keeps their
    shares. Of rows that repeat a doc_id the text of the least hash counts, however many
    they are; of labels that do, the larger. NULL labels are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = docs.select("doc_id", "text").join(known, "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("seal"), "text")).alias("least")
    return found.groupBy("doc_id", "label").agg(least).select("doc_id", "least.text", "label")


class Logistic:
    """A ridge-penalised logistic fit by Newton steps on standardised features."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, penalty: float = 1.0):
        self.ready = len(labels) > 0 and 0 < labels.sum() < len(labels)
        self.rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
        if not self.ready:
            return
        self.mean, self.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
        x = self._design(features)
        ridge = penalty * np.eye(x.shape[1])
        ridge[-1, -1] = 1e-9
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):
            p = self._squash(x @ self.weights)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, features):
        return np.column_stack([np.clip((features - self.mean) / self.scale, -8, 8), np.ones(len(features))])

    @staticmethod
    def _squash(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; the prior rate where nothing could be learned."""
        if not self.ready or not len(features):
            return np.full(len(features), self.rate)
        # Row by row, so that a score does not depend on which rows come together.
        return self._squash((self._design(features) * self.weights).sum(axis=1))
