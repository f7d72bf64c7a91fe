"""Bounded labelled samples and a small logistic regression, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_shares


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled training rows: crc32(doc_id as text) mod 5 is not 0.

    The rows with the least hash of their id are taken, so the sample is spread over the whole table and its
    ids can be broadcast (24 bytes each). Null labels and ids are left out; a repeated id counts once.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    y = fold_shares(y.groupBy("doc_id").agg(F.max("y").alias("y")), 5, "share").where("share <> 0")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return scratch.keep(text.join(F.broadcast(y), "doc_id"), "sample")


class Logistic:
    """Standardised logistic regression by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        k = x.shape[1]
        self.mean = x.mean(0) if len(x) else np.zeros(k)
        self.scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(k)
        self.w = np.zeros(k + 1)
        if len(x) == 0 or y.min() == y.max():
            self.w[0] = 0.0 if len(x) == 0 else (4.0 if y[0] else -4.0)
            return
        z = self._design(x)
        self.w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        pull = np.full(k + 1, ridge)
        pull[0] = 1e-6
        value = self._loss(z, y, self.w, pull)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * self.w)
            size = 1.0
            while size > 1e-4 and self._loss(z, y, self.w + size * step, pull) > value:
                size /= 2
            self.w = self.w + size * step
            value, before = self._loss(z, y, self.w, pull), value
            if before - value < 1e-7 * max(1.0, abs(value)):
                break

    @staticmethod
    def _loss(z, y, w, pull) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - (y * m).sum() + (pull * w * w).sum() / 2)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))
