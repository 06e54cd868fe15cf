"""What the two classifiers share: folds, bounded training samples and gradient steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo the number of folds (null: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def sampled_ids(ids: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` distinct ids, those with the least hashes: the same ones in every run."""
    return ids.select(F.col(column).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, slope in slopes.items():
            self.mean[k] += 0.1 * (slope - self.mean[k])
            self.square[k] += 0.01 * (slope * slope - self.square[k])
            mean = self.mean[k] / (1 - 0.9**self.step)
            self.weights[k] -= self.rate * mean / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias of the logistic regression of y (0 or 1) on one number, by Newton steps."""
    design, found = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(30):
        p = sigmoid(design @ found)
        slope = design.T @ (weight * (p - y)) + ridge * found
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2)
        found = found - np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(found[0]), float(found[1])
