"""Samples of labelled rows and a small logistic model, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values that the sampling fractions refer to.
_HASH_RANGE = 1_000_000


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % parts


def class_counts(rows: DataFrame, label: str) -> dict:
    """Rows of each label value, of the 1,000 most common values."""
    counts = rows.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("rows"))
    return {r["value"]: r["rows"] for r in counts.orderBy(F.desc("rows"), "value").limit(1000).collect()}


def labelled_sample(rows: DataFrame, label: str, counts: dict, per_class: int, seed: int = 0) -> DataFrame:
    """About ``per_class`` rows of each label value: those whose id hashes low enough for the size of their class.

    ``counts`` covers all rows, as ``class_counts`` gives them. The expected number of rows kept is ``per_class`` for
    each value, or all rows of a smaller class. Nothing is shuffled.
    """
    rates = [F.when(F.col(label) == value, F.lit(per_class / n)) for value, n in counts.items()]
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_HASH_RANGE)) / _HASH_RANGE
    return rows.filter(place < F.coalesce(*rates, F.lit(0.0)) if rates else F.lit(False))


def with_texts(docs: DataFrame, sample: DataFrame, most: int) -> DataFrame:
    """Texts of sampled labels; ``most`` is the bound on the sample, which is broadcast. Null texts are left out."""
    few = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(few), "doc_id")


class Logistic:
    """Logistic regression with standardised inputs and a small ridge penalty, fitted by Newton steps."""

    def __init__(self, inputs: np.ndarray, labels: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-9
        design = self._design(inputs)
        self.weights = np.zeros(design.shape[1])
        penalty = ridge * np.eye(design.shape[1])
        penalty[-1, -1] = 1e-9
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(design @ self.weights, -30, 30)))
            slope = design.T @ (labels - chance) - penalty @ self.weights
            bend = (design * (chance * (1 - chance))[:, None]).T @ design + penalty
            step = np.linalg.solve(bend, slope)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, inputs: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((inputs - self.mean) / self.scale, -8, 8), np.ones(len(inputs))])

    def chances(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(inputs) @ self.weights, -30, 30)))
