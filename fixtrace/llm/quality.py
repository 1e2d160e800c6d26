"""Quality by compression (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtrace.llm.compression import SizeMeter, dictionary, excerpts
from fixtrace.llm.learning import Logistic, class_counts, labelled_sample, with_texts

#: The pieces, in bytes, in which a text is compressed, with zstandard's level; 0 is the whole text.
PIECES = ((256, 6), (0, 3))


class QualityModel:
    """Two dictionaries and the calibration of what they make of a text."""

    def __init__(self, bad: bytes, good: bytes):
        self.contents, self.prior, self.fit, self.meters = [bad, good], 0.5, None, None

    def __getstate__(self):  # compressors are built where they are used
        return self.__dict__ | {"meters": None}

    def features(self, text: str | None) -> list[float]:
        """Normalised size differences, by piece size, and the logarithm of the compression ratio."""
        if self.meters is None:
            self.meters = [SizeMeter(self.contents, level, piece) for piece, level in PIECES]
        raw = (text or "").encode("utf-8", "surrogatepass")
        found = []
        for meter in self.meters:
            bad, good = meter.sizes(raw)
            found.append((bad - good) / (bad + good + 16.0))
        return [*found, float(np.log((min(bad, good) + 16.0) / (len(raw) + 16.0)))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), self.prior)
        return self.fit.chances(np.array([self.features(t) for t in texts], dtype=float).reshape(len(texts), 3))


def _feature_rows(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, dictionary_bytes: int = 131072, excerpt: int = 600,
                fit_rows: int = 4000) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality): 1 is good, 0 is bad, others and nulls are left out.

    The dictionaries are excerpts of a bounded sample of each class; the calibration is a logistic regression on
    about ``fit_rows`` other rows of each class, whose features are computed on the executors. Labels are
    counted and sampled before they meet the texts, so no text is shuffled. Without rows of both classes the model
    gives every text the smoothed share of good rows.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    counts = class_counts(rows, "quality")
    side = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2))
    per_class = 2 * dictionary_bytes // excerpt
    known = labelled_sample(rows.filter(side == 0), "quality", _half(counts), per_class, 1)
    parts = excerpts(with_texts(docs, known, 4 * per_class), "quality", excerpt).collect()
    parts.sort(key=lambda r: (r["doc_id"], r["excerpt"]))
    contents = [dictionary((r["excerpt"] for r in parts if r["value"] == q), dictionary_bytes) for q in (0, 1)]
    model = QualityModel(*contents)
    sample = with_texts(docs, labelled_sample(rows.filter(side == 1), "quality", _half(counts), fit_rows, 2), 4 * fit_rows)
    found = sample.select("text", "quality").mapInArrow(_feature_rows(model), "x array<double>, y int").toPandas()
    found = found.sort_values("x", key=lambda c: c.map(tuple))  # tasks end in any order, sums should not
    labels_ = found["y"].to_numpy(dtype=float)
    bad, good = counts.get(0, 0), counts.get(1, 0)
    model.prior = float((good + 1) / (good + bad + 2))
    if contents[0] and contents[1] and 0 < labels_.sum() < len(labels_):
        model.fit = Logistic(np.array(found["x"].tolist(), dtype=float), labels_)
        # The sample holds the classes in other shares than the labels do: move the intercept accordingly.
        model.fit.weights[-1] += np.log(good / bad) - np.log(labels_.sum() / (len(labels_) - labels_.sum()))
    return model


def _half(counts: dict) -> dict:
    return {value: max(1, n // 2) for value, n in counts.items()}


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the chance that the text is good, from 0 to 1.

    Whole texts are scored. A null text counts as empty; an empty one gets the score of size differences of
    zero. Rows are independent, so ties, repeats and an empty table need no rule. A column already named
    ``name`` is replaced.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return docs.withColumn(name, score(F.col(text)))
