"""Toxicity by a weighted lexicon (operator 3)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtrace.llm.learning import Logistic, class_counts, labelled_sample, with_texts

#: Letters that look like Latin ones, and what they are read as. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ь": "b", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
#: Digits and signs that stand for letters inside a word. Fixed values.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown")

_LETTERS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord("l"): "i"}
_SIGNS = {ord(k): v for k, v in SUBSTITUTES.items()}
_MIXED = re.compile(r"[^\s.,;:?\"()]*[^\W\d_][^\s.,;:?\"()]*")
_NEEDS_SIGNS = re.compile(r"[0-9@$|€]|![^\W\d_]")
_INNER = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W_])|(?<!\S)[@$€|](?=[^\W_])|(?<=[^\W_])[$](?!\S)|[0-9]")
_MARKS = re.compile("[̀-ͯ​-‏­⁠﻿]+")
_GAPS = re.compile(r"[\W_]+")
_RUNS = re.compile(r"([^\W\d_])\1{2,}")


def fold(text: str) -> str:
    """The words of a text with look-alikes made equal, one space before and after each.

    Compatibility forms, case, accents, invisible marks and look-alike letters are folded; ``l`` is read as ``i``,
    as ``1`` stands for both; digits and signs count as letters in words that have a letter; letters that come
    three times or more in a row are read once.
    """
    text = unicodedata.normalize("NFKD", text).casefold()
    if not text.isascii():
        text = _MARKS.sub("", text)
    text = text.translate(_LETTERS)
    if _NEEDS_SIGNS.search(text):
        text = _MIXED.sub(lambda m: _INNER.sub(lambda s: _SIGNS.get(ord(s[0]), s[0]), m[0]), text)
    return " " + _RUNS.sub(r"\1", _GAPS.sub(" ", text)).strip() + " "


class ToxicityModel:
    """Weights of folded words and word beginnings, matched by Aho-Corasick, and the calibration of their sum.

    ``weights`` maps a word to its weight; a word that ends in ``*`` stands for all words that begin so.
    """

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, prior: float = 0.0):
        self.weights, self.prior, self.fit, self.automaton = weights, prior, None, None
        self.exceptions = sorted({fold(e) for e in exceptions} - {" ", "  "})

    def __getstate__(self):  # the automaton is built where it is used
        return self.__dict__ | {"automaton": None}

    def _build(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {e: (len(e), math.nan) for e in self.exceptions}
        for word, weight in self.weights.items():
            pattern = f" {word[:-1]}" if word.endswith("*") else f" {word} "
            entries.setdefault(pattern, (len(pattern), weight))
        for pattern, entry in entries.items():
            self.automaton.add_word(pattern, entry)
        if entries:
            self.automaton.make_automaton()

    def features(self, text: str | None) -> list[float]:
        """Weight found per root of the length, hits, and length of the text."""
        if self.automaton is None:
            self._build()
        folded = fold(text or "")
        words = max(0, folded.count(" ") - 1)
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if weight != weight:
                    harmless.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for start, end in harmless:
            for at in [a for a in best if start <= a < end]:
                del best[at]
        total = sum(best.values())
        return [total / math.sqrt(words + 25.0), math.log1p(total), math.log1p(100.0 * len(best) / (words + 25.0))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), self.prior)
        return self.fit.chances(np.array([self.features(t) for t in texts], dtype=float).reshape(len(texts), 3))


def _word_counts(longest: int):
    """Task function: (text, toxic) to (word, toxic texts, other texts) with the beginnings of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1)):
                words = set(fold(text.as_py()).split())
                starts = {f"{w[:n]}*" for w in words for n in range(4, min(len(w), longest + 1))}
                counts[toxic.as_py()].update(w for w in words if len(w) >= 3)
                counts[toxic.as_py()].update(starts)
            names = sorted(counts[0].keys() | counts[1].keys())
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([counts[1][w] for w in part], pa.int64()),
                     pa.array([counts[0][w] for w in part], pa.int64())], names=["word", "toxic", "other"])

    return run


def _feature_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, sample_rows: int = 5000,
                 words: int = 2000, at_least: int = 3) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); other labels than 0 and 1 and nulls are left out.

    Both lexicon and calibration come from bounded samples of about ``sample_rows`` rows of each class: three quarters
    of the labelled rows give the words, the others the calibration. Labels are counted and sampled before they
    meet the texts, so no text is shuffled. A word or word beginning enters the lexicon with its smoothed log-odds of
    toxic against other texts if at least ``at_least`` toxic texts have it and the log-odds are at least 1.5 even at the
    lower end of their error; the ``words`` strongest stay. A longer beginning that a shorter one already covers is
    dropped.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    counts = class_counts(rows, "toxic")
    bad, good = counts.get(1, 0), counts.get(0, 0)
    prior = (bad + 1) / (bad + good + 20)
    if not bad or not good:
        return ToxicityModel({}, exceptions, prior)
    side = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(4))
    known = labelled_sample(rows.filter(side < 3), "toxic", {v: max(1, 3 * n // 4) for v, n in counts.items()}, sample_rows, 5)
    known = with_texts(docs, known, 4 * sample_rows)
    sizes = class_counts(known, "toxic")
    have = known.select("text", "toxic").mapInArrow(_word_counts(9), "word string, toxic bigint, other bigint")
    odds = (F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) - F.col("toxic") + 0.5))
            - F.log((F.col("other") + 0.5) / (sizes.get(0, 0) - F.col("other") + 0.5)))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    found = (have.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
             .filter(F.col("toxic") >= at_least).withColumn("weight", odds - spread).filter("weight >= 1.5")
             .orderBy(F.desc("weight"), "word").limit(words).select("word", "weight").collect())
    weights: dict[str, float] = {}
    for row in sorted(found, key=lambda r: (len(r["word"].rstrip("*")), not r["word"].endswith("*"), r["word"])):
        word = row["word"]
        shorter = [weights.get(f"{word[:n]}*", 0.0) for n in range(4, len(word.rstrip("*")) + (not word.endswith("*")))]
        if max(shorter, default=0.0) < row["weight"] - 1.0:
            weights[word] = row["weight"]
    model = ToxicityModel(weights, exceptions, prior)
    sample = labelled_sample(rows.filter(side == 3), "toxic", {v: max(1, n // 4) for v, n in counts.items()}, sample_rows, 6)
    sample = with_texts(docs, sample, 4 * sample_rows)
    made = sample.select("text", "toxic").mapInArrow(_feature_rows(model), "x array<double>, y int").toPandas()
    made = made.sort_values("x", key=lambda c: c.map(tuple))  # tasks end in any order, sums should not
    truth = made["y"].to_numpy(dtype=float)
    if 0 < truth.sum() < len(truth):
        model.fit = Logistic(np.array(made["x"].tolist(), dtype=float), truth)
        # The sample holds the classes in other shares than the labels do: move the intercept accordingly.
        model.fit.weights[-1] += np.log(bad / good) - np.log(truth.sum() / (len(truth) - truth.sum()))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the chance that the text is toxic, from 0 to 1.

    Whole texts are scored. A null text counts as empty; an empty one has no hits. Of several entries at one place
    the heaviest counts; entries inside an exception phrase do not. Rows are independent, so ties, repeats and an
    empty table need no rule. A column already named ``name`` is replaced.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return docs.withColumn(name, score(F.col(text)))
