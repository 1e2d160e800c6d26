"""Language by compression (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtrace.llm.compression import SizeMeter, dictionary, excerpts
from fixtrace.llm.learning import class_counts, labelled_sample

UNKNOWN = "und"
#: Bytes of a piece; texts of fewer bytes than SHORT get a more thorough search for matches.
PIECE = 1024
SHORT = 512

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, one space between them: signs and case say little about the language."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


class LanguageModel:
    """One raw-content dictionary for each language; the one that leaves the fewest bytes wins."""

    def __init__(self, contents: dict[str, bytes], sharpness: float = 40.0):
        self.names = sorted(n for n, c in contents.items() if c)
        self.contents, self.sharpness, self.meters = [contents[n] for n in self.names], sharpness, None

    def __getstate__(self):  # compressors are built where they are used
        return self.__dict__ | {"meters": None}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Best language, its score and its margin: the share of bytes it saves against the next best."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        if self.meters is None:
            self.meters = (SizeMeter(self.contents, 13, PIECE),
                           SizeMeter(self.contents, 3, PIECE, min_match=3, strategy=zstandard.STRATEGY_LAZY2))
        raw = letters(text)
        sizes = np.maximum(self.meters[len(raw) >= SHORT].sizes(raw), 1.0)
        best = int(np.argmin(sizes))  # of equal sizes the first by name
        rest = np.delete(sizes, best)
        margin = float(1 - sizes[best] / rest.min()) if len(rest) else 1.0
        score = 1 / np.exp(self.sharpness * (sizes[best] - sizes) / sizes[best]).sum()
        return self.names[best], float(score), margin


def fit_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                 dictionary_bytes: int = 65536, excerpt: int = 600) -> LanguageModel:
    """Dictionaries from excerpts of a bounded sample of each language; null texts and languages are left out.

    The sample is about ``2 * dictionary_bytes / excerpt`` texts of each language, chosen by a hash of the id.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sample = labelled_sample(rows, "lang", class_counts(rows.select("lang"), "lang"), 2 * dictionary_bytes // excerpt, 3)
    parts: dict[str, list] = {}
    for row in excerpts(sample, "lang", excerpt).collect():
        parts.setdefault(row["value"], []).append((row["doc_id"], row["excerpt"]))
    return LanguageModel({
        name: dictionary((letters(e).decode("utf-8", "surrogatepass") for _, e in sorted(found)), dictionary_bytes) 
        for name, found in parts.items()})


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = 0.0) -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score (0 to 1), lang_margin, lang_rejected.

    Whole texts are compressed. lang_pred is ``und`` for a text that is null or has no letter, or if no language
    was learned. A margin below ``margin`` marks the row as rejected; lang_pred keeps the nearest language, for
    callers who need one. Of languages that compress equally well the first by name is taken. Columns of the
    four names are replaced.
    """
    @F.pandas_udf("lang_pred string, lang_score double, lang_margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [model.predict(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "lang_score", "lang_margin"])

    found = docs.withColumn("_lang", predict(F.col(text)))
    rejected = (F.col("_lang.lang_pred") == UNKNOWN) | (F.col("_lang.lang_margin") < margin)
    return found.withColumns({"lang_pred": F.col("_lang.lang_pred"), "lang_score": F.col("_lang.lang_score"),
                              "lang_margin": F.col("_lang.lang_margin"), "lang_rejected": rejected}).drop("_lang")
