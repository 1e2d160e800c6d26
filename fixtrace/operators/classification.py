"""Metrics of yes / no answers and of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.functions.text import as_col
from fixtrace.operators.ordering import running_values

EPSILON = 1e-15


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold(score: Column | str, at: float = 0.5, inclusive: bool = True) -> Column:
    """True from (or, not inclusive, above) the given score on."""
    return (as_col(score) >= at) if inclusive else (as_col(score) > at)


def argmax_class(first: Column | str, second: Column | str) -> Column:
    """Class of a two-class score: 1 only if its score is strictly larger."""
    return F.when(as_col(second) > as_col(first), 1).otherwise(0)


def _report() -> list[Column]:
    answer, label = F.col("answer"), F.col("label")
    hit, claimed, real = F.count_if(answer & label), F.count_if(answer), F.count_if(label)
    precision, recall = _share(hit, claimed), _share(hit, real)
    return [
        F.avg(F.when(answer == label, 1.0).otherwise(0.0)).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _share(2 * precision * recall, precision + recall).alias("f1"),
    ]


def classification_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy and precision, recall, F1 of the positive class over boolean answer and label.

    What is undefined counts as 0. With ``keys`` one row per group, such as a training phase.
    """
    return df.groupBy(*(keys or [])).agg(*_report())


def advisory_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(correct_cves, total_cves, cve_accuracy): an advisory is right only if all its answers are."""
    keys = keys or []
    whole = df.groupBy(*keys, "cve").agg(F.bool_and(F.col("answer") == F.col("label")).alias("right"))
    return whole.groupBy(*keys).agg(
        F.count_if("right").alias("correct_cves"), F.count(F.lit(1)).alias("total_cves"),
        F.avg(F.when(F.col("right"), 1.0).otherwise(0.0)).alias("cve_accuracy"))


def result_row(df: DataFrame) -> DataFrame:
    """One summary row per subset and model."""
    keys = ["subset", "model"]
    return advisory_accuracy(df, keys).join(classification_report(df, keys), keys)


def binary_accuracy_f1(df: DataFrame, phase: str = "phase") -> DataFrame:
    return classification_report(df, [phase]).select(phase, "accuracy", "f1")


def confusion_matrix(df: DataFrame) -> DataFrame:
    """(label, answer, n) for all four cells, empty ones with 0."""
    cells = [(False, False), (False, True), (True, False), (True, True)]
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(answer).alias("answer"),
                 F.count_if((F.col("label") == label) & (F.col("answer") == answer)).alias("n"))
        for label, answer in cells])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def roc_auc(df: DataFrame, score: str = "score") -> DataFrame:
    """(auc, positives, negatives): share of (positive, negative) pairs in order, ties half; 0 if one class only.

    Rows are first added up per distinct score; the negatives below each score then are a running sum.
    """
    scores = df.groupBy(score).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    summed = running_values(scores, [], [F.col(score)], {"below": ("sum", F.col("neg"))})
    won = F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2)
    totals = summed.agg(F.sum(won).alias("won"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
                        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.select(_share(F.col("won"), pairs).alias("auc"), "positives", "negatives")


def log_loss(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean negative log-likelihood of the true class."""
    clipped = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    likelihood = F.when(F.col("label") == 1, clipped).otherwise(1 - clipped)
    return df.agg(F.avg(-F.ln(likelihood)).alias("log_loss"))
