"""Training logs and the classifier heads on fixed embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtrace.operators.ordering import running_values


def early_stop_epoch(log: DataFrame, patience: int) -> DataFrame:
    """(run, epoch): the first epoch that ends ``patience`` epochs in a row without a new best loss.

    A run that never stops early ends with its last epoch. The log has run, epoch and loss.
    """
    order = [F.col("epoch")]
    seen = running_values(log.select("run", "epoch", "loss"), ["run"], order, {
        "best": ("min", F.col("loss")), "number": ("sum", F.lit(1).cast("bigint"))})
    number = F.coalesce("number", F.lit(0)) + 1
    improved = F.col("best").isNull() | (F.col("loss") < F.col("best"))
    numbered = seen.select("run", "epoch", number.alias("number"), F.when(improved, number).alias("improved_at"))
    waited = running_values(numbered, ["run"], order, {"last": ("max", F.col("improved_at"))})
    waiting = F.col("number") - F.greatest("last", "improved_at")
    return waited.groupBy("run").agg(
        F.coalesce(F.min(F.when(waiting >= patience, F.col("epoch"))), F.max("epoch")).alias("epoch"))


def best_checkpoint(log: DataFrame) -> DataFrame:
    """(run, epoch, loss) with the smallest loss, the earliest among equals."""
    best = log.groupBy("run").agg(F.min(F.struct("loss", "epoch")).alias("b"))
    return best.select("run", "b.epoch", "b.loss")


def best_checkpoint_by_metrics(log: DataFrame) -> DataFrame:
    """(run, epoch, recall, mrr): the last checkpoint that beat both metrics of the best one before it.

    The rule needs the checkpoints of a run in order; a run has one row per evaluation step.
    """
    steps = log.groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "recall", "mrr"))).alias("steps"))
    start = F.struct(F.lit(None).cast("bigint").alias("epoch"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("mrr"))
    kept = F.aggregate("steps", start, lambda best, s: F.when(
        (s["recall"] > best["recall"]) & (s["mrr"] > best["mrr"]),
        F.struct(s["epoch"].cast("bigint").alias("epoch"), s["recall"].cast("double").alias("recall"),
                 s["mrr"].cast("double").alias("mrr"))).otherwise(best))
    return steps.select("run", kept.alias("b")).select("run", "b.*")


def fit_pair_classifier(pairs: DataFrame, **params) -> PipelineModel:
    """Head over the description vector and the commit vector of a pair, with a sigmoid on top.

    On fixed embeddings that is a logistic regression. ``pairs`` has desc_vector, commit_vector, label.
    """
    return _fit(_pair_features(pairs), ["desc_features", "commit_features"], params)


def score_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """(cve, commit_id, label, prediction) with the probability of being the fix."""
    scored = model.transform(_pair_features(pairs))
    return scored.select("cve", "commit_id", "label",
                         F.get(vector_to_array("probability"), F.lit(1)).alias("prediction"))


def fit_commit_classifier(df: DataFrame, **params) -> PipelineModel:
    """Head over the pooled embedding of a commit: linear layers without activation are one linear layer."""
    return _fit(df.withColumn("pooled", array_to_vector("embedding")), ["pooled"], params)


def score_commits(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(url, label, prob)."""
    scored = model.transform(df.withColumn("pooled", array_to_vector("embedding")))
    return scored.select("url", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))


def _pair_features(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "desc_features": array_to_vector(F.col("desc_vector").cast("array<double>")),
        "commit_features": array_to_vector(F.col("commit_vector").cast("array<double>"))})


def _fit(df: DataFrame, columns: list[str], params: dict) -> PipelineModel:
    head = LogisticRegression(featuresCol="features", labelCol="label", **{"maxIter": 20, **params})
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), head]).fit(df)
