"""Ranking metrics. All of them reduce each advisory to one row first, with partial sums per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.operators.ordering import join_small, rank_within


def _positive() -> Column:
    return F.col("label") == 1


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))


def _per_k(df: DataFrame, ks: list[int], columns) -> DataFrame:
    """One row per k out of a single pass; ``columns(k)`` gives the aggregates."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *columns(k)) for k in ks])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def average_positive_rank(ranked: DataFrame) -> DataFrame:
    """(cve, avg_rank): mean rank of the fixes, null for an advisory without any."""
    return ranked.groupBy("cve").agg(F.avg(F.when(_positive(), F.col("rank"))).alias("avg_rank"))


def rank_info(ranked: DataFrame) -> DataFrame:
    return ranked.select("cve", "rank", "label")


def hit_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """(hits, advisories, ratio): advisories with a fix in their first k."""
    hit = F.max(F.when(_positive() & (F.col("rank") <= k), 1).otherwise(0))
    return (
        ranked.groupBy("cve").agg(hit.alias("hit"))
        .agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("advisories"), F.avg("hit").alias("ratio"))
    )


def recall_at_k_avg_rank(ranks: DataFrame, ks: list[int] = K.RANK_KS) -> DataFrame:
    """(k, recall): share of advisories whose average fix rank is at most k."""
    return _per_k(ranks, ks, lambda k: [
        F.avg(F.when(F.col("avg_rank") <= k, 1.0).otherwise(0.0)).alias("recall")])


def mrr_avg_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(1 / F.col("avg_rank")).alias("mrr"))


def manual_effort_avg_rank(ranks: DataFrame, ks: list[int] = K.RANK_KS) -> DataFrame:
    """(k, manual_effort): mean of the average fix rank, at most k per advisory."""
    return _per_k(ranks, ks, lambda k: [
        F.avg(F.least(F.col("avg_rank"), F.lit(float(k)))).alias("manual_effort")])


def _advisories(ranked: DataFrame, ks: list[int], hit, effort=None) -> DataFrame:
    """One row per advisory: number of fixes, fixes hit per k, best rank, sum of reciprocal ranks."""
    per_k = [F.count_if(_positive() & hit(k)).alias(f"hit{k}") for k in ks]
    if effort:
        per_k += [F.sum(F.when(_positive(), effort(k))).alias(f"effort{k}") for k in ks]
    return ranked.groupBy("cve").agg(
        F.count_if(_positive()).alias("positives"),
        F.min(F.when(_positive(), F.col("rank"))).alias("best"),
        F.sum(F.when(_positive(), 1 / F.col("rank"))).alias("reciprocals"), *per_k)


def ranking_metrics_zero_based(ranked: DataFrame, ks: list[int] = K.RANK_KS) -> DataFrame:
    """(k, recall, manual_effort, mrr) with ranks counted from 0.

    Per advisory: share of its fixes with rank < k, mean of min(rank, k) and of 1 / (rank + 1) over its
    fixes. An advisory without fix counts as 0 in all three.
    """
    advisories = _advisories(ranked, ks, lambda k: F.col("rank") <= k,
                             lambda k: F.least(F.col("rank") - 1, F.lit(k)))
    positives = F.col("positives")
    return _per_k(advisories, ks, lambda k: [
        F.avg(_share(F.col(f"hit{k}"), positives)).alias("recall"),
        F.avg(_share(F.col(f"effort{k}"), positives)).alias("manual_effort"),
        F.avg(_share(F.col("reciprocals"), positives)).alias("mrr")])


def ranking_metrics_first_hit_effort(ranked: DataFrame, ks: list[int] = K.RANK_KS) -> DataFrame:
    """(k, recall, manual_effort, mrr) with ranks counted from 1.

    Effort is the best fix rank below k, else k; at k = 1 it is always 1.
    """
    advisories = _advisories(ranked, ks, lambda k: F.col("rank") <= k)
    positives = F.col("positives")
    return _per_k(advisories, ks, lambda k: [
        F.avg(_share(F.col(f"hit{k}"), positives)).alias("recall"),
        (F.lit(1.0) if k == 1 else
         F.avg(F.least(F.coalesce("best", F.lit(k)), F.lit(k)).cast("double"))).alias("manual_effort"),
        F.avg(_share(F.col("reciprocals"), positives)).alias("mrr")])


def ranking_metrics_first_rr(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(recall, mrr, advisories, undefined): recall at k and reciprocal rank of the first fix.

    Recall is undefined for an advisory without fix; one such advisory makes the mean null.
    """
    advisories = _advisories(ranked, [k], lambda k: F.col("rank") <= k)
    undefined = F.count_if(F.col("positives") == 0)
    return advisories.agg(
        F.when(undefined == 0, F.avg(F.try_divide(F.col(f"hit{k}"), F.col("positives")))).alias("recall"),
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("best")), F.lit(0.0))).alias("mrr"),
        F.count(F.lit(1)).alias("advisories"), undefined.alias("undefined"))


def grid_search_weight(scored: DataFrame, lambdas: list[float] = K.GRID_LAMBDAS, k: int = 100) -> DataFrame:
    """(weight, hits, advisories, ratio, best): advisories hit at k for each fusion weight.

    The best weight has the highest ratio; among equals the one nearest 1, then the smaller one. Nothing is
    sorted: an advisory is hit if fewer than k candidates come before its best fix, so two aggregations
    over (cve, similarity, f1) do for all weights at once.
    """
    def fused(weight):
        return F.col("similarity") + F.lit(weight) * F.col("f1")

    fixes = scored.filter(_positive())
    # The best fix: highest score, then smallest commit id.
    leaders = fixes.groupBy("cve").agg(*[
        F.min(F.struct((-fused(w)).alias("s"), F.col("commit_id").alias("id"))).alias(f"lead{i}")
        for i, w in enumerate(lambdas)]).select("cve", *[
            c for i in range(len(lambdas))
            for c in ((-F.col(f"lead{i}.s")).alias(f"score{i}"), F.col(f"lead{i}.id").alias(f"id{i}"))])
    compared = join_small(scored.select("cve", "commit_id", "similarity", "f1"), leaders, ["cve"])

    def ahead(i, weight):
        score, best = fused(weight), F.col(f"score{i}")
        return (score > best) | ((score == best) & (F.col("commit_id") < F.col(f"id{i}")))

    before = compared.groupBy("cve").agg(*[
        F.count_if(ahead(i, w)).alias(f"before{i}") for i, w in enumerate(lambdas)])
    advisories = scored.select("cve").distinct().agg(F.count(F.lit(1))).scalar()
    rows = F.array(*[
        F.struct(F.lit(w).alias("weight"), F.count_if(F.col(f"before{i}") < k).alias("hits"))
        for i, w in enumerate(lambdas)])
    table = before.agg(rows.alias("rows"))
    best = F.array_min(F.transform("rows", lambda r: F.struct(
        (-r["hits"]).alias("h"), F.abs(r["weight"] - 1).alias("d"), r["weight"])))["weight"]
    return table.select(best.alias("_best"), F.inline("rows")).select(
        "weight", "hits", advisories.alias("advisories"), (F.col("hits") / advisories).alias("ratio"),
        (F.col("weight") == F.col("_best")).alias("best"))


def rank_by_score(df: DataFrame, group: str, score: str, ties: list[str]) -> DataFrame:
    """Ranks for a table with its own column names; the tie columns have to be unique in a group."""
    return rank_within(df, [group], [F.col(score).desc(), *[F.col(t) for t in ties]])
