"""Joins that bring candidates, texts, scores and verdicts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.operators.ordering import join_small, number_rows

PAIR_KEYS = ["cve", "repo", "commit_id", "label"]


def merged_commits(patches: DataFrame, nonpatches: DataFrame) -> DataFrame:
    """Commits of both tables; a commit in both is taken from the fixes."""
    others = nonpatches.join(patches.select("commit_id"), "commit_id", "left_anti")
    return patches.unionByName(others)


def assemble_pairs(mapping: DataFrame, advisory: DataFrame, patches: DataFrame, nonpatches: DataFrame,
                   strict_group: bool = False) -> DataFrame:
    """Pairs (cve, commit_id, label) with the advisory's description and the commit's columns.

    Pairs with an unknown advisory or commit are dropped, with ``strict_group`` the whole advisory is.
    """
    commits = merged_commits(patches, nonpatches)
    if not strict_group:
        return join_small(mapping.join(commits, "commit_id"), advisory, ["cve"], spread_by=["commit_id"])
    found = mapping.join(commits.withColumn("_found", F.lit(True)), "commit_id", "left")
    broken = found.filter(F.col("_found").isNull()).select("cve").distinct()
    whole = advisory.join(broken, "cve", "left_anti")
    return join_small(found.drop("_found"), whole, ["cve"], spread_by=["commit_id"])


def merge_scores(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Pairs that have both scores."""
    return lexical.join(semantic, PAIR_KEYS)


def attach_similarity(df: DataFrame, scores: DataFrame, how: str = "inner") -> DataFrame:
    """Add similarities to pairs. ``how='left'`` keeps pairs that were not scored."""
    return df.join(scores, ["cve", "owner", "repo", "commit_id", "label"], how)


def commits_with_description(commits: DataFrame, advisory: DataFrame) -> DataFrame:
    """Commits with their advisory's description, null if there is none."""
    return join_small(commits, advisory, ["cve"], "left", spread_by=["commit_id"])


def zip_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Put the columns of two tables side by side by row number; the shorter one is filled with null."""
    return left.join(right, row_id, "full")


def with_row_id(df: DataFrame, order: list[Column], row_id: str = "row_id") -> DataFrame:
    """Row numbers for ``zip_columns`` where a table has none yet."""
    return number_rows(df, order, row_id)


def filter_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def assemble_top(ranked: DataFrame, advisory: DataFrame, patches: DataFrame,
                 nonpatches: DataFrame, k: int = 100) -> DataFrame:
    """Texts for the k best candidates only: the cut comes first, the wide columns last."""
    top = ranked.filter(F.col("rank") <= k)
    return assemble_pairs(top, advisory, patches, nonpatches)


def verdict_join(results: DataFrame, advisory: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts with description and candidate row; verdicts lacking either are dropped.

    Where candidates have a cve, a verdict meets its own pair only, so a commit of two advisories does not multiply.
    """
    described = join_small(results, advisory, ["cve"], spread_by=["commit_id"])
    keys = ["cve", "commit_id"] if "cve" in candidates.columns else ["commit_id"]
    extra = [c for c in candidates.columns if c not in described.columns or c in keys]
    return described.join(candidates.select(*extra), keys)
