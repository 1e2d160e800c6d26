"""Filtering, labelling, deduplication and set operations on commit and advisory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.functions import text as X
from fixtrace.operators.ordering import join_small, top_k


def prune(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns no longer needed, such as raw text after tokenising."""
    return df.drop(*columns)


def add_label(df: DataFrame, label: int) -> DataFrame:
    return df.withColumn("label", F.lit(label).cast("int"))


def select_candidates(df: DataFrame, max_rank: int | None = None, cve: str | None = None,
                      label: int | None = None, limit: int | None = None,
                      order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Candidates up to a rank, of one advisory or with a label; then the first rows and some columns."""
    if max_rank is not None:
        df = df.filter(F.col("rank") <= max_rank)
    if cve is not None:
        df = df.filter(F.col("cve") == cve)
    if label is not None:
        df = df.filter(F.col("label") == label)
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    return df.select(*[c for c in keep if c in df.columns]) if keep else df


def advisory_worklist(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Advisories with a positive candidate, with the repository of their first candidate."""
    work = (
        df.groupBy("cve")
        .agg(F.min_by("repo", "commit_id").alias("repo"), F.max("label").alias("has_fix"))
        .filter(F.col("has_fix") == 1)
        .select("cve", "repo")
    )
    return work.orderBy("cve").limit(limit) if limit is not None else work


def dedupe_keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. Each task keeps one row per key before the shuffle."""
    return top_k(df, key, order, 1, rank="_first").drop("_first")


def first_per_key(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Rows to store by id: those without a value are skipped, the first one per id is kept."""
    return dedupe_keep_first(df.filter(F.col(value).isNotNull()), [key], order)


def resume(df: DataFrame, done: DataFrame | None, keys: tuple[str, ...] = ("cve", "commit_id")) -> DataFrame:
    """Rows not processed yet. No earlier output means nothing is done."""
    if done is None:
        return df
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def mentions_cve(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text names a CVE id."""
    return df.filter(F.size(X.find_cve_ids(column)) > 0)


def length_cutoff(df: DataFrame, column: str, p: float = 0.95) -> DataFrame:
    """Rows whose text is no longer than the exact p-quantile of all lengths.

    Lengths are counted first, so the quantile sees one row per distinct length.
    """
    lengths = df.filter(F.col(column).isNotNull()).groupBy(F.length(column).alias("len")).count()
    cutoff = lengths.agg(F.percentile("len", F.lit(p), F.col("count"))).scalar()
    return df.filter(F.length(column) <= cutoff)


def fill_text(df: DataFrame, columns: list[str], value: str = "") -> DataFrame:
    return df.fillna(value, subset=columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any null; a group that loses all its rows is gone as well."""
    return df.dropna("any")


def patch_commit_rows(ground_truth: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits named by the fix links (cve, urls) of advisories; links to unknown commits are skipped."""
    links = ground_truth.select("cve", F.explode("urls").alias("url"))
    named = links.select("cve", X.commit_hash("url").alias("commit_id")).filter("commit_id is not null")
    return named.join(commits, "commit_id")


def group_advisories_by_repo(ground_truth: DataFrame) -> DataFrame:
    """(repo, cve, repo_cves): repository of each advisory's first fix link and how many share it.

    One row per advisory rather than a list per repository, so a huge repository is no huge row.
    """
    repo = X.github_repo(F.get("urls", F.lit(0)))
    placed = (
        ground_truth.select("cve", F.concat_ws("/", repo["owner"], repo["name"]).alias("repo"))
        .filter(F.col("repo") != "")
    )
    sizes = placed.groupBy("repo").agg(F.count(F.lit(1)).alias("repo_cves"))
    return join_small(placed, sizes, ["repo"]).select("repo", "cve", "repo_cves")


def partitioned_label_maps(df: DataFrame, order: str) -> DataFrame:
    """Commit addresses per partition with the label they had first and the label and language seen last.

    Only the partitions ``train`` and ``test`` make lists, while the last values come from all rows.
    """
    last = df.groupBy("url").agg(
        F.max_by("label", order).alias("last_label"), F.max_by("language", order).alias("last_language"))
    first = (
        df.filter(F.col("partition").isin("train", "test"))
        .groupBy("partition", "url")
        .agg(F.min_by("label", order).alias("label"), F.min(order).alias("first_seen"))
    )
    return first.join(last, "url")


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one table that the other lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
