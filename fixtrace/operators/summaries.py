"""Counts, histograms and result tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.functions.diff import changed_paths
from fixtrace.functions.text import explode_once, extension_of, format_metric
from fixtrace.operators.ordering import join_small, rank_within

METRICS = ["accuracy", "precision", "recall", "f1"]


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_report(before: DataFrame, after: DataFrame, key: str, group: str) -> DataFrame:
    """(group, before, after): distinct keys before and after a step."""
    def counted(df, name):
        return df.groupBy(group).agg(F.count_distinct(key).alias(name))

    return counted(before, "before").join(counted(after, "after"), group, "left").fillna(0, ["after"])


def extension_histogram(commits: DataFrame, diff: str = "diff") -> DataFrame:
    """(extension, files, percent) over all changed files; no extension is called ``none``."""
    files = explode_once(commits, [], changed_paths(diff), "path")
    extension = F.coalesce(F.nullif(extension_of("path"), F.lit("")), F.lit("none"))
    counts = files.groupBy(extension.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    # One row per extension is left here.
    share = F.col("files") * 100.0 / F.sum("files").over(Window.partitionBy(F.lit(0)))
    return counts.select("extension", "files", F.round(share, 1).alias("percent"))


def token_usage(calls: DataFrame, keys: list[str], subtotals: bool = False) -> DataFrame:
    """Input, output and embedding tokens added up per key; with ``subtotals`` also over key prefixes."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c)
            for c in ("input_tokens", "output_tokens", "embedding_tokens")]
    return (calls.rollup(*keys) if subtotals else calls.groupBy(*keys)).agg(*sums)


def folder_sizes(files: DataFrame, limit: int = K.REPO_SIZE_LIMIT) -> DataFrame:
    """(repo, bytes, small): size of all files whose name does not start with ``.git``."""
    counted = files.filter(~F.startswith(F.col("name"), F.lit(".git")))
    total = counted.groupBy("repo").agg(F.sum("size").alias("bytes"))
    return total.withColumn("small", F.col("bytes") < limit)


def mean_pool(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, embedding): element-wise mean. Each task adds up whole vectors before the shuffle."""
    dense = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return dense.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("embedding"))


def duration_stats(df: DataFrame, key: str = "cve") -> DataFrame:
    """Number, mean, median and maximum of the seconds per verdict.

    The median comes from ranks, so no task has to hold all values of a group.
    """
    known = df.filter(F.col("duration").isNotNull()).select(key, "duration")
    stats = known.groupBy(key).agg(
        F.count(F.lit(1)).alias("verdicts"), F.avg("duration").alias("mean"), F.max("duration").alias("longest"))
    placed = join_small(rank_within(known, [key], [F.col("duration")]), stats.select(key, "verdicts"), [key])
    middle = (F.col("verdicts") + 1) / 2
    medians = placed.filter(F.col("rank").isin(F.floor(middle), F.ceil(middle))).groupBy(key).agg(
        F.avg("duration").alias("median"))
    return stats.join(medians, key).select(key, "verdicts", "mean", "median", "longest")


def result_table(results: DataFrame) -> DataFrame:
    """Result rows in print order with formatted metrics and the heights of merged cells.

    ``subset_span`` counts the approaches of a model and subset, ``model_span`` the lines of a model.
    """
    by_subset = results.groupBy("model", "subset").agg(F.count_distinct("approach").alias("subset_span"))
    by_model = by_subset.groupBy("model").agg(F.sum("subset_span").alias("model_span"))
    return (
        results.join(by_subset, ["model", "subset"]).join(by_model, "model")
        .select("model", "subset", "approach", *[format_metric(m).alias(m) for m in METRICS],
                "model_span", "subset_span")
        .orderBy("model", "subset", "approach")
    )


def pivot_metrics(results: DataFrame, approaches: list[str]) -> DataFrame:
    """One row per model and subset, the metrics of each approach side by side."""
    return results.groupBy("model", "subset").pivot("approach", approaches).agg(
        *[F.first(m).alias(m) for m in METRICS])


def narrow_numeric(df: DataFrame) -> DataFrame:
    """(column, from_type, to_type, bytes_before, bytes_after): the smallest type that holds each column.

    A type fits if minimum and maximum lie strictly inside its bounds. One pass over the table.
    """
    ints = [("tinyint", 1, 2 ** 7), ("smallint", 2, 2 ** 15), ("int", 4, 2 ** 31)]
    known = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
    half, single = 65504.0, 3.4028234663852886e38
    numeric = [(f.name, f.dataType.simpleString()) for f in df.schema if f.dataType.simpleString() in known]
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c, _ in numeric])
    rows = []
    for name, kind in numeric:
        lo, hi = F.col(f"`{name}`.lo"), F.col(f"`{name}`.hi")
        if kind in ("float", "double"):
            # The half-precision range still needs a float: there is no smaller type.
            fits = (lo > -single) & (hi < single) | (lo > -half) & (hi < half)
            target, width = F.when(fits, "float").otherwise(kind), F.when(fits, 4).otherwise(known[kind])
        else:
            target, width = F.lit(kind), F.lit(known[kind])
            for smaller, size, bound in reversed(ints):
                if size < known[kind]:
                    fits = (lo > -bound) & (hi < bound - 1)
                    target, width = F.when(fits, smaller).otherwise(target), F.when(fits, size).otherwise(width)
        rows.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("from_type"), target.alias("to_type"),
            (F.col("rows") * known[kind]).alias("bytes_before"), (F.col("rows") * width).alias("bytes_after")))
    return stats.select(F.inline(F.array(*rows)))


def apply_types(df: DataFrame, report: DataFrame) -> DataFrame:
    """Cast the columns as a ``narrow_numeric`` report says (one row per column)."""
    targets = {row["column"]: row["to_type"] for row in report.collect()}
    return df.select(*[F.col(c).cast(targets[c]).alias(c) if c in targets else F.col(c) for c in df.columns])
