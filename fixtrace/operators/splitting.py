"""Reproducible samples and splits that keep groups together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.functions.hashing import shuffle_key
from fixtrace.operators.ordering import rank_within, top_k


def sample_negatives(commits: DataFrame, patches: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to n random commits per repository that are not fixes themselves.

    Ids are picked first, so the diffs move once, or not at all where the picks are few.
    """
    ids = commits.select("repo", "commit_id")
    others = ids.join(patches.select("commit_id").distinct(), "commit_id", "left_anti")
    keyed = others.withColumn("_random", shuffle_key(seed, "commit_id"))
    picked = top_k(keyed, ["repo"], [F.col("_random"), F.col("commit_id")], n, rank="_pick")
    return commits.join(picked.select("repo", "commit_id"), ["repo", "commit_id"], "left_semi")


def reservoir_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows, each with the same chance. Fewer rows than n are an error."""
    if n <= 0:
        raise ValueError(f"cannot sample {n} rows")
    rows = df.count()
    if rows < n:
        raise ValueError(f"a sample of {n} rows needs as many, the table holds {rows}")
    keyed, bins = _hash_bins(df, key, seed)
    # Only rows up to the bin that holds the n-th one are moved.
    last = bins.filter(F.col("before") + F.col("n") >= n).agg(F.min("_bin")).scalar()
    picked = keyed.filter(F.col("_bin") <= last)
    return _numbered(picked, bins, key).filter(F.col("_no") <= n).select(*df.columns)


def _hash_bins(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a random order by hash and the bins of that order: rows in each, before it and in all.

    At most 16**3 bins, whatever the number of rows; hashing makes them equally large.
    """
    keyed = df.withColumn("_random", shuffle_key(seed, key)).withColumn("_bin", F.substring("_random", 1, 3))
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).select(
        "_bin", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(everything).alias("total"))
    return keyed, bins


def _numbered(keyed: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Rows with their place in the random order, found bin by bin."""
    inside = Window.partitionBy("_bin").orderBy("_random", key)
    return keyed.join(bins, "_bin").withColumn("_no", F.row_number().over(inside) + F.col("before"))


def _fill_sides(batches: Iterator[pd.DataFrame], p_train: float, p_test: float) -> Iterator[pd.DataFrame]:
    """Walk the weights from large to small; per weight say which stretch of its groups goes where.

    All groups of one weight are placed at once. Stretches: fit into train, fit into test, even out the
    sums, then take turns.
    """
    histogram = pd.concat(list(batches), ignore_index=True)
    if histogram.empty:
        return
    histogram = histogram.sort_values("weight", ascending=False)
    total = int((histogram["weight"] * histogram["groups"]).sum())
    target = {"train": total * p_train, "test": total * p_test}
    filled = {"train": 0, "test": 0}
    rows = []
    for weight, groups in zip(histogram["weight"].tolist(), histogram["groups"].tolist()):
        at = 1

        def place(side, count):
            nonlocal at
            if count > 0:
                rows.append((weight, at, at + count - 1, side, False))
                filled[side] += weight * count
                at += count

        for side in ("train", "test"):
            left = groups - at + 1
            fits = min(left, max(0, int((target[side] - filled[side]) // weight) + 1)) if weight else left
            while fits and filled[side] + fits * weight > target[side]:
                fits -= 1
            place(side, fits)

        left = groups - at + 1
        if left:
            gap = filled["test"] - filled["train"]
            # Enough to the smaller side for it to stop being the smaller one.
            even, lagging = (-(-gap // weight), "train") if gap > 0 else (-gap // weight + 1, "test")
            place(lagging, min(left, even))
            left = groups - at + 1
            if left:
                other = "test" if lagging == "train" else "train"
                rows.append((weight, at, groups, other, True))
                filled[other] += weight * (-(-left // 2))
                filled[lagging] += weight * (left // 2)
    yield pd.DataFrame(rows, columns=["weight", "from_no", "to_no", "side", "turns"])


def weighted_group_split(weights: DataFrame, key: str, p_train: float = 0.8,
                         p_test: float = 0.2) -> DataFrame:
    """(key, weight, side): whole groups go to train or test, the heaviest first, ties by key.

    A group goes to train if it still fits, else to test if it fits, else to the side with the smaller sum.
    Weights are positive integers. The one sequential step runs over the histogram of weights: its rows
    are few, since d different weights need more than d * d / 2 rows in the table they count.
    """
    if p_train + p_test != 1:
        raise ValueError(f"shares of {p_train} and {p_test} do not add up to the whole")
    weights = weights.select(key, F.col("weight").cast("bigint").alias("weight"))
    histogram = weights.groupBy("weight").agg(F.count(F.lit(1)).alias("groups"))
    stretches = histogram.repartition(1).mapInPandas(
        lambda batches: _fill_sides(batches, p_train, p_test),
        "weight bigint, from_no bigint, to_no bigint, side string, turns boolean")
    numbered = rank_within(weights, ["weight"], [F.col(key)], rank="_no")
    second = F.pmod(F.col("_no") - F.col("from_no"), F.lit(2)) == 1
    swapped = F.when(F.col("side") == "train", "test").otherwise("train")
    return (
        numbered.join(stretches, "weight")
        .filter(F.col("_no").between(F.col("from_no"), F.col("to_no")))
        .select(key, "weight", F.when(F.col("turns") & second, swapped).otherwise(F.col("side")).alias("side"))
    )


def train_test_validation(weights: DataFrame, key: str) -> DataFrame:
    """(key, weight, split): 80 percent train; the first half of the rest is test, the other validation."""
    outer = weighted_group_split(weights, key, 0.8, 0.2)
    held_out = outer.filter(F.col("side") == "test").select(key, "weight")
    inner = weighted_group_split(held_out, key, 0.5, 0.5)
    named = inner.select(key, "weight", F.when(F.col("side") == "train", "test")
                         .otherwise("validation").alias("split"))
    return outer.filter(F.col("side") == "train").select(key, "weight", F.col("side").alias("split")).unionByName(named)


def random_group_split(df: DataFrame, key: str, p_train: float = 0.8, p_validate: float = 0.1,
                       seed: int = 3407) -> DataFrame:
    """(key, split): groups in random order; int(p * n) to train, then to validate, the rest to test.

    The random order is cut by leading hash digits, so numbering the groups needs no single sorted list.
    """
    placed = _numbered(*_hash_bins(df.select(key).distinct(), key, seed), key)
    n_train = F.floor(F.col("total") * p_train)
    n_validate = F.floor(F.col("total") * p_validate)
    return placed.select(
        key,
        F.when(F.col("_no") <= n_train, "train")
        .when(F.col("_no") <= n_train + n_validate, "validate")
        .otherwise("test").alias("split"))
