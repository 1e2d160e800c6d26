"""Ranks, top-k and running values per group, also for groups too large for one task.

A window sorts a whole group in one task. Where the largest group is over ``hot_rows`` rows, the table is
cut into slices by key and order instead, each slice is ranked on its own and shifted by what the slices
before it hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtrace.session import reliable

HOT_ROWS = 2_000_000
SALTS = 16
PRUNED_K = 1000
SLICE = "_slice"
AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one aggregate pass over the key columns."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _fits(sizes: DataFrame, keys: list[str], hot_rows: int) -> bool:
    return bool(keys and hot_rows) and largest_group(sizes, keys) <= hot_rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               salts: int = SALTS, spread_by: list[str] | None = None) -> DataFrame:
    """Join a large table, possibly with hot keys, to a table with one row per key.

    The small side is repeated once per salt, so the rows of a hot key go to ``salts`` tasks. If it turns
    out small enough at run time, adaptive execution broadcasts it. Salts come from ``spread_by``, by default from
    all columns but the keys.
    """
    spread_by = spread_by or [c for c in big.columns if c not in on]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def running_values(df: DataFrame, keys: list[str], order: list[Column],
                   measures: dict[str, tuple[str, Column]], sizes: DataFrame | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add for each measure its sum, min or max over the rows *before* each row in its group.

    ``order`` has to be total within a group. ``sizes`` is a cheaper table with the same group sizes.
    Without keys, or with a group over ``hot_rows``, the rows are cut into slices.
    """
    if _fits(df if sizes is None else sizes, keys, hot_rows):
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[AGGREGATES[agg](expr).over(before).alias(name)
                                for name, (agg, expr) in measures.items()])

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    # The slice numbers are used twice below, so they are written down first.
    sliced = reliable(ordered.withColumn(SLICE, F.spark_partition_id()))

    totals = sliced.groupBy(*keys, SLICE).agg(
        *[AGGREGATES[agg](expr).alias(name) for name, (agg, expr) in measures.items()])
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
               .rowsBetween(Window.unboundedPreceding, -1))
    shift = totals.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_at"),
        *[AGGREGATES[agg](name).over(earlier).alias(f"_before_{name}")
          for name, (agg, _) in measures.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = sliced.join(shift, reduce(lambda a, b: a & b, same, F.col(SLICE) == F.col("_at")))

    inside = (Window.partitionBy(*keys, SLICE).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))

    def combined(name, agg, expr):
        here, earlier_total = AGGREGATES[agg](expr).over(inside), F.col(f"_before_{name}")
        if agg == "sum":
            return F.when(here.isNull() & earlier_total.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(earlier_total, F.lit(0)))
        return (F.least if agg == "min" else F.greatest)(here, earlier_total)

    return joined.select(*df.columns, *[combined(name, agg, expr).alias(name)
                                        for name, (agg, expr) in measures.items()])


def rank_within(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank",
                sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordinal rank per group, best = 1. The last column of ``order`` has to break all ties."""
    if _fits(df if sizes is None else sizes, keys, hot_rows):
        # In this form a later filter on small ranks prunes each task's rows before the shuffle.
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counted = running_values(df, keys, order, {rank: ("sum", F.lit(1).cast("bigint"))}, hot_rows=0)
    return counted.withColumn(rank, (F.coalesce(rank, F.lit(0)) + 1).cast("int"))


def number_rows(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Number all rows from 1 in the given total order, without one task seeing them all."""
    return rank_within(df, [], order, rank=name)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows per group with their rank.

    For small k each task drops what cannot win before the shuffle. For large k a first cut over salted
    groups does that.
    """
    if k > PRUNED_K:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(1024)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= k)
              .drop("_first", "_salt"))
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)


def sort_rows(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Sort by (column, descending) pairs."""
    return df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order])
