"""Merkle manifest of a dataset by lag and lead windows (operator 11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtrace.operators.ordering import join_small
from fixtrace.session import run_folder, staged

#: Levels that one pass over a block of leaves builds, and the leaves of such a block.
ARITY, LEVELS = 3, 5
BLOCK = ARITY ** LEVELS
#: Rows of a slice in which positions are counted, about.
SLICE_ROWS = 1 << 18


def field(value: Column | str) -> Column:
    """A value as it enters a leaf: ``-`` for null, else the bytes of its text in UTF-8, ``:`` and the text."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column | str]) -> Column:
    """Lower-case hex sha256 of the fields of a row, one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _positions(leaves: DataFrame, keys: list[str], order: list[Column], folder: str, name: str, slice_rows: int) -> DataFrame:
    """``leaves`` with pos (from 0) in their group and n, the size of the group; written to the shared folder.

    The rows are cut into ranges of key and order, counted per range, and shifted by what the ranges before hold, so a
    group of any size is spread over tasks. Rows of one range never outnumber a slice by much, unless they are equal.
    """
    leaves = staged(leaves, folder, f"{name}_given")
    slices = max(leaves.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // slice_rows))
    cut = staged(leaves.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()), folder, f"{name}_cut")
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_at"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"), F.sum("rows").over(group).alias("n"))
    inside = Window.partitionBy("_slice", *keys).orderBy(*order)
    placed = cut.withColumn("_own", F.row_number().over(inside))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_slice") == F.col("_at"))
    found = placed.join(F.broadcast(shifts) if slices <= 4096 else shifts, same)
    return staged(found.select(*leaves.columns, (F.col("_before") + F.col("_own") - 1).alias("pos"), "n"), folder, name)


def _pass(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Up to LEVELS levels over nodes (keys, pos, n, digest): adds ``steps`` and, on the first row of a block, ``top``.

    All rows of a block stay in one window. On level l a node is held by the row of its first leaf, so its siblings are
    rows at distances of 3^l and 2 * 3^l: lag and lead columns with fixed offsets, masked by the slot of the
    node in its run and by the length of the run, which ends with the group. First children hash the parent. What a node's
    siblings are is carried down to the rows below it. ``steps`` lists (left, right) siblings for each level, lowest first.
    """
    block = Window.partitionBy(*keys, "block").orderBy("pos")
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("top", F.col("digest"))
    steps = []
    for level in range(LEVELS):
        step = ARITY ** level
        more = F.col("n") > step  # several nodes are left on this level
        holds = F.col("pos") % step == 0
        slot = F.expr(f"pos div {step}") % ARITY

        def other(distance, step=step):
            there = F.lag("top", -distance * step) if distance < 0 else F.lead("top", distance * step)
            return there.over(block)

        left = F.concat(F.when(slot == 2, other(-2)).otherwise(""), F.when(slot >= 1, other(-1)).otherwise(""))
        right = F.concat(F.when((slot <= 1) & (F.col("pos") + step < F.col("n")), other(1)).otherwise(""),
                         F.when((slot == 0) & (F.col("pos") + 2 * step < F.col("n")), other(2)).otherwise(""))
        rows = rows.withColumn("met", F.when(more & holds, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.sha2(F.concat("met.left", "top", "met.right"), 256)
        above = F.last("met", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0)) if level else F.col("met")
        rows = rows.withColumns({
            f"met{level}": F.when(more, above),
            "top": F.when(more & (F.col("pos") % (ARITY * step) == 0), parent).when(~more, F.col("top"))})
        steps.append(f"met{level}")
    kept = [c for c in nodes.columns]
    return rows.select(*kept, "block", F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("steps"), "top")


def _tree(leaves: DataFrame, keys: list[str], folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Steps from each leaf (keys, pos, n, digest, ...) to the top of its group, and the tops (keys, digest).

    Passes go on with the tops of blocks, 243 times fewer each, until every group is one node.
    """
    passes = []
    nodes = leaves
    while True:
        done = staged(_pass(nodes, keys), folder, f"{name}_{len(passes)}")
        passes.append(done)
        tops = done.filter(f"pos % {BLOCK} = 0").select(*keys, F.col("block").alias("pos"),
                                                       F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"))
        if tops.filter("n > 1").isEmpty():
            break
        nodes = staged(tops, folder, f"{name}_nodes_{len(passes)}")
    # From the last pass down: the steps of a block's top follow those of its leaves.
    found = passes[-1]
    for below in reversed(passes[:-1]):
        upper = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pos").alias("_block"), F.col("steps").alias("_steps"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("block") == F.col("_block"))
        found = below.join(upper, same).withColumn("steps", F.concat("steps", "_steps")).drop("_steps", "_block", *[f"_{k}" for k in keys])
    return found.drop("block", "top"), tops.select(*keys, "digest")


def folded(leaf: str, steps: str) -> Column:
    """The root that a leaf and its siblings, lowest level first, give."""
    return F.aggregate(F.col(steps), F.col(leaf), lambda own, met: F.sha2(F.concat(met["left"], own, met["right"]), 256))


def merkle_manifest(rows: DataFrame, group: str, order: str, leaf: Column, claimed: Column | None = None,
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Leaves, trees per group and a tree over the groups: (group, order, leaf, claimed, subroot, root, steps).

    ``leaf`` is the digest of a row, in lower-case hex; ``claimed`` another one that is proved with the same siblings, by
    default the same. In each group the leaves ascend by ``order`` (nulls first, ties by leaf), three consecutive ones
    (the last run may be shorter, even one) hash to their parent, until one node is left, the subroot; a lone leaf is its own
    subroot. Subroots, in the order of their groups (null first, by UTF-8 bytes), likewise give the root. ``steps``
    holds the siblings of a row's nodes from the leaf to the root, as (left, right) hex texts; ``folded`` computes
    the root from them.

    Texts are read once, for the digests; only digests are moved. A group of any size is spread over tasks: positions
    are counted by ranges, and windows hold a block of 243 leaves. Rows that repeat count each. An empty table gives
    an empty result. Columns other than those used are not read.
    """
    folder = run_folder(rows.sparkSession, "merkle")
    leaves = rows.select(F.col(group).alias("grp"), F.col(order).alias("place"), leaf.alias("digest"),
                         (leaf if claimed is None else claimed).alias("claimed"))
    order_by = [F.col("place").asc_nulls_first(), F.col("digest"), F.col("claimed")]
    given = _positions(leaves, ["grp"], order_by, folder, "leaves", slice_rows)
    below, subroots = _tree(given, ["grp"], folder, "tree")
    # All groups hang below one root: their order is that of the ranges as well.
    named = subroots.withColumnRenamed("digest", "subroot").select(F.lit(0).alias("one"), "grp", F.col("subroot").alias("digest"))
    roots = _positions(named, ["one"], [F.col("grp").asc_nulls_first()], folder, "subroots", slice_rows)
    above, root = _tree(roots, ["one"], folder, "root")
    tops = staged(above.select(F.col("grp").alias("_grp"), F.col("digest").alias("subroot"), F.col("steps").alias("_above"), "one")
                  .join(root.select("one", F.col("digest").alias("root")), "one").drop("one"), folder, "tops")
    joined = _with_groups(below, tops)
    return joined.select(F.col("grp").alias(group), F.col("place").alias(order), F.col("digest").alias("leaf"), "claimed",
                         "subroot", "root", F.concat("steps", "_above").alias("steps"))


def _with_groups(below: DataFrame, tops: DataFrame) -> DataFrame:
    """One row per group joined to its leaves: salted, as a group may hold a third of all leaves."""
    # Null groups join as well: the key says whether there is a name.
    key = [F.col("_key").isNull().alias("none"), F.coalesce("_key", F.lit("")).alias("name")]
    left = below.withColumn("_key", F.col("grp")).select("*", *key).drop("_key")
    right = tops.withColumnRenamed("_grp", "_key").select("*", *key).drop("_key")
    return join_small(left, right, ["none", "name"], spread_by=["pos"]).drop("none", "name")
