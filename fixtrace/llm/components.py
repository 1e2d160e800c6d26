"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtrace.session import staged


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """The smallest node that each linked node reaches: (node, label).

    ``links`` has columns ``a`` and ``b`` of one ordered type; nulls link nothing. Each round takes the
    smallest label among the neighbours and then the label of that label, so a chain of n links ends after
    about log n rounds. Each round is written to the shared folder, so a lost executor costs one round.
    A node with many links is summed in part before the shuffle and its join partition can be split.
    """
    pairs = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = staged(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  folder, f"{name}_sides")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")),
                    folder, f"{name}_0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        lowered = (labels.join(near, labels["node"] == near["a"])
                   .select("node", "label", F.least("label", "near").alias("low")))
        of_label = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = staged(lowered.join(of_label, "low", "left")
                     .select("node", F.least("low", F.coalesce("next", "low")).alias("label"),
                             F.col("label").alias("was")), folder, f"{name}_{step}")
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("was")).isEmpty():
            return labels
