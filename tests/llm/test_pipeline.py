"""Stages of the pipeline: what leaves out rows moves no other texts."""

import corpus_pipeline
from pyspark.sql import functions as F


def shuffled(df):
    """Bytes that the shuffles of a plan wrote."""
    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_texts_of_dropped_ids_move(spark, tmp_path):
    """Rows to drop that are too many for a broadcast do not make all texts move."""
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.sha2(F.concat_ws("-", F.col("id").cast("string"), i.cast("string")), 256)), " ")
    spark.range(2000).select(F.col("id").alias("doc_id"), digits.alias("text"), F.lit("s").alias("dropped_hit")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    digest = F.unhex(F.sha2("text", 256))
    gone = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), digest.alias("digest"), F.lit(1).cast("bigint").alias("keep_id"))
    other = gone.select((F.col("id") + 1).alias("id"), "digest", "keep_id")
    gone.unionByName(other).unionByName(gone.withColumn("keep_id", F.lit(2).cast("bigint"))).write.parquet(str(tmp_path / "gone"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline._without(docs, spark.read.parquet(str(tmp_path / "gone")))
        rows = left.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(2000) if i % 100]
    assert shuffled(left) < 2000 * 50 * 64 / 4


def test_rows_without_id_are_told_by_their_text(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "c"), (2, None)], "doc_id bigint, text string")
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    gone = docs.filter("text = 'a' OR text IS NULL").select(F.col("doc_id").alias("id"), sha.alias("digest"), F.lit(9).cast("bigint").alias("keep_id"))
    left = {tuple(r) for r in corpus_pipeline._without(docs, gone).collect()}
    assert left == {(None, "b"), (1, "c")}
