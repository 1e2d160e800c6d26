"""Reading and writing commit tables, scores, stages, traces and results."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace import constants as K
from fixtrace import schema as S
from fixtrace.session import run_folder, staged
from fixtrace.sources.shards import qualified, suits, write_small

#: Bytes that a task writes as files of few bytes.
TASK_BYTES = 8 << 20


def clean_commits(raw: DataFrame, max_len: int | None = None) -> DataFrame:
    """Commit rows from raw ones: repaired text, ``owner/repo`` in one column, overlong diffs left out."""
    rows = raw.withColumns({
        "repo": F.concat_ws("/", "owner", "repo"), "diff": F.make_valid_utf8("diff")}).drop("owner")
    return rows if max_len is None else rows.filter(F.length("diff") <= max_len)


def read_commits_jsonl(spark: SparkSession, path: str, max_len: int | None = None) -> DataFrame:
    """Commits from JSON lines with declared columns.

    Bytes that are no UTF-8 become U+FFFD before a line is parsed, so that they cost no record. Blank lines are no
    records; a line that is no JSON object gives a record of nulls, with an empty repo.
    """
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("line")).filter(F.trim("line") != "")
    return clean_commits(lines.select(F.from_json("line", S.RAW_COMMIT).alias("row")).select("row.*"), max_len)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON record per line to a folder."""
    df.write.mode("append").json(path)


def read_jsonl_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Earlier output, or None if there is none yet. Lines that do not parse count as not done."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option(
            "columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException:
        return None
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def read_scores_csv(spark: SparkSession, path: str, schema: str = S.LEXICAL_SCORES) -> DataFrame:
    """Scores with header; the columns are declared, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_scores_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def save_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate table as Parquet and go on from the written one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def load_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a finished stage, else build and write it."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return spark.read.parquet(path)
    return save_stage(build(), path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table partitioned by ``split``; other folders are not read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def concat_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits as one table with the column ``split``."""
    named = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def infer_schema_first_record(spark: SparkSession, path: str) -> T.StructType:
    """Columns and types of JSON lines by the first record only.

    Integers and booleans are int, fractions float, everything else string.
    """
    first = json.loads(spark.read.text(path).filter(F.trim("value") != "").first()[0])

    def kind(value):
        if isinstance(value, int):
            return T.IntegerType()
        return T.FloatType() if isinstance(value, float) else T.StringType()

    return T.StructType([T.StructField(name, kind(value)) for name, value in first.items()])


def write_sharded(df: DataFrame, path: str, max_bytes: int = K.SHARD_BYTES, mode: str = "overwrite") -> int:
    """Write Parquet files whose records take at most ``max_bytes`` as JSON text; gives back the number of files.

    A record over half that size has a file of its own, as one over ``max_bytes`` must. The others are cut by their
    running sum of bytes, in their order of reading, into files of half to all of it, but for the last. Each row goes to
    exactly its file. The rows are written down with their sizes first; sums run within the pieces in which the rows come,
    and are shifted by what the pieces before hold. Files of less than half of ``TASK_BYTES`` share a task, as far as pyarrow
    knows the column types and the file system; all others have a task each.
    """
    spark, half, kind = df.sparkSession, max(1, max_bytes // 2), df.schema
    sized = staged(df.select(F.struct("*").alias("row"), F.octet_length(F.to_json(F.struct("*"))).cast("bigint").alias("size"),
                             F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("place")),
                   run_folder(spark, "sizes"), "rows")
    large = F.col("size") > half
    sums = {"bytes": F.when(large, 0).otherwise(F.col("size")), "alone": large.cast("bigint"),
            "wide": F.when(large, F.col("size")).otherwise(0)}
    totals = sized.groupBy("piece").agg(*[F.sum(value).alias(c) for c, value in sums.items()])
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    whole = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    shared = -(-whole["bytes"] // half)
    files = shared + whole["alone"]
    inside = Window.partitionBy("piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.select("place", "piece", large.alias("large"), *[
        F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"{c}_ahead") for c, value in sums.items()]).join(shifts, "piece")
    ahead = {c: F.col(f"{c}_before") + F.col(f"{c}_ahead") for c in sums}
    shard = F.when(F.col("large"), shared + ahead["alone"]).otherwise(F.floor(ahead["bytes"] / half))
    target, there = qualified(spark, path)
    together = TASK_BYTES // max(1, max_bytes)
    if together < 2 or not files or not suits(kind, target) or (there and mode not in ("append", "overwrite")):
        placed = sized.select("place", "row").join(numbered.select("place", shard.cast("int").alias("shard")), "place")
        placed.repartitionById(max(1, files), "shard").select("row.*").write.mode(mode).parquet(path)
        return files
    narrow = -(-shared // together)
    task = F.when(F.col("large"), narrow + F.floor(ahead["wide"] / TASK_BYTES)).otherwise(F.floor(shard / together))
    placed = sized.select("place", "row").join(numbered.select("place", shard.cast("int").alias("shard"), task.cast("int").alias("task")), "place")
    dealt = placed.repartitionById(narrow + whole["wide"] // TASK_BYTES + 1, "task").sortWithinPartitions("shard", "place")
    write_small(dealt, target, mode == "overwrite")
    return files


def write_traces_by_project(spans: DataFrame, path: str) -> None:
    """Append trace lines, one folder of files per project."""
    spans.write.mode("append").partitionBy("project").json(path)


def with_file_parts(df: DataFrame, name: str = "file", suffix: str = ".jsonl") -> DataFrame:
    """Subset (first two ``_`` parts) and model (the rest) from a file name."""
    parts = F.split(F.replace(F.col(name), F.lit(suffix), F.lit("")), "_")
    return df.withColumns({
        "subset": F.array_join(F.slice(parts, 1, 2), "_"),
        "model": F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "_")})


def with_prediction_subset(df: DataFrame, name: str = "file", suffix: str = ".csv") -> DataFrame:
    """Subset from the last two ``_`` parts of a prediction file's name."""
    parts = F.split(F.replace(F.col(name), F.lit(suffix), F.lit("")), "_")
    return df.withColumn("subset", F.array_join(F.slice(parts, -2, 2), "_"))


def read_results_glob(spark: SparkSession, folder: str, schema: str = S.VERDICT, prefix: str = "",
                      suffix: str = ".jsonl") -> DataFrame:
    """Verdict files of a folder by name, with subset and model from the name."""
    rows = spark.read.schema(schema).json(f"{folder}/{prefix}*{suffix}")
    return with_file_parts(rows.withColumn("file", F.col("_metadata.file_name")), suffix=suffix)


def union_results(results: dict[str, DataFrame]) -> DataFrame:
    """Result rows of several approaches with the approach's name."""
    named = [df.withColumn("approach", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def read_results_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All ``results_<approach>.csv`` files of a folder with the approach from the name."""
    rows = spark.read.schema(S.RESULTS).option("header", True).csv(f"{folder}/results_*.csv")
    approach = F.regexp_extract(F.col("_metadata.file_name"), r"^results_(.*)\.csv$", 1)
    return rows.withColumn("approach", approach)


def explode_ground_truth(df: DataFrame, column: str = "advisories") -> DataFrame:
    """(cve, urls) from a map column cve -> {ground_truth: {commit: [url]}}."""
    entries = df.select(F.explode(F.map_entries(column)).alias("e"))
    return entries.select(F.col("e.key").alias("cve"), F.col("e.value.ground_truth.commit").alias("urls"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(cve, urls) from JSON files: one advisory dictionary per line or per file."""
    texts = spark.read.text(path, wholetext=path.endswith(".json"))
    return explode_ground_truth(texts.select(F.from_json("value", S.GROUND_TRUTH).alias("advisories")))
