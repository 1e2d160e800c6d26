"""A sink that holds each batch once: files first, then one entry of a ledger that makes them count.

Below the sink's folder lie ``rows`` (what was judged), ``keys`` (what was asked, by bucket) and ``ledger`` (one file for each
committed batch of a stream). Every attempt at a batch writes folders of its own. They count from the moment when
the ledger names the attempt, which one rename does; what a lost driver left behind before that is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixtrace.operators.preparation import resume
from fixtrace.streaming.feeds import written

#: Columns that name an attempt, as the folders of the sink spell them.
ATTEMPT = ("stream", "batch", "attempt")
LEDGER = "stream string, batch bigint, attempt string"
BUCKETS = 64


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, path: str, part: str = "rows") -> DataFrame | None:
    """Rows (or ``keys``) of the attempts that the ledger names, None before the first batch with any.

    The ledger has one short row per batch; folders of other attempts are left out by a join, not read one by one.
    """
    found = written(spark, f"{path}/{part}")
    if found is None:
        return None
    try:
        entries = spark.read.schema(LEDGER).json(f"{path}/ledger/*/*.json")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    typed = found.withColumns({"stream": F.col("stream").cast("string"), "batch": F.col("batch").cast("bigint"),
                               "attempt": F.col("attempt").cast("string")})
    return typed.join(entries, list(ATTEMPT), "left_semi").drop(*ATTEMPT)


def is_committed(spark: SparkSession, path: str, stream: str, batch: int) -> bool:
    entry = spark._jvm.org.apache.hadoop.fs.Path(_entry(path, stream, batch))
    return entry.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(entry)


def commit(spark: SparkSession, path: str, stream: str, batch: int, attempt: str) -> bool:
    """Enter an attempt into the ledger. False if another attempt at the batch is there: the first one counts.

    The entry is written beside the ledger and renamed without overwriting, which the file system does as a whole or not.
    """
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    entry = fs.Path(_entry(path, stream, batch))
    draft = fs.Path(entry.getParent(), f".{batch}-{attempt}")
    out = draft.getFileSystem(conf).create(draft, True)
    out.write(bytearray(json.dumps(dict(zip(ATTEMPT, (stream, batch, attempt)))).encode()))
    out.close()
    files = fs.FileContext.getFileContext(entry.toUri(), conf)
    options = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        files.rename(draft, entry, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def _entry(path: str, stream: str, batch: int) -> str:
    return f"{path.rstrip('/')}/ledger/{stream}/{batch}.json"


def write_batch(batch: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, stream: str, number: int,
                keys: tuple[str, ...] = ("cve", "commit_id"), buckets: int = BUCKETS) -> bool:
    """Judge the keys of a batch that no committed batch holds, and commit. False if the batch was there already.

    Only the buckets of earlier keys are read that the batch has keys in; the driver holds their numbers, at most
    ``buckets``. Rows that repeat a key count once. Rows with a null in a key are judged once each time they arrive, as null
    equals nothing.
    """
    spark = batch.sparkSession
    if is_committed(spark, path, stream, number):
        return False
    attempt = f"a{uuid.uuid4().hex}"
    todo = batch.dropDuplicates(list(keys))
    done = committed(spark, path, "keys")
    if done is not None:
        own = [r[0] for r in todo.select(_bucket(keys, buckets)).distinct().collect()]
        todo = resume(todo, done.filter(F.col("bucket").isin(own)), keys)
    place = f"stream={stream}/batch={number}/attempt={attempt}"
    asked = todo.select(*keys, _bucket(keys, buckets).alias("bucket")).repartition("bucket")
    asked.write.partitionBy("bucket").parquet(f"{path}/keys/{place}")
    judge(todo).write.parquet(f"{path}/rows/{place}")
    return commit(spark, path, stream, number, attempt)


def stream_verdicts_once(candidates: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                         keys: tuple[str, ...] = ("cve", "commit_id"), buckets: int = BUCKETS) -> StreamingQuery:
    """Judge arriving candidates once each, whatever is killed and however often the stream is restarted.

    The stream keeps no state: what was judged is looked up in the sink, by bucket. A batch that is run again because the
    driver was lost is left out if the ledger has it, and judged anew if not. A new checkpoint is a new stream, which
    finds the keys of the others. Read the sink with ``committed``; one stream at a time may write to it, always with the
    same ``keys`` and ``buckets``.
    """
    spark, names = candidates.sparkSession, []

    def run(batch: DataFrame, number: int) -> None:
        if not names:  # the id lives as long as the checkpoint
            names.append(spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"])
        write_batch(batch, judge, path, names[0], number, keys, buckets)

    return (candidates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
