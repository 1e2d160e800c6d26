"""Small Parquet files, many to a task: a Python data source that writes one file for each value of a number.

Spark's own writer opens one file in each task, so files of a few kilobytes cost a task each. Spark must reach the folder through
a file system that pyarrow knows as well (local or mounted paths, hdfs, s3, gs); ``suits`` tells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Where Spark's Parquet files hold the schema, by which types without a Parquet counterpart are told.
ROW_METADATA = b"org.apache.spark.sql.parquet.row.metadata"
#: Names of compressions in Spark where pyarrow has others.
CODECS = {"uncompressed": "none", "lz4_raw": "lz4"}
#: Files that the driver moves at the same time.
MOVES = 16

PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
         T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path with its file system, as Spark takes it, and whether it is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString(), store.exists(place)


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return _plain(kind.keyType) and _plain(kind.valueType)
    return type(kind) in PLAIN


def suits(schema: T.StructType, path: str) -> bool:
    """Whether pyarrow writes these columns as Spark does and knows the file system."""
    try:
        located(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return _plain(schema)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class ShardWriter(DataSourceArrowWriter):
    """Rows (shard, row) in order of shards; each task writes its files into a folder of this attempt, the commit moves them."""

    def __init__(self, path: str, codec: str, schema: str, replace: bool):
        self.path, self.codec, self.schema, self.replace = path, codec, schema, replace
        self.run = uuid.uuid4().hex
        self.attempt = f"_attempt-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = located(self.path)
        own = f"{folder}/{self.attempt}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(own, recursive=True)
        now, held = None, []

        def flush():
            if held:
                table = pa.Table.from_batches(held).replace_schema_metadata({ROW_METADATA: self.schema.encode()})
                with store.open_output_stream(f"{own}/part-{now:05d}-{self.run}.parquet") as out:
                    pq.write_table(table, out, compression=self.codec)
                held.clear()

        for batch in iterator:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if shards[start] != now:
                    flush()
                    now = int(shards[start])
                held.append(rows.slice(start, end - start))
        flush()
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = located(self.path)
        if self.replace:
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.base_name != self.attempt:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message:
                    made = store.get_file_info(fs.FileSelector(message.folder))
                    list(pool.map(lambda f: store.move(f.path, f"{folder}/{f.base_name}"), made))
        self.abort(messages)
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = located(self.path)
        if store.get_file_info(f"{folder}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.attempt}")


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "small_shards"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options["path"], self.options["codec"], self.options["rowschema"], self.options["replace"] == "true")


def write_small(placed: DataFrame, path: str, replace: bool) -> None:
    """Write the structs ``row`` as Parquet, one file for each number ``shard``.

    Rows of a shard lie together in one task. With ``replace`` what the folder held before goes. No file is seen before
    all are written; the driver moves them to their names.
    """
    spark = placed.sparkSession
    codec = spark.conf.get("spark.sql.parquet.compression.codec", "snappy").lower()
    spark.dataSource.register(Shards)
    (placed.select("shard", "row").write.format("small_shards").mode("append").option("codec", CODECS.get(codec, codec))
     .option("rowschema", placed.schema["row"].dataType.json()).option("replace", str(replace).lower()).save(path))
