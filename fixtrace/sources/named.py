"""JSON lines under given file names: a Python data source that writes one file per name and reads files by name.

Columns are ``file`` and ``value``, a name and a line. ``write_named`` and ``read_named`` turn rows into lines and back. Spark
must reach the folder through a file system that pyarrow knows as well (local or mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith,
    StringStartsWith, WriterCommitMessage)

from fixtrace.sources.files import with_file_parts
from fixtrace.sources.shards import located as _place

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes that a task reads; larger files are cut at line ends, smaller ones share a task.
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20

_LINES = pa.schema([("file", pa.string()), ("value", pa.string())])


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, start, end); a line belongs to the range in which it begins."""
    ranges: list[tuple[str, int, int]]

    def __post_init__(self):
        super().__init__(self.ranges)


class NamedReader(DataSourceReader):
    def __init__(self, path: str, prefix: str, suffix: str, task_bytes: int):
        self.path, self.prefix, self.suffix, self.task_bytes = path, prefix, suffix, task_bytes

    def wanted(self, name: str) -> bool:
        return name.startswith(self.prefix) and name.endswith(self.suffix) and not name.startswith(("_", "."))

    def partitions(self) -> list[Ranges]:
        store, folder = _place(self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and self.wanted(f.base_name)]
        groups, held = [[]], 0
        for info in sorted(files, key=lambda f: f.path):
            for start in range(0, info.size, self.task_bytes):
                end = min(info.size, start + self.task_bytes)
                if groups[-1] and held + end - start > self.task_bytes:
                    groups.append([])
                    held = 0
                groups[-1].append((info.path, start, end))
                held += end - start
        return [Ranges(g) for g in groups]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        names, lines, held = [], [], 0
        for path, start, end in partition.ranges:
            name = path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as raw:
                source = io.BufferedReader(raw, 1 << 18)
                if start:
                    source.seek(start - 1)
                    source.readline()
                while source.tell() < end:
                    line = source.readline().rstrip(b"\r\n")
                    if not line.strip():
                        continue
                    names.append(name)
                    lines.append(line.decode("utf-8", "replace"))
                    held += len(line)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], schema=_LINES)
                        names, lines, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], schema=_LINES)


class PushingNamedReader(NamedReader):
    """The same where the session pushes filters down: files are chosen by predicates on ``file`` too."""

    def __init__(self, *args):
        super().__init__(*args)
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {StringStartsWith: "begins", StringEndsWith: "ends", EqualTo: "in", In: "in"}
        for test in filters:
            if getattr(test, "attribute", None) != ("file",):
                yield test
            elif isinstance(test, IsNotNull):
                continue  # a file has a name
            elif type(test) in kinds:
                value = test.value if isinstance(test, In) else (test.value,)
                self.tests.append((kinds[type(test)], tuple(v for v in value if v is not None)))
            else:
                yield test

    def wanted(self, name: str) -> bool:
        meets = {"begins": name.startswith, "ends": name.endswith, "in": lambda names: name in names}
        return super().wanted(name) and all(meets[kind](value) for kind, value in self.tests)


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]


class NamedWriter(DataSourceArrowWriter):
    """Each task writes its files into a folder of this attempt; the commit moves them to their names."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.attempt = path, overwrite, f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        own = f"{folder}/{self.attempt}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(own, recursive=True)
        rows = ((name, value) for batch in iterator
                for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
        files: dict[str, str] = {}
        for name, group in groupby(rows, key=lambda row: row[0]):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} cannot name a file of results")
            if name in files:
                raise ValueError(f"rows of {name} do not lie together")
            files[name] = f"{own}/{name}"
            with store.open_output_stream(files[name]) as out:
                for _, value in group:
                    if value is None or not value.strip():
                        continue
                    if "\n" in value:
                        raise ValueError(f"a line of {name} has a line break")
                    out.write(value.encode("utf-8", "replace") + b"\n")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        moves: dict[str, str] = {}
        for name, source in (item for m in messages if m for item in m.files.items()):
            if name in moves:
                raise ValueError(f"rows of {name} lie in more than one task")
            moves[name] = source
        found = {f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))}
        if not self.overwrite and found & moves.keys():
            raise FileExistsError(f"{min(found & moves.keys())} is there already")
        for name, source in moves.items():
            store.move(source, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        if store.get_file_info(f"{folder}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.attempt}")


class NamedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_lines"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> DataSourceReader:
        kind = PushingNamedReader if self.options.get("pushdown", "false") == "true" else NamedReader
        return kind(self.options["path"], self.options.get("prefix", ""), self.options.get("suffix", ""),
                    int(self.options.get("taskbytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedWriter(self.options["path"], overwrite)


def write_named(df: DataFrame, folder: str, file: str = "file", overwrite: bool = False) -> None:
    """Write rows as JSON lines into files that the column ``file`` names, one file per name, all or none of them seen.

    All other columns make the line. Rows of a name meet in one task, which writes them as they come, so a file may be of any
    size. A name that is there already is an error, or is replaced with ``overwrite``; other files stay. An empty table writes
    no file. A null or empty name is an error, as are names with a slash or a leading ``_`` or ``.``.
    """
    df.sparkSession.dataSource.register(NamedLines)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != file]))
    lines = df.select(F.col(f"`{file}`").alias("file"), line.alias("value")).repartition("file").sortWithinPartitions("file")
    lines.write.format("named_lines").mode("overwrite" if overwrite else "append").save(folder)


def read_named(spark: SparkSession, folder: str, schema: str, prefix: str = "", suffix: str = ".jsonl",
               task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of the files whose names begin and end as given: file, subset, model and the columns of ``schema``.

    Subset and model come from the name without its extension, as ``suffix`` gives it.

    Only such files are opened; where the session pushes filters to Python sources, predicates on ``file`` choose among them
    as well. Invalid bytes become replacement characters, lines that are no JSON rows of nulls; blank lines are left out.
    """
    spark.dataSource.register(NamedLines)
    lines = (spark.read.format("named_lines").option("prefix", prefix).option("suffix", suffix).option("taskbytes", task_bytes)
             .option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower()).load(folder))
    named = with_file_parts(lines, suffix=suffix[suffix.rfind("."):] if "." in suffix else "")
    return named.withColumn("record", F.from_json("value", schema)).select("file", "subset", "model", "record.*")
