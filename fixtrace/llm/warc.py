"""WARC archives as a Python data source (operator 9).

``spark.dataSource.register(WarcSource)`` makes the format ``warc`` known:

* ``df.write.format("warc").mode("append").save(folder)`` writes one record per row,
* ``spark.read.format("warc").load(folder)`` reads the records of all archives of a folder.

Filters reach the reader if ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from fixtrace.session import run_folder, staged

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
          "payload_length bigint, refers_to string, headers map<string,string>, payload binary")
#: Columns that a record's head gives, by the header that holds them.
HEAD_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
                "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([
    *[(name, pa.string()) for name in ("record_id", "record_type", "target_uri", "warc_date", "payload_digest")],
    ("payload_length", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary())])
#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: Bytes after which an archive is closed and the next one begun, of archives read by one task, and of a batch.
ARCHIVE_BYTES, TASK_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 4 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _line(name: str, value) -> str:
    return "" if value is None else f"{name}: {' '.join(str(value).split())}\r\n"


def _to_base32(digest: str | None) -> str | None:
    return None if digest is None else "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _to_hex(value: str | None) -> str | None:
    """A digest header as hex, or as it stands if it is no base 32 SHA-1."""
    if not value or not value.lower().startswith("sha1:"):
        return value
    try:
        return base64.b32decode(value[5:].upper()).hex()
    except ValueError:
        return value[5:].lower()


def record_bytes(row: dict) -> bytes:
    """One record; a revisit has the response's HTTP head but no body."""
    revisit = row.get("record_type") == "revisit"
    body = b"" if revisit else (row.get("payload") or b"")
    length = row.get("payload_length")
    length = len(body) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = (f"{VERSION}\r\n" + _line("WARC-Type", row.get("record_type") or "response")
            + _line("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>")
            + _line("WARC-Date", row.get("warc_date") or "1970-01-01T00:00:00Z")
            + _line("WARC-Target-URI", row.get("target_uri")) + _line("WARC-Payload-Digest", _to_base32(row.get("payload_digest")))
            + _line("WARC-Refers-To", row.get("refers_to")) + (_line("WARC-Profile", SAME_PAYLOAD) if revisit else "")
            + "Content-Type: application/http; msgtype=response\r\n" + f"Content-Length: {len(http) + len(body)}\r\n\r\n")
    return head.encode() + http + body + _END


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Writes archives under names of their own; only those of tasks that ended well enter the folder's list."""

    def __init__(self, options: dict):
        self.path, self.zipped = options["path"], options.get("compression", "none").lower() == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        done, out, held = Written(), None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or held >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.zipped else "")
                    out, held = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                    done.files.append((name, 0))
                    about = (f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                             "WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                             "Content-Length: 18\r\n\r\nformat: WARC/1.1\r\n").encode() + _END
                    held += out.write(gzip.compress(about, 1) if self.zipped else about)
                record = record_bytes(row)
                held += out.write(gzip.compress(record, 1) if self.zipped else record)
                done.files[-1] = (done.files[-1][0], held)
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        listed = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{folder}/list-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())


@dataclass
class Archives(InputPartition):
    files: list[str]

    def __post_init__(self):
        super().__init__(self.files)


class WarcReader(DataSourceReader):
    """Reads archives in groups of files; a record whose head fails a filter is passed over without its payload."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for test in filters:
            column = test.attribute[0] if hasattr(test, "attribute") and len(test.attribute) == 1 else None
            if column not in HEAD_COLUMNS:
                yield test
            elif isinstance(test, EqualNullSafe):
                self.tests.append((column, "in", (test.value,)))
            elif isinstance(test, EqualTo) and test.value is not None:
                self.tests.append((column, "in", (test.value,)))
            elif isinstance(test, In):  # a null among the values equals nothing, a null in the row neither
                self.tests.append((column, "in", tuple(v for v in test.value if v is not None)))
            elif isinstance(test, IsNotNull):
                self.tests.append((column, "known", None))
            elif isinstance(test, StringStartsWith) and test.value is not None:
                self.tests.append((column, "begins", test.value))
            else:
                yield test

    def wanted(self, head: dict) -> bool:
        for column, kind, value in self.tests:
            own = head[column]
            if kind == "in" and own not in value or kind == "known" and own is None:
                return False
            if kind == "begins" and (own is None or not own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Archives]:
        """Groups of files of about equal bytes: those that finished writes list, or all archives of a foreign folder."""
        store, folder = _place(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [Archives([folder])]
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        lists = [f for f in found if f.base_name.startswith("list-")]
        if lists:
            sized = []
            for one in lists:
                with store.open_input_stream(one.path) as source:
                    sized += [(f"{folder}/{name}", size) for name, size in json.loads(source.read())]
        else:
            sized = [(f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        groups, held = [], TASK_BYTES
        for name, size in sorted(sized):
            if held + size > TASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [Archives(g) for g in groups] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        rows, held = [], 0
        for name in partition.files:
            with store.open_input_file(name) as raw:
                source = io.BufferedReader(raw, 1 << 18)
                stream = gzip.GzipFile(fileobj=source) if name.endswith(".gz") else source
                for row in self.records(stream, name):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 1000
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def records(self, stream, name: str) -> Iterator[dict]:
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record begins with {line[:40]!r}")
            headers = _headers(stream)
            if "content-length" not in headers:
                raise ValueError(f"{name}: a record has no Content-Length")
            left = int(headers["content-length"])
            head = {column: headers.get(key) for column, key in HEAD_COLUMNS.items()}
            head["payload_digest"] = _to_hex(head["payload_digest"])
            if not self.wanted(head):
                stream.seek(left, io.SEEK_CUR)
                continue
            length, payload = left, None
            if headers.get("content-type", "").startswith("application/http"):
                before = stream.tell()
                stream.readline()
                http = _headers(stream)
                left -= stream.tell() - before
                length = int(http.get("content-length", left))
            if not self.with_payload or head["record_type"] == "revisit":
                stream.seek(left, io.SEEK_CUR)
            else:
                payload = stream.read(left)
                if len(payload) < left:
                    raise ValueError(f"{name}: a record ends early")
            yield head | {"payload_length": length, "headers": list(headers.items()), "payload": payload}


def _headers(stream) -> dict[str, str]:
    """Header lines up to an empty one, names in lower case; a line that begins with white space goes on."""
    found: dict[str, str] = {}
    last = None
    while True:
        line = stream.readline()
        if line in (b"\r\n", b"\n", b""):
            return found
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            found[last] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        last = key.strip().lower()
        found[last] = value.strip()


class WarcSource(DataSource):
    """The format ``warc``. Options: ``compression`` none or gzip for writing, ``payload`` false to skip payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to a folder; name a new one instead of overwriting")
        return WarcWriter(self.options)


def archive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                    at_least: int = 1000) -> DataFrame:
    """Records for pages: of equal payloads of at least ``at_least`` bytes the last page is the response.

    Equal payloads are found by SHA-256, merged within each task before the shuffle. The payloads that occur twice are
    written down first, so that the join knows their number: few are broadcast, and no payload is shuffled. A null page counts as
    empty; a null id never is a response that others refer to, and rows that repeat an id repeat its record.
    """
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("target_uri"),
                       F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumns({"payload_length": F.octet_length("payload").cast("bigint"), "same": F.sha2("payload", 256)})
    groups = (own.filter(F.col("payload_length") >= at_least).groupBy("same")
              .agg(F.max("page_id").alias("last"), F.count("*").alias("times")).filter("times > 1").drop("times"))
    groups = staged(groups, run_folder(pages.sparkSession, "repeated"), "groups")
    later = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    return own.join(groups, "same", "left").select(
        name.alias("record_id"), F.when(later, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"), F.sha1("payload").alias("payload_digest"), "payload_length",
        F.when(later, F.concat(F.lit("<urn:page:"), F.col("last").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~later, F.col("payload")).alias("payload"))


def round_trip(pages: DataFrame, compression: str = "none") -> DataFrame:
    """Write pages as archives in the shared folder and read the records back, one row per page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. The digest of a response is computed from
    the payload that was read, that of a revisit is its header's. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = run_folder(spark, "warc")
    archive_records(pages).write.format("warc").option("compression", compression).mode("append").save(folder)
    records = spark.read.format("warc").load(folder).filter(F.col("record_type").isin("response", "revisit"))

    def page(name: str):
        return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    return records.select(page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload"), "payload_length").cast("bigint").alias("payload_bytes"),
                          F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type",
                          page("refers_to").alias("refers_to"))
