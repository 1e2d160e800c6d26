"""URL filters by sorted digest arrays that each machine maps into memory (operator 13)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace.session import run_folder, staged

ALLOW, BLOCK = "allow", "block"
#: Rules in one file of the index, about.
FILE_RULES = 1 << 22
#: Seed of Spark's own xxhash64, so that keys made in SQL and in Python agree.
_SEED = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArrays:
    """Sorted arrays of 64-bit keys in mapped files, with the full strings behind them.

    A file holds the entries of one key range: ``keys`` (uint64, sorted), ``ends`` of the strings, the strings' bytes and a
    number per entry. Files come as Parquet through Spark's file distribution; the first task of a machine lays
    each out as flat arrays beside it, later ones map those. Only pages that a search touches are read.
    """

    def __init__(self, files: list[str]):
        self.files, self.parts, self.first = files, None, None

    def __getstate__(self):  # the files are mapped where they are used
        return {"files": self.files, "parts": None, "first": None}

    def _flat(self, name: str) -> str:
        import pyarrow.parquet as pq

        source = SparkFiles.get(name)
        target = source + ".flat"
        if not os.path.exists(os.path.join(target, "done")):
            own = f"{target}-{os.getpid()}"
            os.makedirs(own)
            at = 0
            with (open(f"{own}/keys", "wb") as keys, open(f"{own}/ends", "wb") as ends, open(f"{own}/text", "wb") as texts,
                  open(f"{own}/value", "wb") as values):
                for batch in pq.ParquetFile(source).iter_batches():
                    keys.write(batch.column("key").to_numpy().view(np.uint64).tobytes())
                    values.write(batch.column("value").to_numpy().tobytes())
                    raw = [t.as_py() for t in batch.column("entry")]
                    sizes = at + np.cumsum([len(r) for r in raw], dtype=np.int64)
                    at = int(sizes[-1]) if len(sizes) else at
                    ends.write(sizes.tobytes())
                    texts.write(b"".join(raw))
            open(f"{own}/done", "w").close()
            try:
                os.rename(own, target)
            except OSError:  # another process of this machine was faster; its arrays are the same
                if not os.path.exists(os.path.join(target, "done")):
                    raise
        return target

    def _map(self) -> None:
        self.parts, first = [], []
        for name in self.files:
            folder = self._flat(name)
            if os.path.getsize(f"{folder}/keys") == 0:
                continue
            text = f"{folder}/text"
            self.parts.append((np.memmap(f"{folder}/keys", np.uint64, "r"), np.memmap(f"{folder}/ends", np.int64, "r"),
                               np.memmap(text, np.uint8, "r") if os.path.getsize(text) else np.empty(0, np.uint8),
                               np.memmap(f"{folder}/value", np.int64, "r")))
            first.append(self.parts[-1][0][0])
        order = np.argsort(np.array(first, dtype=np.uint64), kind="stable")
        self.parts = [self.parts[k] for k in order]
        self.first = np.array(first, dtype=np.uint64)[order]

    def find(self, entries: list[bytes]) -> np.ndarray:
        """The number behind each string, -1 for a string that is not an entry."""
        import xxhash

        if self.parts is None:
            self._map()
        found = np.full(len(entries), -1, dtype=np.int64)
        if not self.parts or not entries:
            return found
        keys = np.fromiter((xxhash.xxh64_intdigest(e, _SEED) for e in entries), np.uint64, len(entries))
        # Keys of one range may end in the file before the one that begins with them; equal keys stay in one file.
        place = np.searchsorted(self.first, keys, "right") - 1
        for part in np.unique(place[place >= 0]):
            own, ends, text, values = self.parts[part]
            asked = np.flatnonzero(place == part)
            low = np.searchsorted(own, keys[asked], "left")
            high = np.searchsorted(own, keys[asked], "right")
            for k in np.flatnonzero(high > low):  # several entries only where keys collide
                for at in range(low[k], high[k]):
                    start = int(ends[at - 1]) if at else 0
                    if text[start:int(ends[at])].tobytes() == entries[asked[k]]:
                        found[asked[k]] = int(values[at])
        return found


def digest_arrays(entries: DataFrame, folder: str, name: str, file_rules: int = FILE_RULES) -> DigestArrays:
    """Index of a table (entry string, value long) with distinct entries: ranges of the sorted keys, one file each.

    Written by Spark to the shared folder and shipped to the executors as files; nothing passes through the driver.
    """
    spark = entries.sparkSession
    keyed = staged(entries.select(F.xxhash64("entry").alias("key"), F.col("entry").cast("binary").alias("entry"), "value"),
                   folder, f"{name}_keyed")
    # Unsigned order, as numpy sorts: the sign bit moves the negative half behind the positive one.
    order = F.col("key").bitwiseXOR(F.lit(-2 ** 63))
    files = max(1, -(-keyed.count() // file_rules))
    ranged = keyed.repartitionByRange(files, order).sortWithinPartitions(order, "entry")
    names = []
    for path in staged(ranged, folder, name).inputFiles():
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(unquote(urlparse(path).path)))
    return DigestArrays(names)


class UrlRules:
    """Hosts with the lengths of their paths, and the rules themselves, each an index of its own."""

    def __init__(self, hosts: DigestArrays, shapes: DigestArrays, rules: DigestArrays):
        self.hosts, self.shapes, self.rules = hosts, shapes, rules

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of the longest rule that fits each URL, of equally long ones that of the longer host."""
        asked: dict[bytes, int] = {}
        wanted = []  # (url, number of the host string)
        for at, host in enumerate(hosts):
            raw, cut = host.encode("utf-8", "surrogatepass"), 0
            while cut >= 0:
                wanted.append((at, asked.setdefault(raw[cut:], len(asked))))
                cut = raw.find(b".", cut) + 1 or -1
        names = list(asked)
        longest_path = self.hosts.find(names)
        # Which lengths a host's rules have: one look-up for each length up to the longest, in bytes.
        raws = [p.encode("utf-8", "surrogatepass") for p in paths]
        probes: dict[bytes, list] = {}
        for at, number in wanted:
            for size in range(min(int(longest_path[number]), len(raws[at])) + 1):
                probes.setdefault(names[number] + b" %d" % size, []).append((at, number, size))
        keys = list(probes)
        fits: dict[bytes, list] = {}
        for key, there in zip(keys, self.shapes.find(keys)):
            if there >= 0:
                for at, number, size in probes[key]:
                    fits.setdefault(names[number] + raws[at][:size], []).append((at, number, size))
        best: list = [None] * len(hosts)
        keys = list(fits)
        for key, verdict in zip(keys, self.rules.find(keys)):
            if verdict >= 0:
                for at, number, size in fits[key]:
                    rank = (len(key.decode("utf-8", "surrogatepass")), len(names[number]))
                    if best[at] is None or rank > best[at][0]:
                        best[at] = (rank, key.decode("utf-8", "replace"), BLOCK if verdict else ALLOW)
        return [None if b is None else b[1:] for b in best]


def url_rules(rules: DataFrame, file_rules: int = FILE_RULES) -> UrlRules:
    """Index of rules (host, path, verdict): ``allow`` or ``block``; other verdicts and null hosts are left out.

    A null path counts as empty. A-Z of a host is lower-cased. A path that does not begin with ``/`` fits no URL and is
    left out. Of rules with the same host and path one stays, a block before an allow.
    """
    known = (rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .filter(F.col("host").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)
                     & ((F.col("path") == "") | F.col("path").startswith("/"))))
    folder = run_folder(rules.sparkSession, "urls")
    known = staged(known.groupBy("host", "path").agg(F.max((F.col("verdict") == BLOCK).cast("bigint")).alias("value")), folder, "rules")
    size = F.octet_length("path").cast("bigint")
    hosts = known.groupBy(F.col("host").alias("entry")).agg(F.max(size).alias("value"))
    shapes = known.select(F.concat_ws(" ", "host", size.cast("string")).alias("entry"), F.lit(0).cast("bigint").alias("value")).distinct()
    whole = known.select(F.concat("host", "path").alias("entry"), "value")
    return UrlRules(digest_arrays(hosts, folder, "host_files", file_rules), digest_arrays(shapes, folder, "shape_files", file_rules),
                    digest_arrays(whole, folder, "rule_files", file_rules))


def judge_urls(rows: DataFrame, rules: UrlRules, url: str = "url", default: str = ALLOW) -> DataFrame:
    """All columns of ``rows`` and host, path, rule, verdict; columns of these names are replaced.

    A rule fits its host and all subdomains, if the path of the URL starts with that of the rule. The longest
    rule that fits wins (host and path together, in characters; of equally long ones that of the longer host). Its verdict
    counts; without such a rule ``rule`` is null and the verdict is ``default``, as a digest array says no more about
    what it does not hold.

    Keys are looked up by binary search in arrays of 64-bit hashes that all machines map from files, and full strings are
    compared, so a collision changes nothing. Hosts and their ends at dots are looked up first; paths are cut only to
    lengths which rules of the host have. A null URL, or one without ``://``, has empty host and path. Rows are
    independent: repeats, ties and an empty table need no rule, and nothing is shuffled.
    """
    kept = rows.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else rows
    split = kept.withColumns({"host": url_host(url), "path": url_path(url)})
    at, to = split.columns.index("host"), split.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rules.longest(batch.column(at).to_pylist(), batch.column(to).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    return split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()),
                                               T.StructField("verdict", T.StringType())]))
