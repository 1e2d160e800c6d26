"""Exact duplicates by an extendible-hash index on shared files (operator 8); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.session import run_folder, staged

#: Distinct keys that a bucket of the index may hold before it is split.
BUCKET_KEYS = 4096
#: Rows of a key from which its copies are merged before they are sent to the owner of its bucket.
HOT_ROWS = 64
#: Bits of the filter over keys, a power of two. Its words are at most 2^18 rows, some 12 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def _key(text: Column | str) -> Column:
    """The 64-bit key of a text."""
    return F.xxhash64(text)


def _prefix(key: Column | str, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, folder: str, capacity: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """Buckets of an extendible hash over the distinct values of ``key``: (slot, bucket, depth) and the global depth.

    The directory doubles until no bucket holds more than ``capacity`` keys; a bucket keeps the depth at which
    it stopped splitting, so several slots may lead to it. Only the keys of buckets that are too full are
    counted again. The depth follows from the number of keys; keys are distinct and spread, so it ends.
    """
    total = keys.count()
    depth = max(0, (max(1, total) - 1) // capacity).bit_length()
    done, left, closed = None, keys.select("key"), []
    while True:
        at = _prefix("key", depth)
        sizes = staged(left.groupBy(at.alias("slot")).agg(F.count("*").alias("size")), folder, f"sizes_{depth}")
        fits = sizes.filter(F.col("size") <= capacity) if depth < 64 else sizes
        closed.append((depth, fits.select("slot")))
        full = sizes.filter(F.col("size") > capacity)
        if depth >= 64 or full.isEmpty():
            break
        left = left.join(full.select(F.col("slot").alias("full")), at == F.col("full"), "left_semi")
        depth += 1
    for own, slots in closed:
        spread = F.sequence(F.lit(0).cast("bigint"), F.lit(2 ** (depth - own) - 1).cast("bigint"))
        part = slots.select(F.explode(F.transform(spread, lambda x: F.shiftleft("slot", depth - own) + x)).alias("slot"),
                            F.struct(F.lit(own).alias("depth"), F.col("slot").alias("prefix")).alias("bucket"))
        done = part if done is None else done.union(part)
    return done, depth


def _place() -> tuple[Column, Column]:
    """The word of the filter that a key falls into, and its bit there."""
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    return F.shiftright(bit, 6), bit.bitwiseAND(63).cast("int")


def key_filter(keys: DataFrame) -> DataFrame:
    """(word, repeated, hot): bits for the keys (key, n) of more than one row, and of more than ``HOT_ROWS`` rows."""
    word, at = _place()
    bit = F.expr("shiftleft(1L, at)")
    return (keys.filter("n > 1").select(word.alias("word"), at.alias("at"), "n").groupBy("word")
            .agg(F.bit_or(bit).alias("repeated"), F.bit_or(F.when(F.col("n") > HOT_ROWS, bit).otherwise(0)).alias("hot")))


def marked(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``repeats`` and ``hot``: true for rows whose key the filter holds as such, and for few others; never false for those.

    The broadcast is the filter, whose size is bounded; a fuller one marks more of the others.
    """
    word, at = _place()
    flags = {c: F.coalesce(F.getbit(bits, at) == 1, F.lit(False)) for c, bits in (("repeats", "repeated"), ("hot", "hot"))}
    return rows.withColumn("word", word).join(F.broadcast(words), "word", "left").withColumns(flags).drop("word", "repeated")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """Groups of identical texts: doc_id, keep_id, group_size, kept, text_sha256.

    A row's 64-bit key leads through the directory to a bucket, a key range that one owner task processes. Texts whose
    key occurs once are equal to nothing and stay where they are. The others are sent to the owner of their bucket,
    which chains the entries of a key and compares them by their bytes, so that different texts with equal keys stay
    apart. The index is written to the shared folder, each bucket in one file, and each row looks up its entry in its
    bucket. Of equal texts the row with the largest doc_id stays.

    Copies of a key with more than ``HOT_ROWS`` rows are merged in their tasks first, so a text that is a third of
    all rows reaches its owner as one entry. A filter of bounded size tells the scan
    of the texts which keys repeat and which are hot.

    A null text counts as empty. Rows with a null doc_id are grouped like others and never stay beside rows with
    an id; where all ids of a group are null, keep_id is null and none is marked kept except a group of one row.
    Rows that repeat a doc_id count each, and share its fate. An empty table gives an empty result. Other
    columns are not read.
    """
    folder = run_folder(docs.sparkSession, "exact")
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("key", _key("text"))
    rows = staged(own.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), folder, "rows")
    keys = staged(rows.groupBy("key").agg(F.count("*").alias("n")), folder, "keys")
    slots, depth = directory(keys, folder, capacity)
    slots = staged(slots, folder, "directory")
    words = staged(key_filter(keys), folder, "filter")

    def owned(entries: DataFrame) -> DataFrame:
        return entries.withColumn("slot", _prefix("key", depth)).join(slots, "slot").drop("slot")

    met = marked(own, words).filter("repeats")
    size, keep = F.lit(1).cast("bigint").alias("group_size"), F.col("doc_id").alias("keep_id")
    merged = met.filter("hot").groupBy("key", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    sent = owned(met.filter("NOT hot").select("key", "text", size, keep).union(merged)).repartition("bucket")
    chains = (sent.groupBy("bucket", "key", "text").agg(F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))
              .select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id"))
    lone = owned(marked(rows, words).filter("NOT repeats")).select("bucket", "key", "text_sha256", size, keep)
    index = staged(chains.union(lone).repartition("bucket").sortWithinPartitions("bucket", "key", "keep_id"), folder, "index")

    found = owned(rows).join(index, ["bucket", "key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size",
                        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("group_size") == 1).alias("kept"), "text_sha256")
