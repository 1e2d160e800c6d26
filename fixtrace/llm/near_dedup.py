"""Near duplicates by MinHash with tensored banding (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.llm.components import components
from fixtrace.llm.shingles import mix, shingle_set
from fixtrace.session import run_folder, staged

#: Documents whose shingles are held together in a task while they are hashed.
GROUP_SHINGLES = 1 << 18
#: Shingles in a block of texts that meets other blocks of its group.
BLOCK_SHINGLES = 1 << 17
#: Classes of doc_ids by which texts are passed over before those of candidates are fetched: at most so many are broadcast.
ID_CLASSES = 1 << 20


def bands_needed(percent: int, rows: int, miss: float) -> int:
    """Bands in each of the two collections, so that a pair at the threshold is missed with at most ``miss``."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - min(0.999, percent / 100) ** rows)))


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.Generator(np.random.PCG64(7))
    return (seeds.integers(1, 2 ** 64, count, dtype=np.uint64) | np.uint64(1),
            seeds.integers(1, 2 ** 64, count, dtype=np.uint64))


def _band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (set, band): each band joins ``rows`` minimums over the shingles of a set."""
    factors, masks = _factors(bands * rows)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        total = np.full(len(starts), band + 1, dtype=np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            total = mix(total ^ np.minimum.reduceat((flat ^ masks[j]) * factors[j], starts))
        keys[:, band] = total
    return keys


def _sketcher(width: int, bands: int, rows: int):
    """Task function: (doc_id, text, digest) to (doc_id, digest, mark, n, a, b); mark names the set, a and b are the bands."""
    import hashlib

    def flush(part, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = np.zeros((0, 2 * bands), dtype=np.uint64)
        if full:
            lengths = np.array([len(sets[i]) for i in full])
            keys = _band_keys(np.concatenate([sets[i] for i in full]), np.cumsum(lengths) - lengths, 2 * bands, rows)
        marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        counts = np.zeros(len(sets), dtype=np.int64)
        counts[full] = bands
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        sides = [pa.ListArray.from_arrays(offsets, pa.array(keys[:, at:at + bands].reshape(-1).view(np.int64)))
                 for at in (0, bands)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(marks, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *sides],
            names=["doc_id", "digest", "mark", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, held, first = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                sets.append(shingle_set(text.as_py(), width))
                held += len(sets[-1])
                if held >= GROUP_SHINGLES:
                    yield flush(batch.slice(first, at + 1 - first), sets)
                    sets, held, first = [], 0, at + 1
            if sets:
                yield flush(batch.slice(first), sets)

    return run


def _set_maker(width: int):
    """Task function: (node, mark, text) to (node, shingles), of the rows whose text has the set that the mark names."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(2)]
                own = [k for k, (mark, s) in enumerate(zip(part.column(1), made))
                       if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == mark.as_py()]
                if not own:
                    continue
                sets = [made[k] for k in own]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))],
                    names=["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = (pairs.select("a", "b").join(right, "b").join(left, "a")
              .select("a", "b", F.size("sa").cast("bigint").alias("na"), F.size("sb").cast("bigint").alias("nb"),
                      F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("both")))
    return shared.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _class(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ID_CLASSES))


def _linker(percent: int):
    """Task function: links between the texts of two blocks, as many as it takes to connect what is similar.

    ``alone`` shingles of one text are in no other, which bounds what two texts can share; pairs beyond the bound
    and pairs that are connected already are not compared.
    """
    def run(table: pa.Table) -> pa.Table:
        mine = table.column("mine").to_numpy()
        first, last = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        names = table.column("node").to_pylist()
        n, alone = table.column("n").to_numpy(), table.column("alone").to_numpy()
        sets = [s.values.to_numpy().view(np.uint64) for s in table.column("shingles")]
        owns = table.column("own").to_pylist()
        numbers = {own: k for k, own in enumerate(dict.fromkeys(owns))}
        group = np.array([numbers[own] for own in owns])
        left, right = np.flatnonzero(mine == first), np.flatnonzero(mine == last)
        links: tuple[list, list] = ([], [])
        for x in left:
            most = np.minimum(n[x] - alone[x], n[right] - alone[right])
            least = np.maximum(n[x] + alone[right], n[right] + alone[x])
            for y in right[(100 * most >= percent * least) & (group[right] != group[x])]:
                if group[x] == group[y] or (first == last and y < x):
                    continue
                at = np.minimum(np.searchsorted(sets[y], sets[x]), len(sets[y]) - 1)
                both = int((sets[y][at] == sets[x]).sum())
                if 100 * both >= percent * (int(n[x]) + int(n[y]) - both):
                    links[0].append(names[x])
                    links[1].append(names[y])
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    rows: int = 4, miss: float = 1e-5) -> DataFrame:
    """Groups of texts whose word shingles overlap: doc_id, n_shingles, component_id, kept, text_sha256.

    Two texts are linked when their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` in a hundred; a group is what links connect, named by its smallest doc_id, which is kept.

    * Tensored banding: two collections of m bands of ``rows`` minimums each. A table key joins one band of the
      first with one of the second, so m * m tables cost 2 * m * rows minimums instead of m * m * 2 * rows.
      m follows from ``percent``: a pair at the threshold shares no table with a probability of at most ``miss``.
    * Equal sets become one node before anything else, so exact copies are neither hashed into tables nor paired.
    * Only bands that two nodes share are combined into keys. A node most of whose shingles occur in no other
      candidate cannot reach the threshold with any and is left out; this is exact.
    * Each bucket has a leader, the node with the smallest share of such shingles, and each node is compared to the
      best leader of its buckets. Where buckets then still hold several groups, the texts that such buckets connect are dealt into blocks, and
      each two blocks meet in one task, which compares texts of different groups only and returns no more links than
      connect them. So no link is lost to the choice of leaders, and no pairs are written out.
    * Every link is confirmed on the full sets, of which 64-bit hashes are held. Texts of candidates are fetched by the
      classes of their ids, at most 2^20 longs that are broadcast, so that other texts are not moved.

    A text without words, empty or null has no shingles, is linked with nothing and kept. A row belongs to the
    group of its own text: rows that repeat a doc_id share a group if their texts do. A null doc_id never names a group: a set that only such rows have is linked with
    nothing, and its rows are kept with a null group. An empty table gives an empty result. Columns other than the
    two named are not read.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "near")
    bands = bands_needed(percent, rows, miss)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    digested = own.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    sketch = staged(digested.mapInArrow(_sketcher(width, bands, rows),
                                        "doc_id bigint, digest binary, mark binary, n bigint, a array<bigint>, b array<bigint>"),
                    folder, "sketch")
    # One node for each set, with a number that is written down, as it would change from run to run.
    nodes = staged(sketch.filter("mark is not null").groupBy("mark").agg(
        F.min("doc_id").alias("lead"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
        .withColumn("node", F.monotonically_increasing_id()), folder, "nodes")

    # Bands that more than one node has. The last bit of a band's key tells its side.
    sides = F.concat(F.transform("a", lambda x: x.bitwiseAND(F.lit(-2))), F.transform("b", lambda x: x.bitwiseOR(F.lit(1))))
    bits = nodes.select("node", F.explode(sides).alias("bit"))
    common = bits.groupBy("bit").count().filter("count > 1").select("bit")
    candidates = staged(
        bits.join(common, "bit").groupBy("node").agg(F.collect_list("bit").alias("bits"))
        .filter(F.exists("bits", lambda x: x % 2 == 0) & F.exists("bits", lambda x: x % 2 != 0)), folder, "candidates")

    # Their full sets, from the texts. An id may have several texts and a text several rows: one set per node.
    leads = staged(nodes.join(candidates.select("node"), "node").select("node", "mark", F.col("lead").alias("doc_id"), _class("lead").alias("class")),
                   folder, "leads")
    asked = own.withColumn("class", _class("doc_id")).join(F.broadcast(leads.select("class").distinct()), "class", "left_semi")
    sets = staged(asked.join(leads.drop("class"), "doc_id").select("node", "mark", "text")
                  .mapInArrow(_set_maker(width), "node bigint, shingles array<bigint>"), folder, "sets")
    repeated = staged(sets.groupBy("node").count().filter("count > 1").select("node"), folder, "repeated")
    if not repeated.isEmpty():
        once = sets.join(repeated, "node", "left_semi").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
        sets = staged(sets.join(repeated, "node", "left_anti").unionByName(once), folder, "single_sets")
    alone = (sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
             .agg(F.count("*").alias("times"), F.min("node").alias("node")).filter("times = 1")
             .groupBy("node").agg(F.count("*").alias("alone")))
    alive = staged(
        sets.select("node", F.size("shingles").cast("bigint").alias("n")).join(alone, "node", "left")
        .select("node", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
        .filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), folder, "alive")

    # Table keys: a band of either side.
    def side(first):
        return F.filter("bits", lambda x: (x % 2 == 0) if first else (x % 2 != 0))

    keys = (candidates.join(alive, "node")
            .select("node", (F.col("alone") / F.col("n")).alias("apart"), F.explode(side(True)).alias("x"), side(False).alias("ys"))
            .select("node", "apart", "x", F.explode("ys").alias("y"))
            .select("node", "apart", F.xxhash64("x", "y").alias("key")))
    keys = staged(keys, folder, "keys")
    tables = (keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("apart", "node")).alias("lead"))
              .filter("size > 1").select("key", "lead"))
    buckets = staged(keys.join(tables, "key").select("key", "node", "lead"), folder, "buckets")
    starred = (buckets.filter("node != lead.node").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("lead"))
               .select(F.col("lead.node").alias("a"), "b"))
    links = staged(_verified(starred, sets, percent), folder, "links")
    groups = components(links, folder, "groups")

    # Buckets that hold several groups still.
    placed = (buckets.join(groups, "node", "left")
              .select("key", "node", F.coalesce("label", "node").alias("own")))
    mixed = (placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high")
             .select("key", "low"))
    open_ = staged(placed.join(mixed, "key").select("node", "own", "low").distinct(), folder, "open")
    near = components(open_.select(F.col("low").alias("a"), F.col("own").alias("b")), folder, "near")
    members = (open_.select("node", "own").distinct()
               .join(near.select(F.col("node").alias("own"), F.col("label").alias("near")), "own").join(alive, "node"))
    blocks = (members.groupBy("near").agg(F.sum("n").alias("total"), F.count_distinct("own").alias("parts")).filter("parts > 1")
              .select("near", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    dealt = (members.join(blocks, "near").join(sets, "node")
             .select("near", "node", "own", "n", "alone", "shingles", "blocks",
                     F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    met = dealt.select("near", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node",
                       "own", "n", "alone", "shingles")
    more = staged(met.groupBy("near", "i", "j").applyInArrow(_linker(percent), "a bigint, b bigint"), folder, "more_links")
    if not more.isEmpty():
        groups = components(links.union(more), folder, "all_groups")

    # Nodes without links are their own group; only the others are looked for.
    linked = groups.join(nodes.select("node", "mark", "lead"), "node").select("mark", "lead", "label")
    smallest = linked.groupBy("label").agg(F.min("lead").alias("component_id"))
    of_set = nodes.select("mark", "lead").join(linked.join(smallest, "label").select("mark", "component_id"), "mark", "left")
    of_set = of_set.select("mark", F.coalesce("component_id", "lead").alias("component_id"))
    found = sketch.select("doc_id", "digest", "mark", "n").join(of_set, "mark", "left")
    component = F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))
