"""Nearest neighbours among stored vectors.

``nearest_by_buckets`` finds candidates by hash tables of random hyperplanes and ranks them exactly: few pairs are
compared where near copies exist, and queries that the tables cannot settle are searched exactly. ``nearest_history``
is the exact form. It compares chunks
of queries with chunks of stored vectors: a few stored vectors serve as pivots of cells, and cells that the triangle
inequality rules out are passed over. In many dimensions it rules out next to nothing, so count on all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fixtrace.operators.ordering import top_k
from fixtrace.session import run_folder, staged

MAX_PIVOTS = 256
BLOCK_ROWS = 1024
# Vectors of a chunk, and the numbers that they may hold: what one task keeps of either side.
CHUNK_ROWS = 1 << 16
CHUNK_VALUES = 1 << 22
MOST_TASKS = 4096
# Rounding of distances; ties within it go to the smaller id.
DIGITS = 9
SLACK = 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(squares, 0.0)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


@dataclass
class Cells:
    """What each task has to know about the store: at most ``MAX_PIVOTS`` vectors and radii."""

    pivots: np.ndarray
    keys: np.ndarray
    radii: np.ndarray

    def open_to(self, vectors: np.ndarray, bound: np.ndarray | None = None, keys: np.ndarray | None = None, k: int = 1):
        """Cells that may hold one of the k nearest of each vector, and the distance that rules out the others."""
        to_pivots = np.sqrt(_distances(vectors, self.pivots))
        if bound is None:
            codes = pd.factorize(np.concatenate([keys, self.keys]))[0]  # null keys are alike
            allowed = codes[:len(keys), None] != codes[None, len(keys):]
            reachable = np.sort(np.where(allowed, to_pivots, np.inf), axis=1)
            # The k-th nearest pivot that counts is no nearer than the k-th nearest vector.
            bound = reachable[:, k - 1] if k <= reachable.shape[1] else np.full(len(vectors), np.inf)
        return (to_pivots - self.radii[None, :] <= bound[:, None] + SLACK) & (self.radii >= 0), bound


def _assign(store: DataFrame, pivots: np.ndarray) -> DataFrame:
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                distances = _distances(_matrix(batch["vector"]), pivots)
                batch["cell"] = distances.argmin(1).astype("int32")
                batch["reach"] = np.sqrt(distances.min(1))
                yield batch

    kind = store.schema["id"].dataType.simpleString()
    key_kind = store.schema["key"].dataType.simpleString()
    return store.mapInPandas(nearest, f"id {kind}, key {key_kind}, vector array<double>, cell int, reach double")


def _chunk_rows(asked: int, stored: int, width: int, tasks: int) -> list[int]:
    """Rows of a chunk of queries and of stored vectors: as many as fit, fewer where there would be too few pairs of chunks."""
    most = max(BLOCK_ROWS, min(CHUNK_ROWS, CHUNK_VALUES // max(1, width)))
    counts, rows = (asked, stored), [most, most]
    while math.prod(-(-n // r) for n, r in zip(counts, rows)) < tasks:
        side = max((0, 1), key=lambda i: min(rows[i], counts[i]))
        halved = -(-min(rows[side], counts[side]) // 2)
        if halved < BLOCK_ROWS:
            break
        rows[side] = halved
    return rows


def _chunks(sizes: np.ndarray, rows: int) -> tuple[list[int], list[int]]:
    """First chunk and number of chunks of each cell: small cells in turn share one, a large one is dealt to several."""
    first, parts, at, filled = [], [], 0, 0
    for n in sizes:
        own = max(1, -(-int(n) // rows))
        if filled and filled + n > rows:
            at, filled = at + 1, 0
        first.append(at)
        parts.append(own)
        at, filled = (at + own, 0) if own > 1 else (at, filled + int(n))
    return first, parts


def _chunk(chunks: tuple[list[int], list[int]]) -> Column:
    first, parts = (F.get(F.array(*[F.lit(n) for n in numbers]), F.col("cell")) for numbers in chunks)
    return (first + F.pmod(F.xxhash64("id", "vector"), parts)).cast("int")


def _unpacked(vectors: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in vectors.chunks]).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best_of_chunks(cells: Cells, k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest in a chunk of stored vectors of each query of another chunk, block by block."""
    def best(asking: pa.Table, stored: pa.Table) -> pa.Table:
        if not len(asking) or not len(stored):
            return schema.empty_table()
        # By id, so that of equal distances the first counts.
        stored = stored.take(pc.sort_indices(stored["id"], sort_keys=[("id", "ascending")], null_placement="at_start"))
        own = np.asarray(stored["cell"])
        codes = pd.factorize(np.array([*asking["key"].to_pylist(), *stored["key"].to_pylist()], dtype=object))[0]
        query_codes, codes = codes[:len(asking)], codes[len(asking):]
        queries, vectors, bound = _unpacked(asking["vector"]), _unpacked(stored["vector"]), np.asarray(asking["bound"])
        lengths = (vectors * vectors).sum(1)
        parts = []
        for start in range(0, len(queries), BLOCK_ROWS):
            rows = slice(start, start + BLOCK_ROWS)
            block, block_codes = queries[rows], query_codes[rows]
            block_lengths = (block * block).sum(1)
            here = np.flatnonzero(cells.open_to(block, bound[rows])[0].any(0)[own])
            limit = np.full(len(block), np.inf)
            found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
            for at in range(0, len(here), BLOCK_ROWS):
                some = here[at:at + BLOCK_ROWS]
                distances = block @ vectors[some].T
                distances *= -2.0
                distances += block_lengths[:, None]
                distances += lengths[some][None, :]
                distances[block_codes[:, None] == codes[some][None, :]] = np.inf
                if not at and k < len(some):
                    limit = np.fmin.reduce(distances, axis=1) if k == 1 else np.partition(distances, k - 1, axis=1)[:, k - 1]
                # Rounding may make equal what differs by less than the last digit.
                i, j = np.nonzero((distances <= np.maximum(limit, 0.0)[:, None] + 2 * 10.0 ** -DIGITS) & (distances < np.inf))
                met = np.maximum(distances[i, j], 0.0).round(DIGITS)
                i, met, j = (np.concatenate(both) for both in zip(found, (i, met, some[j])))
                order = np.lexsort((j, met, i))
                i, met, j = i[order], met[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                found = i[place < k], met[place < k], j[place < k]
                last = place == k - 1
                limit[i[last]] = met[last]
            parts.append((found[0] + start, *found[1:]))
        i, met, j = (np.concatenate(part) for part in zip(*parts))
        return pa.table([asking["id"].take(pa.array(i)), stored["id"].take(pa.array(j)), pa.array(met)], names=schema.names).cast(schema)

    return best


def nearest_history(queries: DataFrame, store: DataFrame, k: int = 1) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest stored vectors whose key differs from the query's.

    Both tables have the columns id, key and vector. The distance is squared Euclidean, rounded to nine
    digits. Ties go to the smaller id. The search is exact and compares up to all pairs. Both tables are read several
    times, so give stored ones.

    Neighbouring cells are put together to chunks of at most about ``CHUNK_ROWS`` vectors, and chunks of queries meet those of
    stored vectors that they cannot rule out, each pair in one task and its k best leave it. A vector thus moves
    once for each chunk that its own meets.
    """
    columns = ["id", "key", F.col("vector").cast("array<double>").alias("vector")]
    queries, store = queries.select(*columns), store.select(*columns)
    if k == 1:
        # Of equal vectors with one key only the smallest id can win.
        store = store.groupBy("vector", "key").agg(F.min("id").alias("id")).select("id", "key", "vector")
    rows = store.count()
    wanted = int(min(MAX_PIVOTS, max(1, round(rows ** 0.5))))
    chosen = store.orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).collect()
    if not chosen:
        raise ValueError("The store holds no vectors.")
    pivots = _matrix([row["vector"] for row in chosen])
    keys = np.array([row["key"] for row in chosen], dtype=object)

    assigned, asking = _assign(store, pivots), _assign(queries, pivots)
    stats = {row["cell"]: row for row in assigned.groupBy("cell").agg(
        F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    asked = {row["cell"]: row["n"] for row in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = Cells(pivots, keys, np.array([stats[c]["radius"] if c in stats else -1.0 for c in range(len(pivots))]))
    sizes = [np.array([n.get(c, 0) for c in range(len(pivots))]) for n in (asked, {c: row["n"] for c, row in stats.items()})]
    most = _chunk_rows(*(int(n.sum()) for n in sizes), pivots.shape[1], 4 * queries.sparkSession.sparkContext.defaultParallelism)
    asking_chunks, chunks = (_chunks(n, r) for n, r in zip(sizes, most))
    met_by = np.zeros((len(pivots), chunks[0][-1] + chunks[1][-1]), dtype=np.float32)
    for cell, (first, parts) in enumerate(zip(*chunks)):
        met_by[cell, first:first + parts] = 1.0

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                open_cells, bound = cells.open_to(_matrix(batch["vector"]), keys=batch["key"].to_numpy(dtype=object), k=k)
                meets = open_cells.astype(np.float32) @ met_by > 0
                yield batch.drop(columns="reach").assign(bound=bound, chunk=[np.flatnonzero(row).astype("int32") for row in meets])

    kind = queries.schema["id"].dataType.simpleString()
    key_kind = queries.schema["key"].dataType.simpleString()
    probing = asking.mapInPandas(probes, f"id {kind}, key {key_kind}, vector array<double>, cell int, bound double, chunk array<int>")
    probing = probing.withColumn("asking", _chunk(asking_chunks)).drop("cell").withColumn("chunk", F.explode("chunk"))
    # As many rows as there are pairs of chunks.
    meeting = F.broadcast(probing.select(F.col("asking").alias("by"), F.col("chunk").alias("at")).distinct())
    stored = assigned.drop("reach").withColumn("at", _chunk(chunks)).join(meeting, "at").withColumnsRenamed({"by": "asking", "at": "chunk"})
    tasks = int(min(MOST_TASKS, 4 * met_by.shape[1] * (asking_chunks[0][-1] + asking_chunks[1][-1])))
    left, right = (df.repartition(tasks, "asking", "chunk").groupBy("asking", "chunk") for df in (probing, stored))
    schema = T.StructType([T.StructField("id", queries.schema["id"].dataType), T.StructField("neighbour", store.schema["id"].dataType),
                           T.StructField("distance", T.DoubleType())])
    candidates = left.cogroup(right).applyInArrow(_best_of_chunks(cells, k, to_arrow_schema(schema)), schema)
    if k == 1:
        nearest = candidates.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("best"))
        return nearest.select("id", "best.neighbour", "best.distance", F.lit(1).alias("place"))
    return top_k(candidates, ["id"], [F.col("distance"), F.col("neighbour")], k, rank="place")


def _bucket_codes(vectors: Column, tables: int, bits: int, seed: int) -> Column:
    """One bucket per table: on which sides of ``bits`` random hyperplanes a vector lies."""
    @F.pandas_udf("array<bigint>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            found = []
            for vector in batch:
                width = 0 if vector is None else len(vector)
                if width not in planes:
                    planes[width] = np.random.Generator(np.random.PCG64(seed)).normal(size=(max(1, width), tables * bits))
                if not width:
                    found.append(None)
                    continue
                sides = (np.asarray(vector, dtype=np.float64) @ planes[width] >= 0).reshape(tables, bits)
                found.append((sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=1).tolist())
            yield pd.Series(found, dtype=object)

    return codes(vectors)


def _by_buckets(queries: DataFrame, store: DataFrame, k: int, tables: int, bits: int, seed: int, recall: float,
                folder: str) -> tuple[DataFrame, DataFrame]:
    """What buckets of ``bits`` hyperplanes find for the queries that they settle, and the other queries."""
    left = queries.select("id", "key", "vector", F.posexplode(_bucket_codes(F.col("vector"), tables, bits, seed)).alias("table", "bucket"))
    right = store.select(F.col("id").alias("neighbour"), F.col("key").alias("_key"), F.col("vector").alias("_vector"),
                         F.posexplode(_bucket_codes(F.col("vector"), tables, bits, seed)).alias("table", "bucket"))
    gaps = F.zip_with("vector", "_vector", lambda a, b: (a - b) * (a - b))
    pairs = left.join(right, ["table", "bucket"]).filter((F.col("key") != F.col("_key")) & (F.size("vector") == F.size("_vector")))
    met = pairs.select("id", "neighbour", F.round(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), DIGITS).alias("distance")).distinct()
    near = staged(top_k(met, ["id"], [F.col("distance"), F.col("neighbour")], k, rank="place"), folder, "near")

    # All within a distance r of a vector of length q lies within the angle whose sine is r / q.
    angle = math.pi * (1 - (1 - (1 - recall) ** (1 / tables)) ** (1 / bits))
    least = math.sin(min(angle, math.pi / 2)) ** 2
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    last = near.filter(F.col("place") == k).select("id", "distance")
    settled = staged(queries.join(last, "id").filter(F.col("distance") <= least * squares).select("id"), folder, "settled")
    return near.join(settled, "id", "left_semi"), staged(queries.join(settled, "id", "left_anti"), folder, "rest")


def nearest_by_buckets(queries: DataFrame, store: DataFrame, k: int = 1, tables: int = 12, bits: int = 12,
                       seed: int = 0, recall: float = 0.95) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest stored vectors of other keys, each found with probability ``recall``.

    A vector is met if it lies on the same side of all ``bits`` hyperplanes of one of ``tables`` tables, at first of twice as
    many, so that near copies meet few others. Two vectors
    at an angle of t degrees miss each other with probability (1 - (1 - t / 180) ** bits) ** tables: 0.0002 for 10
    degrees, 0.04 for 20, 0.94 for 65. So what a query meets settles it only if its k-th distance is so small that all that
    is as near lies within the angle which the tables miss with at most 1 - ``recall``. Every other query, whether it met
    something or not, is searched exactly by ``nearest_history``: no setting of the tables finds far neighbours in many
    dimensions without comparing much of the store. Near copies therefore cost few comparisons, and queries whose
    nearest vector is far cost as many as the exact search.

    Distances are squared Euclidean, rounded to nine digits; ties go to the smaller id. Rows without key or vector, with an
    empty vector or one that has null, NaN or infinite elements find nothing and are not found, and vectors of different
    lengths never meet. Both tables are read several times. The found pairs are written to the shared folder.
    """
    folder = run_folder(queries.sparkSession, "buckets")
    sound = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    columns = ["id", "key", F.col("vector").cast("array<double>").alias("vector")]
    queries, store = (df.select(*columns).filter(F.col("key").isNotNull() & F.col("vector").isNotNull()).filter(sound)
                      for df in (queries, store))
    # Of equal vectors with one key only the k smallest ids can win.
    if k == 1:
        store = store.groupBy("vector", "key").agg(F.min("id").alias("id")).select("id", "key", "vector")
    else:
        store = top_k(store, ["vector", "key"], [F.col("id")], k, rank="_place").select("id", "key", "vector")

    found, rest = None, staged(queries, folder, "asked")
    # Fine buckets first, which hold few but near copies; the given ones for queries that these leave.
    for size in sorted({max(bits, min(2 * bits, 60)), bits}, reverse=True):
        if found is not None and rest.isEmpty():
            break
        near, rest = _by_buckets(rest, store, k, tables, size, seed, recall, f"{folder}/bits_{size}")
        found = near if found is None else found.unionByName(near)
    for row in rest.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect():
        alike = F.size("vector") == row["width"]
        stored = staged(store.filter(alike), folder, f"store_{row['width']}")
        if not stored.isEmpty():
            found = found.unionByName(nearest_history(rest.filter(alike), stored, k).select(*near.columns))
    return found


def history_for_verdicts(queries: DataFrame, store: DataFrame, advisory: DataFrame,
                         search: Callable[[DataFrame, DataFrame], DataFrame] = nearest_history) -> DataFrame:
    """Per query the nearest stored fix of another advisory and that advisory's description.

    ``search`` is ``nearest_history``, exact but for stores of moderate size, or ``nearest_by_buckets``, which is cheaper
    where most queries have a near copy in the store.

    ``store`` has id, key (the advisory), vector and document. Queries whose neighbour's advisory is
    unknown are dropped.
    """
    nearest = search(queries, store)
    documents = store.select(F.col("id").alias("neighbour"), F.col("key").alias("history_cve"),
                             F.col("document").alias("history_document"))
    described = advisory.select(F.col("cve").alias("history_cve"), F.col("desc").alias("history_desc"))
    return nearest.join(documents, "neighbour").join(described, "history_cve")
