"""Approximate nearest neighbours by a permutation index (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtrace.session import run_folder, staged

#: Vectors of one part of the index, queries of a block, and blocks of queries that meet a part in one task.
PART_VECTORS, QUERY_BLOCK, TASK_BLOCKS = 8192, 512, 64


def usable_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector): double vectors that are not null, without null or non-finite components, and not zero.

    Rows without id take no part. Of rows that repeat an id the least vector is taken. Vectors take part that have
    the most common length, of equally common ones the smallest.
    """
    known = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite
                         & F.exists("vector", lambda x: x != 0))
    return known.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _orders(vectors: np.ndarray, pivots: np.ndarray, heights: np.ndarray | None, length: int) -> np.ndarray:
    """Numbers of the ``length`` nearest pivots of each vector, nearest first; ties to the smaller number.

    ``heights`` is the extra coordinate that gives all vectors one norm, so that the largest inner product is the
    nearest vector; queries have none.
    """
    near = vectors @ pivots[:, :-1].T
    if heights is not None:
        near += heights[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, :length]


def _heights(vectors: np.ndarray, norm: float) -> np.ndarray:
    return np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0.0))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), width)


def _part_builder(pivots: np.ndarray, norm: float, length: int):
    """Task function: the vectors of a part to one row with its inverted files.

    The posting list of a pivot holds, in the order of ids, the vectors that have the pivot among their nearest, with its
    place among them.
    """
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        vectors = _matrix(table.column("vector"), pivots.shape[1] - 1)[by_id]
        orders = _orders(vectors, pivots, _heights(vectors, norm), length)
        flat = orders.reshape(-1)
        by_pivot = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        return pa.table({
            "part": table.column("part")[:1].cast(pa.int32()), "ids": [ids[by_id].tobytes()], "vectors": [vectors.tobytes()],
            "starts": [starts.astype(np.int32).tobytes()], "members": [(by_pivot // length).astype(np.int32).tobytes()],
            "places": [(by_pivot % length).astype(np.int16).tobytes()]})

    return run


class _Part:
    """One part of the index, opened for searches."""

    def __init__(self, row: dict, width: int, length: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(self.ids), width)
        self.starts = np.frombuffer(row["starts"], dtype=np.int32)
        self.members = np.frombuffer(row["members"], dtype=np.int32)
        self.places = np.frombuffer(row["places"], dtype=np.int16)
        self.length = length

    def search(self, query_id: int, vector: np.ndarray, order: np.ndarray, take: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the ``k`` best among the ``take`` vectors of least footrule distance.

        With places counted from 0 and ``length`` for pivots that are not among the nearest, the footrule distance
        is a constant less twice the sum of ``length`` minus the greater place, over the pivots that both have.
        """
        spans = [(self.starts[p], self.starts[p + 1]) for p in order]
        members = np.concatenate([self.members[a:b] for a, b in spans])
        places = np.concatenate([self.places[a:b] for a, b in spans])
        own = np.repeat(np.arange(len(order)), [b - a for a, b in spans])
        agreed = np.bincount(members, weights=self.length - np.maximum(places, own), minlength=len(self.ids))
        chosen = np.arange(len(self.ids))
        if take < len(chosen):
            rank = agreed.astype(np.int64) * len(chosen) - chosen  # ties to the smaller id
            chosen = np.sort(np.argpartition(-rank, take - 1)[:take])
        chosen = chosen[self.ids[chosen] != query_id]
        scores = self.vectors[chosen] @ vector
        if k < len(chosen):
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            chosen, scores = chosen[keep], scores[keep]
        best = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen[best]], scores[best]


def _searcher(pivots: np.ndarray, length: int, fraction: float, at_least: int, k: int):
    width = pivots.shape[1] - 1

    def run(parts: pa.Table, blocks: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if parts.num_rows and blocks.num_rows:
            part = _Part({c: parts.column(c)[0].as_py() for c in parts.column_names}, width, length)
            take = max(at_least, int(np.ceil(fraction * len(part.ids))))
            for block in blocks.column("queries"):
                asked = block.values
                vectors = _matrix(asked.field("vector"), width)
                orders = _orders(vectors, pivots, None, length)
                for query_id, vector, order in zip(asked.field("vec_id").to_pylist(), vectors, orders):
                    ids, scores = part.search(query_id, vector, order, take, k)
                    found[0].append(np.full(len(ids), query_id))
                    found[1].append(ids)
                    found[2].append(scores)
        kinds = (np.int64, np.int64, np.float64)
        arrays = [np.concatenate(f).astype(t) if f else np.empty(0, dtype=t) for f, t in zip(found, kinds)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), arrays)))

    return run


def nearest(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = 128,
            length: int = 32, fraction: float = 0.35, at_least: int = 1000) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query: query_id, rank, vec_id, score.

    * ``pivots`` vectors, a bounded sample by a hash of the id, stand for the space. Each vector is represented
      by its ``length`` nearest pivots in order.
    * All vectors are indexed: parts of about 8,192 vectors each hold one inverted file per pivot, written
      to the shared folder. Parts are cut by a hash of the id, so a vector that is very common fills no part.
    * A query reads the posting lists of its own pivots in each part, takes the ``fraction`` of the part that has
      the least footrule distance (``at_least`` so many), and ranks these by the exact inner product in double precision.
    * Queries meet parts in blocks, so what a task holds is bounded; a part returns ``k`` rows per query.

    ``is_query`` is a condition on ``vec_id`` and the other columns of ``df``. Nearest first, ties to the smaller vec_id;
    a query's own id is left out. If there are fewer candidates, all are returned. The search is approximate:
    random vectors of 64 dimensions, the hardest case, give a recall of about 0.95 with the defaults, and parts of up to
    ``at_least`` vectors are searched exactly. See ``usable_vectors`` for the vectors that take part. An empty
    table, or one without queries, gives an empty result.
    """
    spark = df.sparkSession
    folder = run_folder(spark, "nearest")
    vectors = staged(usable_vectors(df, vec_id, vector), folder, "vectors")
    asked = df.filter(is_query).select(F.col(vec_id).cast("bigint").alias("vec_id")).distinct()
    out = "query_id bigint, vec_id bigint, score double"
    lengths = vectors.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors = vectors.filter(F.size("vector") == common["width"])
    norm = vectors.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * pivots).collect()
    chosen = list(dict.fromkeys(tuple(r["vector"]) for r in sample))[:pivots]
    points = np.array(chosen, dtype=np.float64)
    points = np.column_stack([points, _heights(points, norm)])
    length = min(length, len(points))
    parts_count = max(1, -(-common["rows"] // PART_VECTORS))
    cut = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts_count)).cast("int")
    index = staged(vectors.withColumn("part", cut).groupBy("part").applyInArrow(
        _part_builder(points, norm, length),
        "part int, ids binary, vectors binary, starts binary, members binary, places binary"), folder, "index")

    queries = vectors.join(asked, "vec_id")
    blocks_count = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = (queries.groupBy(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks_count)).cast("int").alias("block"))
              .agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
              .withColumn("turn", F.floor(F.col("block") / TASK_BLOCKS).cast("int")))
    turns = -(-blocks_count // TASK_BLOCKS)
    left = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_count - 1))))
    found = left.groupBy("part", "turn").cogroup(right.groupBy("part", "turn")).applyInArrow(
        _searcher(points, length, fraction, at_least, k), out)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
