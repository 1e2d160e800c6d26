"""From documents to encoded training data: quality, exact and near duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtrace.llm.exact_dedup import exact_duplicates
from fixtrace.llm.learning import remainder
from fixtrace.llm.mixing import mix_sources, word_count
from fixtrace.llm.near_dedup import near_duplicates
from fixtrace.llm.pieces import encode_pieces
from fixtrace.llm.quality import fit_quality, score_quality
from fixtrace.llm.queries import tokenizer_path
from fixtrace.session import run_folder, staged

#: Texts whose chance of being good is below this are rejected.
LEAST_QUALITY = 0.3
#: Classes of ids, a power of two, by which documents are told that cannot have been dropped. Their bits are at most 2^18 rows, some 12 MB.
ID_CLASSES = 1 << 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    It learns from the labels of the documents that are not held out (crc32 of the id modulo 5 is not 0). Empty and null
    texts have a score as well and are rejected by it alone. Without labels of both classes all documents get the
    same score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0).select("doc_id", "quality")
    model, score = fit_quality(docs, labels), _free(docs, "quality")
    return score_quality(docs, model, name=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def keep_last_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. A row without id goes only if a row with an id has its text.

    Of equal texts that only rows without id have, the row stays that comes first when written as JSON. Rows that repeat both
    id and text share their fate.
    """
    dropped = _dropped(docs, exact_duplicates(docs))
    nameless = dropped.filter("id IS NULL AND keep_id IS NULL").select(F.col("digest").alias("other"))
    rest = _without(docs, dropped)
    if nameless.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    lone = docs.filter("doc_id IS NULL").select(_digest().alias("digest"), row.alias("row"))
    one = (lone.join(nameless, F.col("digest") == F.col("other"), "left_semi")
           .groupBy("digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return rest.unionByName(one)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the document with the smallest id."""
    marked = near_duplicates(docs, width=5, percent=80).withColumnRenamed("component_id", "keep_id")
    return _without(docs, _dropped(docs, marked))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _dropped(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows marked as dropped: (id, digest, keep_id), the id, the digest of the text and the id that stays instead.

    An id alone does not name a row, as ids repeat and lack. They are written down, so that a join knows their
    number: few are broadcast, and no text moves.
    """
    rows = marked.filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "keep_id")
    return staged(rows.distinct(), run_folder(docs.sparkSession, "dropped"), "rows")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents that do not have both id and text of a dropped row.

    Only documents whose id falls into a class of a dropped one are joined; the bits of the 2^24 classes are broadcast, so
    that the texts of the others are not moved, whatever the number of rows to drop. That join is an outer one, as an anti-join
    would be moved below the broadcast by the optimizer, where it meets all texts.
    """
    key, digest, word, bits, hit = (_free(docs, n) for n in ("dropped_id", "dropped_digest", "dropped_word", "dropped_bits", "dropped_hit"))
    named = dropped.select(F.col("id").alias(key), F.col("digest").alias(digest), F.lit(True).alias(hit))
    place = _id_class(key)
    words = (named.select(F.shiftright(place, 6).alias(word), place.bitwiseAND(63).alias(bits)).distinct()
             .groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(bits))).alias(bits)))
    own, at = [F.col(f"`{c}`") for c in docs.columns], _id_class("doc_id")
    marked = docs.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word, "left")
    met = F.coalesce(F.getbit(bits, at.bitwiseAND(63)) == 1, F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (_digest() == F.col(digest))
    rest = marked.filter(met).select(*own).join(named, same, "left").filter(F.col(hit).isNull())
    return marked.filter(~met).select(*own).unionByName(rest.select(*own))


def _id_class(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ID_CLASSES)).cast("int")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix goes through them: the words it takes over the document's words, to the nearest.

    A source's documents are taken in passes, so only where its last pass ends a document is taken in part, and rounding
    moves a source by half a document. Documents without words are in no block and go. Rows that share an id get
    their own number each, by source and size.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    given = mix_sources(sized, "size")[0].filter("size > 0")
    key, source, size, times = (_free(docs, n) for n in ("mixed_id", "mixed_source", "mixed_size", "mixed_times"))
    taken = (given.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size),
                          F.round(F.col("taken") / F.col("size")).cast("int").alias(times))
             .filter(F.col(times) > 0).distinct())
    found = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source))
                      & (word_count("text") == F.col(size)))
    copy = _free(docs, "mixed_copy")
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, source, size, times, copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the piece ids of the whole text, their number, and whether they decode to it.

    A null text has null ids, -1 pieces and counts as decoded; an empty one has none. Rows that repeat stay. An empty
    table gives an empty result. Other columns are left out.
    """
    path = tokenizer_path("piece_bpe_32k.model")
    coded = encode_pieces(docs.select("doc_id", "source", "lang", "text"), path, decoded="decoded")
    return coded.select("doc_id", "source", "lang", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(-1)).cast("bigint").alias("n_pieces"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact_dedup", keep_last_copies),
    ("near_dedup", keep_one_of_group),
    ("mixing", mix),
    ("pieces", encode),
]

#: A trained classifier has no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it.

    Null and empty texts and rows that repeat are treated as the stages say; an empty table gives an empty result.
    """
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return docs
