"""The checked queries of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtrace.llm.exact_dedup import exact_duplicates
from fixtrace.llm.language import fit_language, identify_language
from fixtrace.llm.learning import remainder
from fixtrace.llm.mixing import mix_sources, word_count
from fixtrace.llm.near_dedup import near_duplicates
from fixtrace.llm.permutation_index import nearest
from fixtrace.llm.pieces import encode_pieces
from fixtrace.llm.quality import fit_quality, score_quality
from fixtrace.llm.registry import query
from fixtrace.llm.token_counts import count_tokens
from fixtrace.llm.toxicity import fit_toxicity, score_toxicity
from fixtrace.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: in the folder FIXTRACE_TOKENIZERS names, or where its package has it."""
    folder = os.environ.get("FIXTRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str, label: str, parts: int, held: int) -> DataFrame:
    """Labels of the documents that are not held out."""
    return _table(spark, sf_dir, "labels").filter(remainder("doc_id", parts) != held).select("doc_id", label)


def _held_out(parts: int, held: int) -> Column:
    return F.coalesce(remainder("doc_id", parts) == held, F.lit(False)).alias("held_out")


def _verdict(score: str = "score") -> Column:
    return F.when(F.col(score) >= 0.3, 1).otherwise(0).alias("predicted")


@query(oracle="""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams
    FROM w),
g AS (SELECT doc_id, len(grams) AS n, list_hash FROM (SELECT *, hash(list_sort(grams)) AS list_hash FROM s)),
d AS (SELECT list_hash, n, min(doc_id) AS doc_id FROM g WHERE n > 0 GROUP BY ALL),
t AS (SELECT s.doc_id, d.n, unnest(s.grams) AS gram FROM s JOIN d USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM t x JOIN t y USING (gram)
    WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT g.doc_id, g.n AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id,
    g.doc_id = coalesce(c.component_id, g.doc_id) AS kept
FROM g LEFT JOIN d ON g.list_hash = d.list_hash AND g.n = d.n LEFT JOIN c ON c.node = d.doc_id""")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_sha256")


@query(oracle="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _labels(spark, sf_dir, "toxic", 4, 2))
    return score_toxicity(docs, model).select("doc_id", _held_out(4, 2), "score", _verdict())


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.filter(remainder("doc_id", 5) != 0))
    return (identify_language(docs.select("doc_id", "text"), model, margin=0.01)
            .select("doc_id", _held_out(5, 0), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _labels(spark, sf_dir, "quality", 5, 0))
    return score_quality(docs, model).select("doc_id", _held_out(5, 0), "score", _verdict())


@query()
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (encode_pieces(docs, path, decoded="decoded")
            .select("doc_id", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"),
                    F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (count_tokens(docs, tokenizer_path("word_bpe_49k.json"))
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
                    (F.col("n_tokens") > 2048).alias("over_limit")))


@query(oracle="""
WITH own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS cap FROM src),
f AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_ FROM w
    WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, max(CASE WHEN cap / weight >= rest / open_ THEN rest / open_ END) OVER () AS level FROM f),
o AS (SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM lv),
t AS (SELECT *, greatest(ceil(source_size / 128.0::DOUBLE)::BIGINT,
    least(source_size, CASE WHEN target > 0 THEN ceil(50.0::DOUBLE * source_size / target)::BIGINT END)) AS blocks FROM o),
n AS (SELECT source, blocks, round(target * blocks / source_size)::BIGINT AS need FROM t WHERE source_size > 0),
u AS (SELECT *, sum(need) OVER (ORDER BY source NULLS LAST) AS upto, sum(need) OVER () AS total FROM n WHERE need > 0),
p AS (SELECT *, floor((upto - need)::DOUBLE / total * 4294967296.0::DOUBLE)::BIGINT AS low,
    floor(upto::DOUBLE / total * 4294967296.0::DOUBLE)::BIGINT AS high FROM u),
slots AS (SELECT i AS slot, (i::HUGEINT * 2654435769) % 4294967296 AS point
    FROM generate_series(0, (SELECT (any_value(total) + any_value(total) // 50 + 8 * count(*))::BIGINT - 1 FROM p)) g(i)),
k AS (SELECT source, blocks, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
    FROM slots JOIN p ON point >= low AND point < high),
b AS (SELECT source, k % blocks AS block, count(*) AS times FROM k WHERE k < need GROUP BY ALL),
line AS (SELECT doc_id, source, size, source_size, blocks, sum(size) OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id
    ROWS UNBOUNDED PRECEDING) AS fin FROM own JOIN t USING (source) WHERE size > 0),
cut AS (SELECT source, x.range AS block, ((x.range::HUGEINT * source_size) // blocks)::BIGINT AS lo,
    (((x.range + 1)::HUGEINT * source_size) // blocks)::BIGINT AS hi
    FROM t, LATERAL (SELECT unnest(range(blocks)) AS range) x),
g AS (SELECT doc_id, sum((least(fin, hi) - greatest(fin - size, lo)) * times) AS taken
    FROM line JOIN cut ON line.source = cut.source AND lo < fin AND hi > fin - size
    JOIN b ON b.source = cut.source AND b.block = cut.block GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM own JOIN t USING (source) LEFT JOIN g USING (doc_id)""")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix_sources(docs, "size")[0].drop("source")


@query(oracle="""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


@query(oracle="""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL is the exact search, which the index equals on tables of up to 1,000 vectors."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
