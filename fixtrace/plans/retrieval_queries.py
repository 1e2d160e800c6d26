"""Checked queries for scoring, ranking, neighbours and range joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtrace.functions import vectors as V
from fixtrace.operators import neighbours as N
from fixtrace.operators import ordering as O
from fixtrace.operators import ranking as K
from fixtrace.operators import similarity as S
from fixtrace.operators import spans as L
from fixtrace.plans import standins as T
from fixtrace.plans.registry import query
from fixtrace.session import reliable

TFIDF_SQL = T.COMMITS_SQL + "," + T.MAPPING_SQL + "," + T.ADVISORY_SQL + r""",
n AS (SELECT cve, count(*) AS n FROM mapping GROUP BY cve),
words AS (SELECT commit_id, unnest(regexp_extract_all(lower(commit_message || ' ' || diff), '[\p{L}\p{N}_]{2,}')) AS term FROM commits),
tf AS (SELECT cve, commit_id, term, count(*) AS tf FROM words JOIN mapping USING (commit_id) GROUP BY ALL),
idf AS (SELECT cve, term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN n USING (cve) GROUP BY cve, term),
asked AS (SELECT cve, term, count(*) AS tf FROM (SELECT cve, unnest(regexp_extract_all(lower("desc"), '[\p{L}\p{N}_]{2,}')) AS term FROM advisory) GROUP BY ALL),
q AS (SELECT cve, term, tf * idf AS w FROM asked JOIN idf USING (cve, term)),
d AS (SELECT cve, commit_id, term, tf * idf AS w FROM tf JOIN idf USING (cve, term)),
qn AS (SELECT cve, sqrt(sum(w * w)) AS norm FROM q GROUP BY cve),
dn AS (SELECT cve, commit_id, sqrt(sum(w * w)) AS norm FROM d GROUP BY cve, commit_id),
dots AS (SELECT cve, commit_id, sum(d.w * q.w) AS dot FROM d JOIN q USING (cve, term) GROUP BY cve, commit_id),
lexical AS (SELECT cve, commit_id, label, coalesce(dot / (dn.norm * qn.norm), 0) AS similarity
  FROM mapping LEFT JOIN dots USING (cve, commit_id) LEFT JOIN dn USING (cve, commit_id) LEFT JOIN qn USING (cve)),
lexical_ranked AS (SELECT cve, commit_id, label, row_number() OVER (PARTITION BY cve ORDER BY round(similarity, 9) DESC, commit_id) AS "rank" FROM lexical)"""


def _lexical(spark, sf):
    return S.tfidf_similarity(T.mapping(spark, sf), T.advisory(spark, sf), T.commit_texts(spark, sf))


def _lexical_ranked(spark, sf):
    scored = _lexical(spark, sf).withColumn("similarity", F.round("similarity", 9))
    return S.rank_candidates(scored, "similarity", sizes=T.mapping(spark, sf))


@query(f"WITH {TFIDF_SQL} SELECT cve, commit_id, label, round(similarity, 6) AS similarity FROM lexical")
def tfidf_similarity(spark, sf):
    return _lexical(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {TFIDF_SQL}, hit AS (SELECT cve, max(CASE WHEN label = 1 AND "rank" <= 10 THEN 1 ELSE 0 END) AS hit FROM lexical_ranked GROUP BY cve)
SELECT sum(hit)::BIGINT AS hits, count(*) AS advisories, avg(hit) AS ratio FROM hit""")
def retrieval_hit_rate(spark, sf):
    scored = _lexical(spark, sf).withColumn("similarity", F.round("similarity", 9))
    return K.hit_at_k(S.top_candidates(scored, "similarity", 10), 10)


@query(f"""WITH {TFIDF_SQL} SELECT cve, commit_id, label, "rank" FROM lexical_ranked""")
def retrieval_ranks(spark, sf):
    ranked = _lexical_ranked(spark, sf)
    return ranked.select("cve", "commit_id", "label", F.col("rank").cast("bigint").alias("rank"))


COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query(f"""SELECT a.vec_id, round({COSINE.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    rows = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"))


@query(f"""WITH t AS (SELECT vec_id // 16 AS seq, vec_id, embedding FROM embeddings),
p AS (SELECT a.seq AS cve, b.seq AS commit_id, a.vec_id AS r, b.vec_id AS c, {COSINE.format('a.embedding', 'b.embedding')} AS s
  FROM t a JOIN t b ON b.seq BETWEEN a.seq + 1 AND a.seq + 3),
pr AS (SELECT cve, commit_id, avg(m) AS p FROM (SELECT cve, commit_id, c, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL),
re AS (SELECT cve, commit_id, avg(m) AS r FROM (SELECT cve, commit_id, r, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL)
SELECT cve, commit_id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM pr JOIN re USING (cve, commit_id)""")
def greedy_match(spark, sf):
    tokens = T.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("seq"), "vec_id", "embedding")
    texts = S.token_sequences(tokens, "seq", "vec_id", "embedding")
    pairs = texts.select("seq").withColumn("commit_id", F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + 3)))
    both = (pairs.withColumnRenamed("seq", "cve").join(texts.select(F.col("seq").alias("commit_id"), F.col("vectors").alias("candidate")), "commit_id")
            .join(texts.select(F.col("seq").alias("cve"), F.col("vectors").alias("reference")), "cve"))
    scored = S.greedy_match(both, "candidate", "reference")
    return scored.select("cve", "commit_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH t AS (SELECT vec_id // 400 AS seq, vec_id, embedding FROM embeddings),
p AS (SELECT a.seq AS reference, b.seq AS candidate, a.vec_id AS r, b.vec_id AS c, {COSINE.format('a.embedding', 'b.embedding')} AS s
  FROM t a JOIN t b ON b.seq = a.seq + 1),
pr AS (SELECT reference, candidate, avg(m) AS p FROM (SELECT reference, candidate, c, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL),
re AS (SELECT reference, candidate, avg(m) AS r FROM (SELECT reference, candidate, r, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL)
SELECT q.seq AS reference, q.seq + 1 AS candidate, coalesce(round(p, 6), 0) AS precision, coalesce(round(r, 6), 0) AS recall,
  coalesce(round(2 * p * r / (p + r), 6), 0) AS f1 FROM (SELECT DISTINCT seq FROM t) q
  LEFT JOIN pr ON pr.reference = q.seq LEFT JOIN re ON re.reference = q.seq""")
def greedy_match_tokens(spark, sf):
    """Texts of 400 tokens, each against the next; the last one meets a text without tokens."""
    tokens = T.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 400).alias("candidate"), (F.col("vec_id") % 400).alias("position"),
                                                     F.col("embedding").alias("vector"))
    pairs = tokens.select(F.col("candidate").alias("reference"), (F.col("candidate") + 1).alias("candidate")).distinct()
    scored = S.greedy_match_tokens(pairs, tokens, tokens.withColumnRenamed("candidate", "reference"))
    return scored.select("reference", "candidate", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, commit_id, similarity + 1.5::DOUBLE * f1 AS fused_f1 FROM items""")
def fuse(spark, sf):
    return S.fuse(T.items(spark, sf), 1.5).select("cve", "commit_id", "fused_f1")


HYBRID = f"""{T.ITEMS_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY similarity + 1.0::DOUBLE * f1 DESC, commit_id) AS place
  FROM items WHERE f1 > 0.1) WHERE place <= 100)"""


def _scores(spark, sf):
    rows, keys = T.items(spark, sf), ["cve", "repo", "commit_id", "label"]
    return rows.select(*keys, "similarity"), rows.filter("f1 > 0.1").select(*keys, "f1")


@query(f"""WITH {HYBRID} SELECT cve, repo, commit_id, label, similarity + f1 AS fused_f1, place AS "rank" FROM top""")
def hybrid_retrieve(spark, sf):
    top = S.hybrid_retrieve(*_scores(spark, sf))
    return top.select("cve", "repo", "commit_id", "label", "fused_f1", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {HYBRID}, {T.ADVISORY_SQL}, {T.COMMITS_SQL}
SELECT cve, commit_id, label, place AS "rank", md5("desc") AS "desc", md5(diff) AS diff FROM top JOIN advisory USING (cve) JOIN
(SELECT commit_id, diff FROM commits) USING (commit_id)""")
def hybrid_retrieve_texts(spark, sf):
    """The best candidates with their texts, which come from two tables of commits."""
    commits = T.commits(spark, sf).select("doc_id", "commit_id", "repo", "diff")
    top = S.hybrid_retrieve_texts(*_scores(spark, sf), T.advisory(spark, sf), commits.filter("doc_id % 3 = 0"), commits.filter("doc_id % 3 <> 0"))
    return top.select("cve", "commit_id", "label", F.col("rank").cast("bigint").alias("rank"), F.md5("desc").alias("desc"), F.md5("diff").alias("diff"))


@query(f"""WITH {HYBRID}, h AS (SELECT cve, max(label) AS hit FROM top GROUP BY cve)
SELECT sum(hit)::BIGINT AS hits, count(*) AS advisories, avg(hit) AS ratio FROM h""")
def hybrid_hit_rate(spark, sf):
    return S.hybrid_hit_rate(*_scores(spark, sf))


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS s, round(list_sum(list_transform(range(1, 65), lambda i:
  (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 9) AS d
  FROM embeddings a JOIN embeddings b ON a.label != b.label)
SELECT q AS id, arg_min(s, (d, s)) AS neighbour, round(min(d), 6) AS distance FROM p GROUP BY q""")
def nearest_history(spark, sf):
    rows = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vector"))
    return N.nearest_history(rows, rows).select("id", "neighbour", F.round("distance", 6).alias("distance"))


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS s, round(list_sum(list_transform(range(1, 65), lambda i:
  (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 9) AS d
  FROM embeddings a JOIN embeddings b ON a.label != b.label)
SELECT q AS id, s AS neighbour, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, s) AS n FROM p) WHERE n <= 5""")
def nearest_five(spark, sf):
    rows = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vector"))
    return N.nearest_history(rows, rows, k=5).select("id", "neighbour", F.col("place").cast("bigint").alias("place"))


@query("""SELECT vec_id AS id, vec_id + 1000000 AS neighbour FROM embeddings""")
def nearest_by_buckets(spark, sf):
    """Each vector has a near copy under another key, which the hash tables have to find."""
    rows = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    copies = rows.select((F.col("id") + 1000000).alias("id"), (F.col("key") + 100).alias("key"), F.transform("vector", lambda x, i: x + 1e-5 * (i % 3)).alias("vector"))
    return N.nearest_by_buckets(rows, rows.union(copies)).select("id", "neighbour")


@query(f"""WITH {T.LINES_SQL}, {T.SPANS_SQL}
SELECT repo, path, line_no, coalesce(arg_min(name, (s, e)), 'NULL') AS name FROM code_lines l LEFT JOIN function_spans f USING (repo, path)
WHERE s IS NULL OR true GROUP BY repo, path, line_no HAVING false
UNION ALL SELECT l.repo, l.path, l.line_no, coalesce((SELECT arg_min(f.name, (f.s, f.e)) FROM function_spans f
  WHERE f.repo = l.repo AND f.path = l.path AND l.line_no BETWEEN f.s AND f.e), 'NULL') AS name FROM code_lines l""")
def lines_in_functions(spark, sf):
    return L.lines_in_functions(T.code_lines(spark, sf), T.function_spans(spark, sf)).select("repo", "path", "line_no", "name")


@query(f"""WITH {T.LINES_SQL}, {T.SPANS_SQL}, calls AS (SELECT repo, path, line_no FROM code_lines WHERE length(line) % 7 = 0),
placed AS (SELECT c.*, f.s, f.e, f.name FROM calls c LEFT JOIN function_spans f ON f.repo = c.repo AND f.path = c.path AND c.line_no BETWEEN f.s AND f.e),
ctx AS (SELECT p.repo, p.path, p.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t FROM placed p JOIN code_lines l ON p.s IS NOT NULL AND l.repo = p.repo AND l.path = p.path
  AND l.line_no BETWEEN greatest(p.line_no - 3, p.s) AND least(p.line_no + 9, p.e) GROUP BY ALL)
SELECT repo, path, line_no, coalesce(name, 'NULL') AS name, coalesce(md5(t), 'none') AS context FROM placed LEFT JOIN ctx USING (repo, path, line_no)""")
def call_context(spark, sf):
    lines = T.code_lines(spark, sf)
    calls = lines.filter(F.length("line") % 7 == 0).select("repo", "path", "line_no")
    rows = L.call_context(calls, lines, T.function_spans(spark, sf))
    return rows.withColumn("context", F.coalesce(F.md5("context"), F.lit("none")))


# --- ranks and ranking metrics ------------------------------------------------------


def _ranked(spark, sf):
    return O.rank_within(T.items(spark, sf), ["cve"], S.best_first("score"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, commit_id, "rank" FROM ranked""")
def rank_within(spark, sf):
    return _ranked(spark, sf).select("cve", "commit_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, commit_id, "rank" FROM ranked""")
def rank_within_sliced(spark, sf):
    """The way for groups too large for one task, taken for all groups."""
    ranked = O.rank_within(T.items(spark, sf).select("cve", "commit_id", "score"), ["cve"], S.best_first("score"), hot_rows=0)
    return ranked.select("cve", "commit_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, commit_id, "rank" FROM ranked WHERE "rank" <= 100""")
def top_k(spark, sf):
    return O.top_k(T.items(spark, sf), ["cve"], S.best_first("score"), 100).select("cve", "commit_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, avg(CASE WHEN label = 1 THEN "rank" END) AS avg_rank FROM ranked GROUP BY cve""")
def average_positive_rank(spark, sf):
    return K.average_positive_rank(_ranked(spark, sf))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, "rank", label FROM ranked""")
def rank_info(spark, sf):
    return K.rank_info(_ranked(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer""")
def sort_rows(spark, sf):
    """All rows with their places in the sorted order: ids grow over the sorted partitions, so ranks of them are places."""
    rows = O.sort_rows(T.table(spark, sf, "customer"), ("c_mktsegment", False), ("c_acctbal", True), ("c_custkey", False))
    placed = rows.select("c_custkey", "c_mktsegment", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    placed = reliable(placed)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) + F.col("before")
    return placed.join(before, "part").select("c_custkey", "c_mktsegment", place.alias("place"))


KS = "ks AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 50, 100]) AS k)"
AVG_RANKS = f"""{T.ITEMS_SQL}, {KS}, ar AS (SELECT cve, avg(CASE WHEN label = 1 THEN "rank" END) AS r FROM ranked GROUP BY cve)"""


def _average_ranks(spark, sf):
    return K.average_positive_rank(_ranked(spark, sf))


@query(f"""WITH {T.ITEMS_SQL}, h AS (SELECT cve, max(CASE WHEN label = 1 AND "rank" <= 50 THEN 1 ELSE 0 END) AS hit FROM ranked GROUP BY cve)
SELECT sum(hit)::BIGINT AS hits, count(*) AS advisories, avg(hit) AS ratio FROM h""")
def hit_at_k(spark, sf):
    return K.hit_at_k(_ranked(spark, sf), 50)


@query(f"""WITH {AVG_RANKS} SELECT k, avg(CASE WHEN r <= k THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM ar, ks GROUP BY k""")
def recall_at_k_avg_rank(spark, sf):
    return K.recall_at_k_avg_rank(_average_ranks(spark, sf))


@query(f"""WITH {AVG_RANKS} SELECT round(avg(1 / r), 9) AS mrr FROM ar""")
def mrr_avg_rank(spark, sf):
    return K.mrr_avg_rank(_average_ranks(spark, sf)).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {AVG_RANKS} SELECT k, round(avg(least(r, k)), 9) AS manual_effort FROM ar, ks GROUP BY k""")
def manual_effort_avg_rank(spark, sf):
    return K.manual_effort_avg_rank(_average_ranks(spark, sf)).withColumn("manual_effort", F.round("manual_effort", 9))


@query(f"""WITH {T.ITEMS_SQL}, {KS}, g AS (SELECT cve, k, sum(label) AS p, sum(CASE WHEN label = 1 AND "rank" - 1 < k THEN 1 ELSE 0 END) AS h,
  sum(CASE WHEN label = 1 THEN least("rank" - 1, k) END) AS e, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE / "rank" END) AS rr FROM ranked, ks GROUP BY cve, k)
SELECT k, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0 END), 9) AS recall, round(avg(CASE WHEN p > 0 THEN e / p ELSE 0 END), 9) AS manual_effort,
  round(avg(CASE WHEN p > 0 THEN rr / p ELSE 0 END), 9) AS mrr FROM g GROUP BY k""")
def ranking_metrics_zero_based(spark, sf):
    rows = K.ranking_metrics_zero_based(_ranked(spark, sf))
    return rows.select("k", *[F.round(c, 9).alias(c) for c in ("recall", "manual_effort", "mrr")])


@query(f"""WITH {T.ITEMS_SQL}, {KS}, g AS (SELECT cve, k, sum(label) AS p, sum(CASE WHEN label = 1 AND "rank" <= k THEN 1 ELSE 0 END) AS h,
  min(CASE WHEN label = 1 AND "rank" < k THEN "rank" END) AS e, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE / "rank" END) AS rr FROM ranked, ks GROUP BY cve, k)
SELECT k, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0 END), 9) AS recall, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE round(avg(coalesce(e, k)), 9) END AS manual_effort,
  round(avg(CASE WHEN p > 0 THEN rr / p ELSE 0 END), 9) AS mrr FROM g GROUP BY k""")
def ranking_metrics_first_hit_effort(spark, sf):
    rows = K.ranking_metrics_first_hit_effort(_ranked(spark, sf))
    return rows.select("k", *[F.round(c, 9).alias(c) for c in ("recall", "manual_effort", "mrr")])


@query(f"""WITH {T.ITEMS_SQL}, g AS (SELECT cve, sum(label) AS p, sum(CASE WHEN label = 1 AND "rank" <= 10 THEN 1 ELSE 0 END) AS h,
  min(CASE WHEN label = 1 THEN "rank" END) AS b FROM ranked GROUP BY cve)
SELECT CASE WHEN min(p) > 0 THEN round(avg(CASE WHEN p > 0 THEN h / p END), 9) END AS recall, round(avg(coalesce(1.0::DOUBLE / b, 0)), 9) AS mrr,
  count(*) AS advisories, count(CASE WHEN p = 0 THEN 1 END) AS undefined FROM g""")
def ranking_metrics_first_rr(spark, sf):
    rows = K.ranking_metrics_first_rr(_ranked(spark, sf))
    return rows.select(F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "advisories", "undefined")


@query(f"""WITH {T.ITEMS_SQL}, l AS (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in K.K.GRID_LAMBDAS)}]) AS weight),
r AS (SELECT weight, cve, label, row_number() OVER (PARTITION BY weight, cve ORDER BY similarity + weight * f1 DESC, commit_id) AS n FROM items, l),
h AS (SELECT weight, cve, max(CASE WHEN label = 1 AND n <= 40 THEN 1 ELSE 0 END) AS hit FROM r GROUP BY ALL),
t AS (SELECT weight, sum(hit)::BIGINT AS hits, count(*) AS advisories FROM h GROUP BY weight),
b AS (SELECT weight AS best FROM t ORDER BY hits DESC, abs(weight - 1), weight LIMIT 1)
SELECT weight, hits, advisories, hits / advisories AS ratio, weight = best AS best FROM t, b""")
def grid_search_weight(spark, sf):
    return K.grid_search_weight(T.items(spark, sf), k=40)
