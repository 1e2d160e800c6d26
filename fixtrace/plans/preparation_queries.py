"""Checked queries for sources, filters, samples, splits and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fixtrace.operators import joins as J
from fixtrace.operators import preparation as P
from fixtrace.operators import splitting as S
from fixtrace.operators import summaries as R
from fixtrace.plans import standins as T
from fixtrace.plans.registry import query
from fixtrace.session import shared_folder
from fixtrace.sources import files as IO
from fixtrace.sources import named


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT doc_id::VARCHAR AS commit_id, lang || '/' || source AS repo, md5(text) AS digest FROM documents WHERE length(text) <= 4000""")
def clean_commits(spark, sf):
    raw = T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("commit_id"), F.col("lang").alias("owner"), F.col("source").alias("repo"), F.col("text").alias("diff"))
    return IO.clean_commits(raw, 4000).select("commit_id", "repo", F.md5("diff").alias("digest"))


@query("""SELECT doc_id::VARCHAR AS commit_id, lang || '/' || source AS repo, md5(text) AS digest FROM documents WHERE length(text) <= 4000""")
def commits_jsonl_round_trip(spark, sf):
    path = _folder(spark, "commits")
    IO.append_jsonl(T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("commit_id"), F.col("lang").alias("owner"), F.col("source").alias("repo"),
        F.lit("").alias("commit_message"), F.col("text").alias("diff")), path)
    return IO.read_commits_jsonl(spark, path, 4000).select("commit_id", "repo", F.md5("diff").alias("digest"))


@query("""SELECT doc_id::VARCHAR AS commit_id, lang || '/' || source AS repo, md5(text) AS digest FROM documents""")
def commits_jsonl_uncut(spark, sf):
    path = _folder(spark, "commits")
    IO.append_jsonl(T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("commit_id"), F.col("lang").alias("owner"), F.col("source").alias("repo"),
        F.lit("").alias("commit_message"), F.col("text").alias("diff")), path)
    return IO.read_commits_jsonl(spark, path, 2 ** 31 - 1).select("commit_id", "repo", F.md5("diff").alias("digest"))


@query("""SELECT doc_id::INTEGER AS doc_id, n_chars::INTEGER AS n_chars, lang, md5(text) AS digest FROM documents""")
def infer_schema_first_record(spark, sf):
    """JSON lines read with the types of their first record."""
    path = _folder(spark, "lines")
    IO.append_jsonl(T.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text"), path)
    rows = spark.read.schema(IO.infer_schema_first_record(spark, path)).json(path)
    return rows.select("doc_id", "n_chars", "lang", F.md5("text").alias("digest"))


@query("""SELECT doc_id::VARCHAR AS commit_id, lang || '/' || source AS repo, md5(text || chr(65533) || 'x') AS digest FROM documents
UNION ALL SELECT NULL, '', NULL FROM documents WHERE doc_id % 10 = 0""")
def commits_jsonl_repaired(spark, sf):
    """Lines with a byte that is no UTF-8 in the diff, blank lines, and lines that are no JSON."""
    path = _folder(spark, "commits")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("commit_id"), F.col("lang").alias("owner"), F.col("source").alias("repo"),
                              F.lit("").alias("commit_message"), F.col("text").alias("diff")))
    broken = F.concat(F.encode(F.expr("left(line, length(line) - 2)"), "UTF-8"), F.unhex(F.lit("ff")), F.encode(F.lit('x"}'), "UTF-8")).cast("string")
    docs = T.table(spark, sf, "documents").select("doc_id", line.alias("line"))
    odd = F.when(F.col("doc_id") % 10 == 0, F.array(broken, F.lit("  "), F.lit("{no json"))).otherwise(F.array(broken))
    docs.select(F.explode(odd).alias("value")).write.text(path)
    return IO.read_commits_jsonl(spark, path).select("commit_id", "repo", F.md5("diff").alias("digest"))


@query("""SELECT doc_id, md5(text) AS digest, true AS fits FROM documents""")
def write_sharded(spark, sf):
    """All rows come back, from files that hold no more than their share, or one row."""
    path, most = _folder(spark, "shards"), 40_000
    IO.write_sharded(T.table(spark, sf, "documents").select("doc_id", "text"), path, most)
    rows = spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"), F.col("_metadata.file_name").alias("file"),
                                           F.octet_length(F.to_json(F.struct("doc_id", "text"))).alias("size"))
    files = rows.groupBy("file").agg(((F.sum("size") <= most) | (F.count(F.lit(1)) == 1)).alias("fits"))
    return rows.join(files, "file").drop("file", "size")


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source""")
def load_stage(spark, sf):
    """A finished stage is read again, not built again."""
    path = _folder(spark, "stage")
    IO.load_stage(spark, path, lambda: T.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    return IO.load_stage(spark, path, lambda: spark.createDataFrame([], "source string, n bigint"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, repo, commit_id, similarity, label FROM items""")
def scores_csv_round_trip(spark, sf):
    path = _folder(spark, "scores")
    IO.write_scores_csv(T.items(spark, sf).select("cve", "repo", "commit_id", "similarity", "label"), path)
    return IO.read_scores_csv(spark, path)


@query("""SELECT o_orderkey, o_orderstatus AS split FROM orders WHERE o_orderstatus = 'O'""")
def load_split(spark, sf):
    path = _folder(spark, "split")
    orders = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"))
    IO.save_stage(orders, path, ["split"])
    return IO.load_split(spark, path, "O")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END AS split FROM documents""")
def concat_splits(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id")
    return IO.concat_splits({
        name: docs.filter(F.col("doc_id") % 3 == i) for i, name in enumerate(["train", "test", "validation"])})


@query("""SELECT file, p[1] || '_' || p[2] AS subset, array_to_string(p[3:], '_') AS model FROM (
  SELECT file, string_split(replace(file, '.jsonl', ''), '_') AS p FROM (
    SELECT source || '_top' || doc_id % 9 || '_' || lang || '_' || md5(doc_id::VARCHAR) || '.jsonl' AS file FROM documents))""")
def file_name_parts(spark, sf):
    name = F.concat("source", F.lit("_top"), (F.col("doc_id") % 9).cast("string"), F.lit("_"), "lang", F.lit("_"),
                    F.md5(F.col("doc_id").cast("string")), F.lit(".jsonl"))
    return IO.with_file_parts(T.table(spark, sf, "documents").select(name.alias("file")))


RESULT_FILES_SQL = """r AS (SELECT coalesce(source, 'none') || '_top' || doc_id % 9 AS subset, 'model_' || coalesce(lang, 'und') AS model, doc_id, n_chars,
  text FROM documents)"""


def _result_files(spark, sf):
    """Whole documents as results, one file per (source, subset, language)."""
    path = _folder(spark, "results")
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("_top"), (F.col("doc_id") % 9).cast("string"), F.lit("_model_"),
                    F.coalesce("lang", F.lit("und")), F.lit(".jsonl"))
    named.write_named(T.table(spark, sf, "documents").select(name.alias("file"), "doc_id", "n_chars", "text"), path)
    return path


@query(f"""WITH {RESULT_FILES_SQL} SELECT subset || '_' || model || '.jsonl' AS file, subset, model, doc_id, n_chars, md5(text) AS digest FROM r""")
def named_result_files(spark, sf):
    rows = named.read_named(spark, _result_files(spark, sf), "doc_id bigint, n_chars bigint, text string")
    return rows.select("file", "subset", "model", "doc_id", "n_chars", F.md5("text").alias("digest"))


@query(f"""WITH {RESULT_FILES_SQL} SELECT subset, model, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM r
WHERE starts_with(subset, 'src1') AND model = 'model_en' GROUP BY 1, 2""")
def named_result_files_chosen(spark, sf):
    rows = named.read_named(spark, _result_files(spark, sf), "doc_id bigint, n_chars bigint", prefix="src1", suffix="_model_en.jsonl")
    return rows.groupBy("subset", "model").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT cve, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Agent' ELSE 'Other' END AS approach FROM predictions""")
def union_results(spark, sf):
    rows = T.predictions(spark, sf).select("cve", "doc_id")
    return IO.union_results({"Agent": rows.filter("doc_id % 2 = 0"), "Other": rows.filter("doc_id % 2 = 1")})


@query("""WITH s AS (SELECT count(*) AS n, min(l_orderkey) AS a1, max(l_orderkey) AS b1, min(l_partkey) AS a2, max(l_partkey) AS b2,
  min(l_suppkey) AS a3, max(l_suppkey) AS b3, min(l_linenumber) AS a4, max(l_linenumber) AS b4 FROM lineitem),
c AS (SELECT n, unnest([{'c': 'l_orderkey', 'a': a1, 'b': b1, 't': 'bigint', 'w': 8}, {'c': 'l_partkey', 'a': a2, 'b': b2, 't': 'bigint', 'w': 8},
  {'c': 'l_suppkey', 'a': a3, 'b': b3, 't': 'bigint', 'w': 8}, {'c': 'l_linenumber', 'a': a4::BIGINT, 'b': b4::BIGINT, 't': 'int', 'w': 4}]) AS x FROM s),
i AS (SELECT n, x.c AS "column", x.t AS from_type, x.w AS w, CASE WHEN x.a > -128 AND x.b < 127 THEN 'tinyint' WHEN x.a > -32768 AND x.b < 32767 THEN 'smallint'
  WHEN x.a > -2147483648 AND x.b < 2147483647 THEN 'int' ELSE x.t END AS to_type FROM c)
SELECT "column", from_type, to_type, (n * w)::BIGINT AS bytes_before,
  (n * CASE to_type WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 ELSE 8 END)::BIGINT AS bytes_after FROM i
UNION ALL SELECT c, 'double', 'float', (n * 8)::BIGINT, (n * 4)::BIGINT FROM s, (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c)""")
def narrow_numeric(spark, sf):
    return R.narrow_numeric(T.table(spark, sf, "lineitem"))


@query("""SELECT doc_id, lang, 1::INTEGER AS label FROM documents""")
def prune_and_label(spark, sf):
    return P.add_label(P.prune(T.table(spark, sf, "documents"), "text", "n_chars", "source"), 1)


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, commit_id, "rank" FROM ranked WHERE "rank" <= 10 AND label = 1""")
def select_candidates(spark, sf):
    from fixtrace.operators.ordering import rank_within
    ranked = rank_within(T.items(spark, sf), ["cve"], [F.col("score").desc(), F.col("commit_id")])
    return P.select_candidates(ranked, max_rank=10, label=1, keep=["cve", "commit_id", "rank"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {T.ITEMS_SQL} SELECT cve, arg_min(repo, commit_id) AS repo FROM items GROUP BY cve HAVING max(label) = 1 ORDER BY cve LIMIT 20""")
def advisory_worklist(spark, sf):
    return P.advisory_worklist(T.items(spark, sf), 20)


@query("""SELECT text_key, doc_id, source FROM (SELECT md5(text) AS text_key, doc_id, source,
  row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1""")
def dedupe_keep_first(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return P.dedupe_keep_first(docs, ["text_key"], [F.col("source"), F.col("doc_id")])


@query("""SELECT label, arg_min(vec_id, vec_id) AS vec_id FROM embeddings WHERE vec_id % 3 != 0 GROUP BY label""")
def first_per_key(spark, sf):
    rows = T.table(spark, sf, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return P.first_per_key(rows, "label", "embedding", [F.col("vec_id")]).select("label", "vec_id")


@query(f"""WITH {T.MAPPING_SQL} SELECT cve, commit_id FROM mapping WHERE NOT (commit_id < '6' AND label = 0)""")
def resume(spark, sf):
    mapping = T.mapping(spark, sf)
    return P.resume(mapping, mapping.filter("commit_id < '6' AND label = 0")).select("cve", "commit_id")


@query("""SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE length(text) <= (SELECT quantile_cont(length(text), 0.95) FROM documents)""")
def length_cutoff(spark, sf):
    kept = P.length_cutoff(T.table(spark, sf, "documents"), "text")
    return kept.select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("""SELECT doc_id, repo, commit_id FROM (SELECT doc_id, source AS repo, doc_id AS commit_id,
  row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE n <= 7""")
def sample_negatives(spark, sf):
    commits = T.table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo"), F.col("doc_id").alias("commit_id"))
    fixes = T.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("commit_id"))
    return S.sample_negatives(commits, fixes, 7).select("doc_id", "repo", "commit_id")


@query("""SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 150""")
def reservoir_sample(spark, sf):
    return S.reservoir_sample(T.table(spark, sf, "documents").select("doc_id"), 150, "doc_id")


def _greedy(weights, name):
    """Recursive form of the greedy rule: one group after the other, heaviest first."""
    return f"""
{name}_order AS (SELECT *, row_number() OVER (ORDER BY weight DESC, key) AS n, sum(weight) OVER () AS total FROM {weights}),
{name}_walk(n, key, weight, total, side, a, b) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::HUGEINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT o.n, o.key, o.weight, o.total, s.side, w.a + CASE WHEN s.side = 'train' THEN o.weight ELSE 0 END,
    w.b + CASE WHEN s.side = 'test' THEN o.weight ELSE 0 END
  FROM {name}_walk w JOIN {name}_order o ON o.n = w.n + 1, LATERAL (SELECT CASE
    WHEN w.a + o.weight <= o.total * SHARE_A::DOUBLE THEN 'train' WHEN w.b + o.weight <= o.total * SHARE_B::DOUBLE THEN 'test'
    WHEN w.a < w.b THEN 'train' ELSE 'test' END AS side) s)"""


@query("WITH RECURSIVE weights AS (SELECT c_nationkey::VARCHAR AS key, count(*)::BIGINT AS weight FROM customer GROUP BY 1),"
       + _greedy("weights", "g").replace("SHARE_A", "0.8").replace("SHARE_B", "0.2")
       + " SELECT key, weight, side FROM g_walk WHERE n > 0")
def weighted_group_split(spark, sf):
    customers = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("key"))
    return S.weighted_group_split(customers.agg(F.count(F.lit(1)).alias("weight")), "key")


@query("WITH RECURSIVE weights AS (SELECT source AS key, count(*)::BIGINT AS weight FROM documents GROUP BY 1),"
       + _greedy("weights", "g").replace("SHARE_A", "0.8").replace("SHARE_B", "0.2")
       + ", held AS (SELECT key, weight FROM g_walk WHERE side = 'test'),"
       + _greedy("held", "h").replace("SHARE_A", "0.5").replace("SHARE_B", "0.5")
       + """ SELECT key, weight, side AS split FROM g_walk WHERE side = 'train'
       UNION ALL SELECT key, weight, CASE WHEN side = 'train' THEN 'test' ELSE 'validation' END FROM h_walk WHERE n > 0""")
def train_test_validation(spark, sf):
    docs = T.table(spark, sf, "documents").groupBy(F.col("source").alias("key"))
    return S.train_test_validation(docs.agg(F.count(F.lit(1)).alias("weight")), "key")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS key FROM orders),
r AS (SELECT key, row_number() OVER (ORDER BY md5('3407|' || key), key) AS n, count(*) OVER () AS total FROM g)
SELECT key, CASE WHEN n <= floor(total * 0.8::DOUBLE) THEN 'train' WHEN n <= floor(total * 0.8::DOUBLE) + floor(total * 0.1::DOUBLE) THEN 'validate' ELSE 'test' END AS split FROM r""")
def random_group_split(spark, sf):
    return S.random_group_split(T.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query(f"""WITH {T.LINKS_SQL}, f AS (SELECT cve, regexp_extract(urls[1], 'https?://github\\.com/([^/]+)/([^/]+)', 1) AS o,
  regexp_extract(urls[1], 'https?://github\\.com/([^/]+)/([^/]+)', 2) AS n FROM fix_links)
SELECT o || '/' || n AS repo, cve, count(*) OVER (PARTITION BY o, n) AS repo_cves FROM f WHERE o != ''""")
def group_advisories_by_repo(spark, sf):
    return P.group_advisories_by_repo(T.fix_links(spark, sf))


@query(f"""WITH {T.LINKS_SQL}, {T.COMMITS_SQL},
l AS (SELECT cve, regexp_extract(unnest(urls), '\\b[a-fA-F0-9]{{40}}\\b') AS commit_id FROM fix_links)
SELECT cve, commit_id, repo FROM l JOIN commits USING (commit_id)""")
def patch_commit_rows(spark, sf):
    return P.patch_commit_rows(T.fix_links(spark, sf), T.commits(spark, sf).select("commit_id", "repo"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, ' ') AS lang FROM documents""")
def fill_text(spark, sf):
    rows = T.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return P.fill_text(rows, ["lang"], " ")


@query("""SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def drop_incomplete(spark, sf):
    joined = T.table(spark, sf, "documents").select("doc_id").join(T.table(spark, sf, "labels"), "doc_id", "left")
    return P.drop_incomplete(joined)


@query(f"""WITH {T.COMMITS_SQL} SELECT doc_id, repo || '/commit/' || commit_id AS short, 'https://github.com/' || repo || '/commit/' || commit_id AS url FROM commits""")
def commit_url(spark, sf):
    from fixtrace.functions.text import commit_url as url
    return T.commits(spark, sf).select("doc_id", url("repo", "commit_id").alias("short"), url("repo", "commit_id", "https://github.com/").alias("url"))


@query("""WITH r AS (SELECT 'u' || user_id AS url, CASE WHEN event_id % 3 = 0 THEN 'train' WHEN event_id % 3 = 1 THEN 'test' ELSE 'other' END AS partition,
  (event_id % 2)::INTEGER AS label, event_type AS language, event_id FROM events),
l AS (SELECT url, arg_max(label, event_id) AS last_label, arg_max(language, event_id) AS last_language FROM r GROUP BY url)
SELECT partition, url, arg_min(label, event_id) AS label, min(event_id) AS first_seen, any_value(last_label) AS last_label,
  any_value(last_language) AS last_language FROM r JOIN l USING (url) WHERE partition != 'other' GROUP BY partition, url""")
def partitioned_label_maps(spark, sf):
    event = F.col("event_id")
    rows = T.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.when(event % 3 == 0, "train").when(event % 3 == 1, "test").otherwise("other").alias("partition"),
        (event % 2).cast("int").alias("label"), F.col("event_type").alias("language"), "event_id")
    return P.partitioned_label_maps(rows, "event_id")


@query("""SELECT doc_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source FROM documents WHERE lang != 'en'""")
def union_all(spark, sf):
    docs = T.table(spark, sf, "documents")
    return P.union_all(docs.filter("lang = 'en'").select("doc_id", "source"), docs.filter("lang != 'en'").select("source", "doc_id"))


@query("""SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def key_difference(spark, sf):
    return P.key_difference(T.table(spark, sf, "documents"), T.table(spark, sf, "labels"), "doc_id")


@query("""SELECT DISTINCT lang, source FROM documents""")
def distinct_values(spark, sf):
    return P.distinct_values(T.table(spark, sf, "documents"), "lang", "source")


# --- joins ------------------------------------------------------------------------


def _pools(spark, sf):
    """Commits as fixes and others; some are in both with another repository, some in neither."""
    rows = T.commits(spark, sf).select("doc_id", "commit_id", "repo")
    fixes = rows.filter("doc_id % 10 = 0")
    others = rows.filter("doc_id % 4 != 3").withColumn("repo", F.concat(F.lit("copy/"), "repo"))
    return fixes.drop("doc_id"), others.drop("doc_id")


POOLS = f"""{T.COMMITS_SQL}, {T.MAPPING_SQL}, {T.ADVISORY_SQL},
pool AS (SELECT commit_id, repo FROM commits WHERE doc_id % 10 = 0
  UNION ALL SELECT commit_id, 'copy/' || repo FROM commits WHERE doc_id % 4 != 3 AND doc_id % 10 != 0)"""


@query(f"""WITH {POOLS} SELECT cve, commit_id, label, repo, md5("desc") AS "desc" FROM mapping JOIN pool USING (commit_id) JOIN advisory USING (cve)""")
def assemble_pairs(spark, sf):
    pairs = J.assemble_pairs(T.mapping(spark, sf), T.advisory(spark, sf), *_pools(spark, sf))
    return pairs.withColumn("desc", F.md5("desc"))


@query("""WITH m AS (SELECT l_suppkey AS cve, l_orderkey AS commit_id, l_linenumber AS label FROM lineitem),
p AS (SELECT o_orderkey AS commit_id, o_orderstatus AS repo FROM orders WHERE o_orderkey % 1499 != 0),
bad AS (SELECT DISTINCT cve FROM m WHERE commit_id NOT IN (SELECT commit_id FROM p))
SELECT cve, commit_id, label, repo, s_name AS "desc" FROM m JOIN p USING (commit_id) JOIN supplier ON cve = s_suppkey
WHERE cve NOT IN (SELECT cve FROM bad)""")
def assemble_pairs_strict(spark, sf):
    mapping = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cve"), F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("label"))
    pool = T.table(spark, sf, "orders").filter("o_orderkey % 1499 != 0").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderstatus").alias("repo"))
    advisory = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cve"), F.col("s_name").alias("desc"))
    return J.assemble_pairs(mapping, advisory, pool.filter("commit_id % 2 = 0"), pool, strict_group=True)


@query(f"""WITH {T.ITEMS_SQL} SELECT a.cve, a.repo, a.commit_id, a.label, a.similarity, b.f1 FROM items a JOIN
(SELECT * FROM items WHERE f1 > 0.5) b USING (cve, repo, commit_id, label)""")
def merge_scores(spark, sf):
    rows = T.items(spark, sf)
    return J.merge_scores(rows.select(*J.PAIR_KEYS, "similarity"), rows.filter("f1 > 0.5").select(*J.PAIR_KEYS, "f1"))


@query(f"""WITH {T.ITEMS_SQL}, s AS (SELECT * FROM items WHERE f1 > 0.5)
SELECT a.cve, 'acme' AS owner, a.repo, a.commit_id, a.label, coalesce(s.similarity, -1) AS similarity FROM items a LEFT JOIN s USING (cve, repo, commit_id, label)""")
def attach_similarity(spark, sf):
    rows = T.items(spark, sf).withColumn("owner", F.lit("acme"))
    keys = ["cve", "owner", "repo", "commit_id", "label"]
    scored = rows.filter("f1 > 0.5").select(*keys, "similarity")
    return J.attach_similarity(rows.select(*keys), scored, "left").fillna(-1.0, ["similarity"])


@query(f"""WITH {T.MAPPING_SQL}, {T.ADVISORY_SQL} SELECT cve, commit_id, coalesce(md5("desc"), 'none') AS "desc" FROM mapping
LEFT JOIN (SELECT * FROM advisory WHERE cve NOT LIKE '%7') USING (cve)""")
def commits_with_description(spark, sf):
    rows = J.commits_with_description(T.mapping(spark, sf).drop("label"), T.advisory(spark, sf).filter("cve not like '%7'"))
    return rows.withColumn("desc", F.coalesce(F.md5("desc"), F.lit("none")))


@query("""WITH a AS (SELECT lang, row_number() OVER (ORDER BY doc_id) AS row_id FROM documents),
b AS (SELECT role, row_number() OVER (ORDER BY conv_id, turn) AS row_id FROM conversations)
SELECT row_id, coalesce(lang, '') AS lang, coalesce(role, '') AS role FROM a FULL JOIN b USING (row_id)""")
def zip_columns(spark, sf):
    left = J.with_row_id(T.table(spark, sf, "documents").select("doc_id", "lang"), [F.col("doc_id")]).select("row_id", "lang")
    right = J.with_row_id(T.table(spark, sf, "conversations").select("conv_id", "turn", "role"), [F.col("conv_id"), F.col("turn")])
    both = J.zip_columns(left, right.select("row_id", "role"), "row_id").fillna("")
    return both.withColumn("row_id", F.col("row_id").cast("bigint"))


@query("""SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 100 < 5)""")
def filter_in(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "source")
    return J.filter_in(docs, docs.filter("doc_id % 100 < 5"), "source").select("doc_id")


@query(f"""WITH {T.COMMITS_SQL}, {T.MAPPING_SQL}, {T.ADVISORY_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY commit_id) AS "rank" FROM mapping)
SELECT cve, commit_id, md5("desc") AS "desc", md5(diff) AS diff FROM r JOIN advisory USING (cve) JOIN commits USING (commit_id) WHERE "rank" <= 5""")
def assemble_top(spark, sf):
    from fixtrace.operators.ordering import top_k
    top = top_k(T.mapping(spark, sf), ["cve"], [F.col("commit_id")], 5)
    commits = T.commits(spark, sf).select("doc_id", "commit_id", "diff")
    rows = J.assemble_top(top, T.advisory(spark, sf), commits.filter("doc_id % 2 = 0"), commits, 5)
    return rows.select("cve", "commit_id", F.md5("desc").alias("desc"), F.md5("diff").alias("diff"))


@query(f"""WITH {T.MAPPING_SQL}, {T.ADVISORY_SQL}, {T.COMMITS_SQL}
SELECT cve, commit_id, label AS answer, md5("desc") AS "desc", repo FROM mapping JOIN advisory USING (cve) JOIN
(SELECT commit_id, repo FROM commits WHERE doc_id % 6 != 0) USING (commit_id)""")
def verdict_join(spark, sf):
    verdicts = T.mapping(spark, sf).withColumnRenamed("label", "answer")
    known = T.commits(spark, sf).filter("doc_id % 6 != 0").select("commit_id", "repo")
    return J.verdict_join(verdicts, T.advisory(spark, sf), known).withColumn("desc", F.md5("desc"))
