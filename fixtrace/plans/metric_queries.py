"""Checked queries for classification metrics, summaries and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtrace.operators import classification as C
from fixtrace.operators import summaries as R
from fixtrace.operators import training as M
from fixtrace.plans import standins as T
from fixtrace.plans.registry import query
from fixtrace.sources.files import union_results

REPORT = """avg(CASE WHEN answer = truth THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
  coalesce(sum(CASE WHEN answer AND truth THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN answer THEN 1 ELSE 0 END), 0), 0)::DOUBLE AS precision,
  coalesce(sum(CASE WHEN answer AND truth THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN truth THEN 1 ELSE 0 END), 0), 0)::DOUBLE AS recall,
  coalesce(2 * sum(CASE WHEN answer AND truth THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN answer THEN 1 ELSE 0 END) + sum(CASE WHEN truth THEN 1 ELSE 0 END), 0), 0)::DOUBLE AS f1"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def _rounded_sql(sql, *names):
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 9) AS {n}' for n in names)}) FROM ({sql})"


@query("SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def group_sizes(spark, sf):
    return R.group_sizes(T.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS before, count(DISTINCT CASE WHEN l_quantity > 48 THEN l_partkey END) AS after
FROM lineitem GROUP BY l_returnflag""")
def distinct_report(spark, sf):
    rows = T.table(spark, sf, "lineitem")
    return R.distinct_report(rows, rows.filter("l_quantity > 48"), "l_partkey", "l_returnflag")


@query(f"""WITH {T.PREDICTIONS_SQL}, c AS (SELECT cve, bool_and(answer = truth) AS r FROM judged GROUP BY cve)
SELECT count(*) FILTER (r) AS correct_cves, count(*) AS total_cves, avg(CASE WHEN r THEN 1.0::DOUBLE ELSE 0 END) AS cve_accuracy FROM c""")
def advisory_accuracy(spark, sf):
    return C.advisory_accuracy(T.judged(spark, sf))


@query(_rounded_sql(f"WITH {T.PREDICTIONS_SQL} SELECT {REPORT} FROM judged", "accuracy", "precision", "recall", "f1"))
def classification_report(spark, sf):
    return _rounded(C.classification_report(T.judged(spark, sf)), "accuracy", "precision", "recall", "f1")


@query(f"""WITH {T.PREDICTIONS_SQL}, g AS (SELECT unnest([false, true]) AS label), h AS (SELECT unnest([false, true]) AS answer)
SELECT g.label, h.answer, (SELECT count(*) FROM judged j WHERE j.truth = g.label AND j.answer = h.answer) AS n FROM g, h""")
def confusion_matrix(spark, sf):
    return C.confusion_matrix(T.judged(spark, sf))


@query(f"""WITH {T.PREDICTIONS_SQL}, s AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM predictions),
t AS (SELECT sum(CASE WHEN label = 1 THEN r END) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s)
SELECT round((rs - p * (p + 1) / 2) / (p * n), 9) AS auc, p AS positives, n AS negatives FROM t""")
def roc_auc(spark, sf):
    return _rounded(C.roc_auc(T.predictions(spark, sf)), "auc")


@query(f"""WITH {T.PREDICTIONS_SQL}, c AS (SELECT label, least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS s FROM predictions)
SELECT round(avg(-ln(CASE WHEN label = 1 THEN s ELSE 1 - s END)), 9) AS log_loss FROM c""")
def log_loss(spark, sf):
    return _rounded(C.log_loss(T.predictions(spark, sf)), "log_loss")


@query("""SELECT l_orderkey, l_linenumber, l_discount >= 0.05 AS at_least, l_discount > 0.05 AS above, CASE WHEN l_tax > l_discount THEN 1 ELSE 0 END AS class FROM lineitem""")
def threshold(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.threshold("l_discount", 0.05).alias("at_least"),
        C.threshold("l_discount", 0.05, inclusive=False).alias("above"), C.argmax_class("l_discount", "l_tax").alias("class"))


RESULT_ROWS = f"""{T.PREDICTIONS_SQL}, c AS (SELECT subset, model, cve, bool_and(answer = truth) AS r FROM judged GROUP BY ALL),
a AS (SELECT subset, model, count(*) FILTER (r) AS correct_cves, count(*) AS total_cves, avg(CASE WHEN r THEN 1.0::DOUBLE ELSE 0 END) AS cve_accuracy FROM c GROUP BY ALL),
b AS (SELECT subset, model, {REPORT} FROM judged GROUP BY ALL),
result_rows AS (SELECT * FROM a JOIN b USING (subset, model))"""
NUMBERS = ["cve_accuracy", "accuracy", "precision", "recall", "f1"]


@query(_rounded_sql(f"WITH {RESULT_ROWS} SELECT * FROM result_rows", *NUMBERS))
def result_row(spark, sf):
    return _rounded(C.result_row(T.judged(spark, sf)), *NUMBERS)


@query(_rounded_sql(f"WITH {T.PREDICTIONS_SQL} SELECT subset AS phase, accuracy, f1 FROM (SELECT subset, {REPORT} FROM judged GROUP BY subset)", "accuracy", "f1"))
def binary_accuracy_f1(spark, sf):
    return _rounded(C.binary_accuracy_f1(T.judged(spark, sf).withColumnRenamed("subset", "phase")), "accuracy", "f1")


def _results(spark, sf):
    """Result rows of two approaches; the second one lacks a subset."""
    rows = C.result_row(T.judged(spark, sf))
    return union_results({"Agent": rows, "Other": rows.filter("subset != 'all_10'")})


BOTH = f"""{RESULT_ROWS}, results AS (SELECT *, 'Agent' AS approach FROM result_rows UNION ALL SELECT *, 'Other' FROM result_rows WHERE subset != 'all_10')"""


@query(f"""WITH {BOTH}, s AS (SELECT model, subset, count(DISTINCT approach) AS subset_span FROM results GROUP BY ALL),
m AS (SELECT model, sum(subset_span)::BIGINT AS model_span FROM s GROUP BY model)
SELECT model, subset, approach, printf('%.2f', accuracy) AS accuracy, printf('%.2f', precision) AS precision, printf('%.2f', recall) AS recall, printf('%.2f', f1) AS f1,
  model_span, subset_span FROM results JOIN s USING (model, subset) JOIN m USING (model)""")
def result_table(spark, sf):
    return R.result_table(_results(spark, sf))


@query(f"""WITH {BOTH} SELECT model, subset, round(max(accuracy) FILTER (approach = 'Agent'), 9) AS agent_accuracy, round(max(f1) FILTER (approach = 'Agent'), 9) AS agent_f1,
  coalesce(round(max(f1) FILTER (approach = 'Other'), 9), -1) AS other_f1 FROM results GROUP BY model, subset""")
def pivot_metrics(spark, sf):
    wide = R.pivot_metrics(_results(spark, sf), ["Agent", "Other"])
    return wide.select("model", "subset", F.round("Agent_accuracy", 9).alias("agent_accuracy"), F.round("Agent_f1", 9).alias("agent_f1"),
                       F.coalesce(F.round("Other_f1", 9), F.lit(-1.0)).alias("other_f1"))


@query(f"""WITH {T.COMMITS_SQL}, p AS (SELECT unnest(regexp_extract_all(diff, '(?m)^diff --git a/(.*?) b/', 1)) AS path FROM commits),
c AS (SELECT coalesce(nullif(regexp_extract(path, '\\.([^./]*)$', 1), ''), 'none') AS extension, count(*) AS files FROM p GROUP BY 1)
SELECT extension, files, round(files * 100.0::DOUBLE / sum(files) OVER (), 1) AS percent FROM c""")
def extension_histogram(spark, sf):
    return R.extension_histogram(T.commits(spark, sf))


@query("""SELECT coalesce(l_returnflag, 'all') AS model, coalesce(l_linestatus, 'all') AS subset, sum(l_partkey)::BIGINT AS input_tokens,
  sum(l_suppkey)::BIGINT AS output_tokens, sum(CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END)::BIGINT AS embedding_tokens
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def token_usage(spark, sf):
    calls = T.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("subset"), F.col("l_partkey").alias("input_tokens"),
        F.col("l_suppkey").alias("output_tokens"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).cast("bigint").alias("embedding_tokens"))
    return R.token_usage(calls, ["model", "subset"], subtotals=True).fillna("all", ["model", "subset"])


@query("""SELECT source AS repo, sum(n_chars)::BIGINT AS bytes, sum(n_chars) < 100000 AS small FROM documents WHERE doc_id % 9 != 0 GROUP BY source""")
def folder_sizes(spark, sf):
    files = T.table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.when(F.col("doc_id") % 9 == 0, ".gitignore").otherwise("file").alias("name"), F.col("n_chars").alias("size"))
    return R.folder_sizes(files, 100000)


@query("""SELECT label, i - 1 AS position, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL""")
def mean_pool(spark, sf):
    pooled = R.mean_pool(T.table(spark, sf, "embeddings"), "label")
    rows = pooled.select("label", F.posexplode("embedding").alias("position", "value"))
    return rows.select("label", F.col("position").cast("bigint").alias("position"), F.round("value", 6).alias("value"))


@query("""SELECT user_id AS cve, count(value) AS verdicts, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS longest
FROM events GROUP BY user_id""")
def duration_stats(spark, sf):
    rows = R.duration_stats(T.table(spark, sf, "events").select(F.col("user_id").alias("cve"), F.col("value").alias("duration")))
    return rows.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("""WITH b AS (SELECT user_id AS run, event_id AS epoch, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
f AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b)
SELECT run, coalesce(min(CASE WHEN n - last >= 15 THEN epoch END), max(epoch)) AS epoch FROM f GROUP BY run""")
def early_stop_epoch(spark, sf):
    log = T.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return M.early_stop_epoch(log, 15)


@query("""SELECT user_id AS run, arg_min(event_id, (value, event_id)) AS epoch, min(value) AS loss FROM events GROUP BY user_id""")
def best_checkpoint(spark, sf):
    return M.best_checkpoint(T.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss")))


@query("""WITH s AS (SELECT user_id AS run, list({'epoch': event_id, 'recall': value, 'mrr': (event_id * 37 % 101) / 101.0::DOUBLE} ORDER BY event_id) AS steps FROM events GROUP BY user_id),
b AS (SELECT run, list_reduce(list_prepend({'epoch': NULL::BIGINT, 'recall': 0.0::DOUBLE, 'mrr': 0.0::DOUBLE}, steps),
  lambda best, s: CASE WHEN s.recall > best.recall AND s.mrr > best.mrr THEN s ELSE best END) AS best FROM s)
SELECT run, best.epoch AS epoch, best.recall AS recall, best.mrr AS mrr FROM b""")
def best_checkpoint_by_metrics(spark, sf):
    log = T.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("recall"),
                                              (F.col("event_id") * 37 % 101 / 101.0).alias("mrr"))
    return M.best_checkpoint_by_metrics(log)


#: Few rounding errors are left at the optimum: there the mean probability is the share of positives.
FITTED = {"maxIter": 300, "tol": 1e-12, "regParam": 1e-4}


@query("""WITH p AS (SELECT a.label::VARCHAR AS cve, a.vec_id AS commit_id, (a.label = b.label)::INT AS label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT cve, commit_id, label, round(avg(label) OVER (), 5) AS mean_prediction, true AS is_probability FROM p""")
def pair_classifier(spark, sf):
    """Fit on pairs of neighbouring vectors, positive if they share a label, and score them."""
    rows = T.table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("commit_vector"), F.col("label").alias("other"))
    pairs = rows.join(other, "vec_id").select(
        F.col("label").cast("string").alias("cve"), F.col("vec_id").alias("commit_id"),
        (F.col("label") == F.col("other")).cast("int").alias("label"), F.col("embedding").alias("desc_vector"), "commit_vector")
    scored = M.score_pairs(M.fit_pair_classifier(pairs, **FITTED), pairs)
    mean = scored.agg(F.round(F.avg("prediction"), 5)).first()[0]
    return scored.select("cve", "commit_id", "label", F.lit(mean).alias("mean_prediction"), F.col("prediction").between(0, 1).alias("is_probability"))


@query("""WITH p AS (SELECT 'u' || (vec_id // 2)::VARCHAR AS url, (min(label) < 5)::INT AS label FROM embeddings GROUP BY 1)
SELECT url, label, round(avg(label) OVER (), 5) AS mean_prob, true AS is_probability FROM p""")
def commit_classifier(spark, sf):
    """Fit on vectors pooled over pairs of files and score the commits."""
    rows = T.table(spark, sf, "embeddings").select(F.concat(F.lit("u"), F.floor(F.col("vec_id") / 2).cast("string")).alias("url"), "embedding", "label")
    labels = rows.groupBy("url").agg((F.min("label") < 5).cast("int").alias("label"))
    pooled = R.mean_pool(rows, "url").join(labels, "url")
    scored = M.score_commits(M.fit_commit_classifier(pooled, **FITTED), pooled)
    mean = scored.agg(F.round(F.avg("prob"), 5)).first()[0]
    return scored.select("url", "label", F.lit(mean).alias("mean_prob"), F.col("prob").between(0, 1).alias("is_probability"))
