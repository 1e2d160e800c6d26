"""Advisory, commit, candidate and trace tables built from the given test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtrace.functions.text import combined_text
from fixtrace.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread over all cores where they come in fewer pieces than that."""
    return spread(table(spark, sf, "documents"), "doc_id")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, commit_id, repo, commit_message, diff, source, lang."""
    doc, source = F.col("doc_id"), F.col("source")
    digest = F.md5(doc.cast("string"))
    ext = F.when(F.col("lang") == "en", "c").when(F.col("lang") == "de", "py").when(
        F.col("lang") == "fr", "java").otherwise("go")
    path1 = _text("src/", source, "/f", doc % 7, ".", ext)
    path2 = F.when(doc % 15 == 0, path1).otherwise(_text("src/", source, "/g", doc % 3, "_test.", ext))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 3 == 0, " ").when(i % 3 == 1, "+").otherwise("-"), line)), "\n")

    def section(path):
        return _text(
            "diff --git a/", path, " b/", path, "\n", F.when(doc % 11 == 0, "new file mode 100644\n").otherwise(""),
            "index ", F.left(digest, F.lit(7)), "..", F.substr(digest, F.lit(8), F.lit(7)), " 100644\n--- a/", path,
            "\n+++ b/", path, "\n@@ -", doc % 90 + 1, ",3 +", doc % 90 + 1, ",4 @@ fn\n", body)

    diff = _text("commit ", digest, "\n", section(path1),
                 F.when(doc % 5 == 0, F.concat(F.lit("\n"), section(path2))).otherwise(""))
    message = _text(F.substring_index("text", "\n", 1),
                    F.when(doc % 4 == 0, F.concat(F.lit(" fix CVE-2024-"), F.lpad(doc.cast("string"), 5, "0"))).otherwise(""),
                    F.when(doc % 3 == 0, F.concat(F.lit(" see #"), doc.cast("string"))).otherwise(""))
    return texts(spark, sf).select(
        "doc_id", F.concat(digest, F.left(digest, F.lit(8))).alias("commit_id"),
        F.concat(F.lit("acme/"), source).alias("repo"), message.alias("commit_message"), diff.alias("diff"),
        "source", "lang")


COMMITS_SQL = r"""
docs AS (
  SELECT *, md5(doc_id::VARCHAR) AS h,
    CASE lang WHEN 'en' THEN 'c' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'java' ELSE 'go' END AS ext,
    array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
      CASE (i - 1) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || l), chr(10)) AS body
  FROM documents),
pathed AS (
  SELECT *, 'src/' || source || '/f' || (doc_id % 7) || '.' || ext AS path1,
    CASE WHEN doc_id % 15 = 0 THEN 'src/' || source || '/f' || (doc_id % 7) || '.' || ext
         ELSE 'src/' || source || '/g' || (doc_id % 3) || '_test.' || ext END AS path2,
    CASE WHEN doc_id % 11 = 0 THEN 'new file mode 100644' || chr(10) ELSE '' END
      || 'index ' || substr(h, 1, 7) || '..' || substr(h, 8, 7) || ' 100644' || chr(10) AS meta,
    chr(10) || '@@ -' || (doc_id % 90 + 1) || ',3 +' || (doc_id % 90 + 1) || ',4 @@ fn' || chr(10) || body AS hunk
  FROM docs),
commits AS (
  SELECT doc_id, h || substr(h, 1, 8) AS commit_id, 'acme/' || source AS repo,
    string_split(text, chr(10))[1]
      || CASE WHEN doc_id % 4 = 0 THEN ' fix CVE-2024-' || CASE WHEN doc_id < 100000 THEN lpad(doc_id::VARCHAR, 5, '0') ELSE substr(doc_id::VARCHAR, 1, 5) END ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN ' see #' || doc_id ELSE '' END AS commit_message,
    'commit ' || h || chr(10) || 'diff --git a/' || path1 || ' b/' || path1 || chr(10) || meta
      || '--- a/' || path1 || chr(10) || '+++ b/' || path1 || hunk
      || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'diff --git a/' || path2 || ' b/' || path2 || chr(10) || meta
      || '--- a/' || path2 || chr(10) || '+++ b/' || path2 || hunk ELSE '' END AS diff,
    source, lang
  FROM pathed)"""


def advisory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(_cve(F.col("item_id")).alias("cve"), F.col("text").alias("desc"))


def _cve(number: Column) -> Column:
    return F.concat(F.lit("CVE-2023-"), F.lpad(number.cast("string"), 6, "0"))


ADVISORY_SQL = "advisory AS (SELECT 'CVE-2023-' || lpad(item_id::VARCHAR, 6, '0') AS cve, text AS \"desc\" FROM benchmark)"


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """cve, commit_id, label: every document is a candidate of one advisory."""
    items = table(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    digest = F.md5(F.col("doc_id").cast("string"))
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").select(
        _cve(F.col("doc_id") % items).alias("cve"),
        F.concat(digest, F.left(digest, F.lit(8))).alias("commit_id"),
        F.coalesce("toxic", F.lit(0)).alias("label"))


MAPPING_SQL = """
mapping AS (
  SELECT 'CVE-2023-' || lpad((doc_id % (SELECT count(*) FROM benchmark))::VARCHAR, 6, '0') AS cve,
    md5(doc_id::VARCHAR) || substr(md5(doc_id::VARCHAR), 1, 8) AS commit_id, coalesce(toxic, 0) AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""


def commit_texts(spark: SparkSession, sf: str) -> DataFrame:
    """commit_id, text: message and diff as one text."""
    return commits(spark, sf).select("commit_id", combined_text("commit_message", "diff").alias("text"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking input: cve, commit_id, repo, label, score, similarity, f1 and more, about 600 rows per group."""
    line = table(spark, sf, "lineitem")
    # Order, line and part alone come twice now and then.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    return line.select(
        F.col("l_suppkey").cast("string").alias("cve"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", cents).alias("commit_id"),
        F.concat(F.lit("acme/r"), (F.col("l_suppkey") % 7).cast("string")).alias("repo"),
        F.when(F.col("l_partkey") % 211 == 0, 1).otherwise(0).alias("label"),
        F.col("l_extendedprice").alias("score"), (F.col("l_extendedprice") / 100000.0).alias("similarity"),
        (F.col("l_quantity") / 50.0).alias("f1"), (F.col("l_discount") * 10).alias("recall"),
        (F.col("l_tax") * 10).alias("precision"))


ITEMS_SQL = """
items AS (
  SELECT l_suppkey::VARCHAR AS cve, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || round(l_extendedprice * 100)::BIGINT AS commit_id,
    'acme/r' || (l_suppkey % 7) AS repo, CASE WHEN l_partkey % 211 = 0 THEN 1 ELSE 0 END AS label,
    l_extendedprice AS score, l_extendedprice / 100000.0::DOUBLE AS similarity, l_quantity / 50.0::DOUBLE AS f1
  FROM lineitem),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cve ORDER BY score DESC, commit_id) AS "rank" FROM items)"""


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """repo, path, line_no (from 1), line."""
    lines = texts(spark, sf).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
                        (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


LINES_SQL = """
code_lines AS (
  SELECT source AS repo, 'd' || doc_id AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents)"""


def function_spans(spark: SparkSession, sf: str) -> DataFrame:
    """repo, path, start, end, name: blocks of five lines, every third block is no function."""
    lines = table(spark, sf, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).alias("n"))
    blocks = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 5)))).filter("k % 3 != 2")
    return blocks.select(
        F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("k") * 5).cast("bigint").alias("start"), (F.col("k") * 5 + 4).cast("bigint").alias("end"),
        F.concat(F.lit("fn_"), F.col("k").cast("string")).alias("name"))


SPANS_SQL = """
function_spans AS (
  SELECT source AS repo, 'd' || doc_id AS path, k * 5 AS s, k * 5 + 4 AS e, 'fn_' || k AS name
  FROM (SELECT source, doc_id, unnest(range(0, len(string_split(text, chr(10))) // 5 + 1)) AS k FROM documents)
  WHERE k % 3 != 2)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """cve, doc_id, label, score, answer: scored answers over the labelled documents."""
    doc = F.col("doc_id")
    score = F.pmod(doc * 37, F.lit(101)) / 101.0
    return table(spark, sf, "labels").select(
        _text("C", doc % 37).alias("cve"), "doc_id", F.col("quality").alias("label"), score.alias("score"),
        F.when(doc % 3 == 0, "top_10").when(doc % 3 == 1, "random_10").otherwise("all_10").alias("subset"),
        F.when(doc % 2 == 0, "model_a").otherwise("model_b").alias("model"))


PREDICTIONS_SQL = """
predictions AS (
  SELECT 'C' || (doc_id % 37) AS cve, doc_id, quality AS label, (doc_id * 37 % 101) / 101.0::DOUBLE AS score,
    CASE doc_id % 3 WHEN 0 THEN 'top_10' WHEN 1 THEN 'random_10' ELSE 'all_10' END AS subset,
    CASE WHEN doc_id % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS model FROM labels),
judged AS (SELECT *, score >= 0.5 AS answer, label = 1 AS truth FROM predictions)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    return rows.withColumns({"answer": F.col("score") >= 0.5, "label": F.col("label") == 1})


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """trace_id, span_id, start, project."""
    return as_spans(table(spark, sf, "events"))


def as_spans(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"),
                         F.col("ts").cast("timestamp").alias("start"), F.col("event_type").alias("project"))


def fix_links(spark: SparkSession, sf: str) -> DataFrame:
    """cve, urls: one to three fix links per advisory; every seventh has no repository link."""
    doc = F.col("doc_id")

    def link(number):
        digest = F.md5(number.cast("string"))
        return _text("https://github.com/", F.col("source"), "/r", doc % 9, "/commit/", digest, F.left(digest, F.lit(8)))

    urls = F.when(doc % 7 == 0, F.array(_text("https://example.org/", doc))).when(
        doc % 4 == 0, F.array(link(doc), link(doc + 1))).otherwise(F.array(link(doc)))
    return table(spark, sf, "documents").select(_text("CVE-2022-", doc).alias("cve"), urls.alias("urls"))


LINKS_SQL = """
fix_links AS (
  SELECT 'CVE-2022-' || doc_id AS cve, CASE
    WHEN doc_id % 7 = 0 THEN ['https://example.org/' || doc_id]
    WHEN doc_id % 4 = 0 THEN [
      'https://github.com/' || source || '/r' || (doc_id % 9) || '/commit/' || md5(doc_id::VARCHAR) || substr(md5(doc_id::VARCHAR), 1, 8),
      'https://github.com/' || source || '/r' || (doc_id % 9) || '/commit/' || md5((doc_id + 1)::VARCHAR) || substr(md5((doc_id + 1)::VARCHAR), 1, 8)]
    ELSE ['https://github.com/' || source || '/r' || (doc_id % 9) || '/commit/' || md5(doc_id::VARCHAR) || substr(md5(doc_id::VARCHAR), 1, 8)] END AS urls
  FROM documents)"""
