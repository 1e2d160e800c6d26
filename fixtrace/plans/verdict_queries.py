"""Checked queries for corpus search, verdicts, traces, nested records and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from fixtrace.functions.text import json_in_text
from fixtrace.operators import line_index as X
from fixtrace.operators import nested as N
from fixtrace.operators import search as Q
from fixtrace.operators import traces as R
from fixtrace.operators import verdicts as V
from fixtrace.plans import standins as T
from fixtrace.plans.registry import query
from fixtrace.session import reliable, run_folder, shared_folder
from fixtrace.sources import files as IO
from fixtrace.streaming import feeds as S
from fixtrace.streaming import ledger as L


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- search -----------------------------------------------------------------------


def _asked(spark, sf):
    """Searches: the lines and the first sentences of the benchmark texts, whole texts and some short ones."""
    texts = T.table(spark, sf, "benchmark")
    asked = texts.select(F.explode(F.array("text", F.get(F.split("text", "[.]"), F.lit(0)), F.left("text", F.lit(60)), F.right("text", F.lit(5)))).alias("query"))
    return asked.filter("query <> ''").distinct().select("query", F.lit(None).cast("string").alias("path"))


SEARCHED = T.LINES_SQL + """,
asked AS ({asked}),
hits AS (SELECT query, path || ':' || line_no || ':' || line AS answer FROM code_lines JOIN asked ON {test}),
sizes AS (SELECT query, count(answer) AS n FROM asked LEFT JOIN hits USING (query) GROUP BY query)
SELECT query, answer FROM hits JOIN sizes USING (query) WHERE n <= {cap}
UNION ALL SELECT query, CASE WHEN n = 0 THEN 'No matches found for ''' || query || '''.' ELSE '{many}' END FROM sizes WHERE n = 0 OR n > {cap}"""


ASKED = """SELECT DISTINCT query FROM (SELECT unnest([text, split_part(text, '.', 1), left(text, 60), right(text, 5)]) AS query FROM benchmark) WHERE query <> ''"""
CODE_SEARCH = SEARCHED.format(asked=ASKED, test="contains(line, query)", cap=100, many="Too many results found. Please be more specific.")
CODE_SEARCH_ALL = SEARCHED.format(asked=ASKED, test="contains(line, query)", cap=1000000000, many="")


@query("WITH " + CODE_SEARCH)
def code_search(spark, sf):
    return Q.code_search(T.code_lines(spark, sf), _asked(spark, sf), cap=100)


@query("WITH " + CODE_SEARCH_ALL)
def code_search_joined(spark, sf):
    """All hits of every search."""
    return Q.code_search(T.code_lines(spark, sf), _asked(spark, sf))


@query("WITH " + CODE_SEARCH)
def code_search_indexed(spark, sf):
    """The same searches over a stored index of the lines."""
    index = X.build_line_index(T.code_lines(spark, sf), run_folder(spark, "line_index"))
    return X.indexed_search(index, _asked(spark, sf), cap=100)


PATTERNS = [r"^[A-Z][a-z]+ [a-z]+ing ", r"[0-9]{3}-[0-9]{4}", r"[a-f0-9]{40}", r"@[a-z]+[.](com|org)", r"^(The|Le|El|Der) ", r"nowhere.*to.*be.*found"]


@query("WITH " + SEARCHED.format(
    asked="SELECT unnest([" + ", ".join(f"'{p}'" for p in PATTERNS) + "]) AS query", test="regexp_matches(line, query)", cap=100,
    many="Too many files found. Please be more specific."))
def grep(spark, sf):
    return Q.grep(T.code_lines(spark, sf), [(pattern, None) for pattern in PATTERNS], cap=100)


INDEXED_PATTERNS = PATTERNS + [r"(copyright|license|contact).*(reserved|under the)", r"[A-Z]\w+ the [a-z]+ing", r"phone: ?[0-9]+"]


@query("WITH " + SEARCHED.format(
    asked="SELECT unnest([" + ", ".join(f"'{p}'" for p in INDEXED_PATTERNS) + "]) AS query", test="regexp_matches(line, query)", cap=1000000000, many=""))
def grep_indexed(spark, sf):
    """All hits of expressions with and without texts that they need, over a stored index."""
    index = X.build_line_index(T.code_lines(spark, sf), run_folder(spark, "line_index"))
    return X.indexed_grep(index, [(pattern, None) for pattern in INDEXED_PATTERNS])


@query(f"""WITH {T.LINES_SQL}, h AS (SELECT path || ':' || line_no || ':' || line AS t FROM code_lines)
SELECT string_split(t, ':')[1] AS file, string_split(t, ':')[2] AS line, md5(substr(t, length(string_split(t, ':')[1]) + length(string_split(t, ':')[2]) + 3)) AS content FROM h""")
def parse_hits(spark, sf):
    lines = T.code_lines(spark, sf).select(F.concat_ws(":", "path", F.col("line_no").cast("string"), "line").alias("t"))
    return lines.select(Q.parse_hits("t").alias("h")).select("h.file", "h.line", F.md5("h.content").alias("content"))


FILE_QUERIES = ["*.example.com/en/*", "https://m.*", "*/fr/8??", "*/[de]s/*[0-9]5", "EXAMPLE.NET/DE", "nowhere-to-be-found", "http"]


@query("""WITH p AS (SELECT url AS path FROM pages),
q AS (SELECT unnest(['*.example.com/en/*', 'https://m.*', '*/fr/8??', '*/[de]s/*[0-9]5', 'EXAMPLE.NET/DE', 'nowhere-to-be-found', 'http']) AS query),
hits AS (SELECT query, path AS answer FROM p JOIN q ON CASE WHEN regexp_matches(query, '[*?\\[\\]]')
  THEN path GLOB query ELSE contains(lower(path), lower(query)) END),
sizes AS (SELECT query, count(answer) AS n FROM q LEFT JOIN hits USING (query) GROUP BY query)
SELECT query, answer FROM hits JOIN sizes USING (query) WHERE n <= 50
UNION ALL SELECT query, CASE WHEN n = 0 THEN 'No files found matching ''' || query || '''.' ELSE 'Too many files found (more than 50). Please refine your search query.' END
FROM sizes WHERE n = 0 OR n > 50""".replace("\\\\", "\\"))
def file_search(spark, sf):
    return Q.file_search(T.table(spark, sf, "pages").select(F.col("url").alias("path")), FILE_QUERIES, cap=50)


@query("""WITH p AS (SELECT url AS path FROM pages),
q AS (SELECT unnest(['*.example.com/en/*', 'https://m.*', '*/fr/8??', '*/[de]s/*[0-9]5', 'EXAMPLE.NET/DE', 'nowhere-to-be-found', 'http']) AS query),
hits AS (SELECT query, path AS answer FROM p JOIN q ON CASE WHEN regexp_matches(query, '[*?\\[\\]]')
  THEN path GLOB query ELSE contains(lower(path), lower(query)) END),
sizes AS (SELECT query, count(answer) AS n FROM q LEFT JOIN hits USING (query) GROUP BY query)
SELECT query, answer FROM hits
UNION ALL SELECT query, 'No files found matching ''' || query || '''.' FROM sizes WHERE n = 0""".replace("\\\\", "\\"))
def file_search_all(spark, sf):
    """All hits of every search."""
    return Q.file_search(T.table(spark, sf, "pages").select(F.col("url").alias("path")), FILE_QUERIES)


@query(f"""WITH {T.LINES_SQL}, n AS (SELECT path, max(line_no) AS n FROM code_lines GROUP BY path)
SELECT path, line_no, line, 'Viewing lines 11 to ' || least(n, 20) || ' of ' || n || ':' AS header FROM code_lines JOIN n USING (path) WHERE n >= 11 AND line_no BETWEEN 11 AND 20
UNION ALL SELECT path, -1, '', 'Invalid line number. Must be between 1 and ' || n || '.' FROM n WHERE n < 11""")
def page_lines(spark, sf):
    return Q.page_lines(T.code_lines(spark, sf), 11, 10).fillna({"line_no": -1, "line": ""})


@query(f"""WITH {T.LINES_SQL}, n AS (SELECT path, max(line_no) AS n FROM code_lines GROUP BY path), f AS (SELECT path, n, greatest(least(1 + 10, n - 10 + 1), 1) AS f FROM n)
SELECT path, line_no, 'Viewing lines ' || f || ' to ' || least(n, f + 9) || ' of ' || n || ':' AS header FROM code_lines JOIN f USING (path) WHERE line_no BETWEEN f AND f + 9""")
def scroll_down(spark, sf):
    return Q.page_lines(T.code_lines(spark, sf), Q.scroll(1, "down", 10), 10).drop("line")


# --- verdicts ---------------------------------------------------------------------


def _length_model(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: answers by text length, fails on some rows."""
    if (rows["doc_id"] % 50 == 7).any():
        raise ValueError("model failed")
    return pd.DataFrame({"score": rows["text"].str.len() / 1000.0})


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN -1 ELSE length(text) / 1000.0::DOUBLE END AS score,
  CASE WHEN doc_id % 50 = 7 THEN 'model failed' ELSE '' END AS error FROM documents""")
def score_with(spark, sf):
    scored = V.score_with(T.texts(spark, sf).select("doc_id", "text"), _length_model, "score double", on_error="keep")
    return scored.drop("text").fillna({"score": -1.0, "error": ""})


def _summarise(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"summary": rows["diff"]})


def _embed(rows: pd.DataFrame) -> pd.DataFrame:
    letters = "aeinorst"
    return pd.DataFrame({"embedding": [[s.lower().count(c) / 10.0 for c in letters] for s in rows["summary"]]})


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"answer": [
        '{"analysis": "stub", "vulnerability_fix": %s}' % ("true" if len(s) % 2 else "false")
        for s in rows["history_document"]]})


@query(f"""WITH {T.COMMITS_SQL}, {T.MAPPING_SQL},
e AS (SELECT cve, commit_id, label, diff AS s, list_transform(string_split('aeinorst', ''), lambda c:
  (length(diff) - length(replace(lower(diff), c, ''))) / 10.0::DOUBLE) AS v FROM mapping JOIN commits USING (commit_id)),
p AS (SELECT q.cve, q.commit_id, s.commit_id AS sid, s.cve AS history_cve, s.s AS doc,
  round(list_sum(list_transform(range(1, 9), lambda i: (q.v[i] - s.v[i]) * (q.v[i] - s.v[i]))), 9) AS d FROM e q JOIN e s ON s.label = 1 AND q.cve != s.cve)
SELECT cve, commit_id, arg_min(history_cve, (d, sid)) AS history_cve, length(arg_min(doc, (d, sid))) % 2 = 1 AS vulnerability_fix FROM p GROUP BY cve, commit_id""")
def three_stage(spark, sf):
    """Summaries (here the whole diffs), nearest past fix and verdicts with stubs for the models; past fixes are the positives."""
    commits = T.commits(spark, sf).select("commit_id", "diff")
    candidates = T.mapping(spark, sf).join(commits, "commit_id")
    fixes = V.score_with(V.score_with(candidates.filter("label = 1"), _summarise, "summary string", "skip"), _embed, "embedding array<double>", "skip")
    store = reliable(fixes).select(F.col("commit_id").alias("id"), F.col("cve").alias("key"), F.col("embedding").alias("vector"), F.col("summary").alias("document"))
    judged = V.three_stage(candidates.select("cve", "commit_id", "diff"), store, T.advisory(spark, sf), _summarise, _embed, _judge)
    read = json_in_text("answer", "analysis string, vulnerability_fix boolean")
    return judged.select("cve", "commit_id", "history_cve", read["value"]["vulnerability_fix"].alias("vulnerability_fix"))


@query("""WITH f AS (SELECT l_orderkey AS commit_id, 'f' || l_linenumber AS path, CASE WHEN l_quantity > 35 THEN 1 ELSE 0 END AS relevant FROM lineitem),
s AS (SELECT commit_id, count(*) AS n, sum(relevant) AS w FROM f GROUP BY commit_id)
SELECT commit_id, path, (CASE WHEN n = 1 OR w = 1 THEN 1 WHEN w > 1 THEN 2 ELSE 0 END)::INTEGER AS class FROM f JOIN s USING (commit_id) WHERE n = 1 OR w = 0 OR relevant = 1""")
def select_relevant_files(spark, sf):
    files = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"),
        (F.col("l_quantity") > 35).cast("int").alias("relevant"))
    return V.select_relevant_files(files)


GATES = """f AS (SELECT l_orderkey AS commit_id, l_linenumber AS file_order, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS answer, l_partkey % 10 AS fn FROM lineitem),
gates AS (SELECT commit_id, min(CASE WHEN answer != 1 THEN file_order END) AS file_order FROM f GROUP BY commit_id)"""


def _gate_files(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("file_order"),
        (F.col("l_quantity") > 10).cast("int").alias("answer"), (F.col("l_partkey") % 10).alias("function"))


@query(f"""WITH {GATES} SELECT commit_id, CASE WHEN file_order IS NULL THEN 'local' ELSE 'context' END AS gate, coalesce(file_order, 0)::INTEGER AS file_order FROM gates""")
def impact_gate(spark, sf):
    return V.impact_gate(_gate_files(spark, sf)).fillna(0, ["file_order"])


@query(f"""WITH {GATES} SELECT DISTINCT commit_id, fn AS "function" FROM f JOIN gates USING (commit_id, file_order)""")
def gate_functions(spark, sf):
    files = _gate_files(spark, sf)
    return V.gate_functions(V.impact_gate(files), files.select("commit_id", "file_order", "function"))


def _records(spark, sf):
    rows = T.predictions(spark, sf).select(
        "cve", F.col("doc_id").cast("string").alias("commit_id"), "label", F.when(F.col("score") > 0.5, "True").otherwise("no").alias("answer"),
        F.pmod("doc_id", F.lit(5)).cast("int").alias("confidence"), "model", "subset")
    return V.build_verdict_record(rows, ["answer", "confidence"], ["model", "subset"])


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT '{{"input":{{"cve":"' || cve || '","commit_id":"' || doc_id || '","label":' || label || '}},"output":{{"answer":"'
  || CASE WHEN score > 0.5 THEN 'True' ELSE 'no' END || '","confidence":' || doc_id % 5 || '}},"metadata":{{"model":"' || model || '","subset":"' || subset || '"}}}}' AS record FROM predictions""")
def build_verdict_record(spark, sf):
    return _records(spark, sf).select(F.to_json(F.struct("input", "output", "metadata")).alias("record"))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT cve, doc_id::VARCHAR AS commit_id, score > 0.5 AS answer, label = 1 AS label, (doc_id % 5)::INTEGER AS confidence,
  (score > 0.5) = (label = 1) AS correct FROM predictions""")
def flatten_verdicts(spark, sf):
    return V.flatten_verdicts(_records(spark, sf))


@query("""WITH s AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id), l AS (SELECT arg_max(user_id, (t, user_id)) AS u FROM s)
SELECT DISTINCT user_id AS trace_id, event_id AS span_id FROM events, l WHERE user_id = u""")
def latest_trace(spark, sf):
    return R.latest_trace(T.spans(spark, sf))


@query("""SELECT user_id AS trace_id, event_id AS span_id, event_type AS project FROM events""")
def traces_by_project(spark, sf):
    path = _folder(spark, "traces")
    IO.write_traces_by_project(T.spans(spark, sf), path)
    return spark.read.schema("trace_id bigint, span_id bigint, project string").json(path)


# --- nested records ---------------------------------------------------------------


def _payloads(spark, sf):
    """An advisory record per order: scores, weaknesses, references and configurations from its few lines."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    line = T.table(spark, sf, "lineitem").select("l_orderkey", *fields)

    def ordered(entry, flag=None):
        lines = F.col("lines") if flag is None else F.filter("lines", lambda line: line["l_returnflag"] == flag)
        return F.sort_array(F.transform(lines, lambda line: F.struct(
            line["l_linenumber"].alias("l_linenumber"), line["l_partkey"].alias("l_partkey"), line["l_suppkey"].alias("l_suppkey"), entry(line).alias("e")))).getField("e")

    def scores(flag, old=False):
        def entry(line):
            severity = F.concat(F.lit("S"), line["l_linenumber"].cast("string")).alias("baseSeverity")
            data = [F.lit(f"{flag}").alias("version"), F.concat(F.lit("AV:"), line["l_partkey"].cast("string")).alias("vectorString"), line["l_quantity"].alias("baseScore")]
            common = [F.lit("src").alias("source"), F.lit("Primary").alias("type"), line["l_discount"].alias("exploitabilityScore"), line["l_tax"].alias("impactScore")]
            return F.struct(*common, *([severity] if old else []), F.struct(*data, *([] if old else [severity])).alias("cvssData"))
        return ordered(entry, flag)

    def weakness(line):
        return F.struct(F.lit("src").alias("source"), F.lit("Secondary").alias("type"), F.array(
            F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")),
            F.struct(F.lit("en").alias("lang"), F.concat(F.lit("CWE-"), line["l_suppkey"].cast("string")).alias("value"))).alias("description"))

    def reference(line):
        return F.struct(F.concat(F.lit("https://r/"), line["l_partkey"].cast("string")).alias("url"), F.lit("src").alias("source"),
                        F.when(line["l_linestatus"] == "O", F.array(F.lit("Patch"), F.lit("Vendor"))).alias("tags"))

    def product(line):
        return F.struct(F.concat(F.lit("cpe:*:"), line["l_partkey"].cast("string")).alias("criteria"),
                        F.when(line["l_returnflag"] == "A", line["l_linenumber"].cast("string")).alias("versionStartIncluding"),
                        F.when(line["l_returnflag"] != "N", line["l_suppkey"].cast("string")).alias("versionEndExcluding"))

    # An order has a handful of lines, whatever the size of the table. Only their plain values move; records are made in the row.
    grouped = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(*fields)).alias("lines"))
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    joined = grouped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({
        "cvssMetricV31": scores("A"), "cvssMetricV30": scores("R"), "cvssMetricV2": scores("N", True),
        "weaknesses": ordered(weakness), "references": ordered(reference), "cpeMatch": ordered(product)})
    node = F.struct(F.lit("OR").alias("operator"), (F.col("l_orderkey") % 2 == 0).alias("negate"), "cpeMatch")
    cve = F.struct(
        F.col("l_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("sourceIdentifier"), F.lit("2024").alias("published"),
        F.lit("2025").alias("lastModified"), F.col("o_orderstatus").alias("vulnStatus"),
        F.array(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("value"))).alias("descriptions"),
        F.struct("cvssMetricV31", "cvssMetricV30", "cvssMetricV2").alias("metrics"), "weaknesses", "references",
        F.array(F.struct(F.array(node).alias("nodes"))).alias("configurations"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("cisaVulnerabilityName"),
        F.when(F.col("o_orderstatus") == "F", "2020-01-01").alias("cisaExploitAdd"), F.when(F.col("o_orderstatus") == "F", "2020-02-01").alias("cisaActionDue"),
        F.when(F.col("o_orderstatus") == "F", "Patch").alias("cisaRequiredAction"))
    return joined.select(F.col("l_orderkey").alias("cve"), F.to_json(F.struct(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))).alias("payload"))


def _advisories(spark, sf):
    """Payloads are stored first, as a feed of records would be."""
    return N.parse_advisories(IO.save_stage(_payloads(spark, sf), _folder(spark, "payloads")))


LINES = "l AS (SELECT l.* FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"


@query(f"""WITH {LINES} SELECT l_orderkey AS cve, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS place,
  l_returnflag AS version, 'Primary' AS type, 'src' AS source, 'S' || l_linenumber AS severity, l_quantity AS score, l_discount AS exploitability, l_tax AS impact,
  'AV:' || l_partkey AS vector FROM l""")
def advisory_scores(spark, sf):
    return N.advisory_scores(_advisories(spark, sf))


@query(f"""WITH {LINES} SELECT l_orderkey AS cve, 'CWE-' || l_suppkey AS weakness, 'Secondary' AS type, 'src' AS source FROM l""")
def advisory_weaknesses(spark, sf):
    return N.advisory_weaknesses(_advisories(spark, sf))


@query(f"""WITH {LINES} SELECT l_orderkey AS cve, 'https://r/' || l_partkey AS url, CASE WHEN l_linestatus = 'O' THEN 'Patch, Vendor' ELSE '' END AS tags, 'src' AS source FROM l""")
def advisory_references(spark, sf):
    return N.advisory_references(_advisories(spark, sf))


@query(f"""WITH {LINES} SELECT l_orderkey AS cve, 1::INTEGER AS configuration, 1::INTEGER AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS product,
  'OR' AS operator, l_orderkey % 2 = 0 AS negate, 'cpe:*:' || l_partkey AS criteria, CASE WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR ELSE '' END AS version_start,
  l_returnflag = 'A' AS start_included, CASE WHEN l_returnflag != 'N' THEN l_suppkey::VARCHAR ELSE '' END AS version_end, false AS end_included FROM l""")
def affected_versions(spark, sf):
    return N.affected_versions(_advisories(spark, sf)).fillna("", ["version_start", "version_end"])


@query("""SELECT DISTINCT o_orderkey AS cve, o_orderstatus = 'F' AS exploited, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS name,
  CASE WHEN o_orderstatus = 'F' THEN '2020-01-01' ELSE '' END AS added, CASE WHEN o_orderstatus = 'F' THEN '2020-02-01' ELSE '' END AS due,
  CASE WHEN o_orderstatus = 'F' THEN 'Patch' ELSE '' END AS action FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def known_exploited(spark, sf):
    return N.known_exploited(_advisories(spark, sf)).fillna("")


@query(f"""WITH {LINES}, s AS (SELECT l_orderkey, string_agg('#### CVSS ' || l_returnflag || ' Score - Primary - src' || chr(10) || chr(10) || 'Base Severity: S' || l_linenumber || ' - ' || l_quantity
    || ' (Exploitability: ' || l_discount || ', Impact: ' || l_tax || ')' || chr(10) || 'Vector: [AV:' || l_partkey || '](' || CASE l_returnflag
      WHEN 'A' THEN 'https://www.first.org/cvss/calculator/3.1#AV:' || l_partkey WHEN 'R' THEN 'https://www.first.org/cvss/calculator/3.0#AV:' || l_partkey
      ELSE 'https://nvd.nist.gov/vuln-metrics/cvss/v2-calculator?vector=(AV:' || l_partkey || ')' END || ')', chr(10) || chr(10)
      ORDER BY CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey) AS scores,
    string_agg(chr(10) || '| [[CWE-' || l_suppkey || ']] | Secondary | src |', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS weak,
    string_agg(chr(10) || '| [https://r/' || l_partkey || '](https://r/' || l_partkey || ') | ' || CASE WHEN l_linestatus = 'O' THEN 'Patch, Vendor' ELSE '' END || ' | src |', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS refs,
    string_agg(chr(10) || '- cpe:\\*:' || l_partkey || CASE WHEN l_returnflag = 'A' THEN chr(10) || '  - Start Version:  ' || l_linenumber || ' (Including)' ELSE '' END
      || CASE WHEN l_returnflag != 'N' THEN chr(10) || '  - End Version: ' || l_suppkey || ' (Excluding)' ELSE '' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS products
  FROM l GROUP BY l_orderkey)
SELECT l_orderkey AS cve, md5(chr(10) || '## CVE Details' || chr(10) || chr(10) || 'ID: ' || l_orderkey || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '<font color="red">KNOWN EXPLOITED VULNERABILITY</font>' || chr(10)
    || 'CISA Details: ' || o_orderpriority || ', Added: [[2020-01-01]], Action: Patch, Due: [[2020-02-01]]'
    ELSE 'As of 01/31/2025, this issue is not currently on the CISA Known Exploited Vulnerabilities List' END
  || chr(10) || 'Source Identifier: ' || o_orderpriority || chr(10) || 'Published: 2024' || chr(10) || 'Last Modified: 2025' || chr(10) || 'Status: ' || o_orderstatus || chr(10) || chr(10)
  || '### Scores' || chr(10) || chr(10) || scores || chr(10) || chr(10) || '### Description' || chr(10) || chr(10) || 'Order ' || l_orderkey || chr(10) || chr(10)
  || '### Evaluator Notes' || chr(10) || chr(10) || 'None provided' || chr(10) || chr(10) || '### Weaknesses' || chr(10) || chr(10) || '| Weakness | Type | Source |' || chr(10) || '| --- | --- | --- |' || weak || chr(10) || chr(10)
  || '### Vendor Comments' || chr(10) || chr(10) || 'No vendor comments' || chr(10) || chr(10) || '### References' || chr(10) || chr(10) || '| URL | Tags | Source |' || chr(10) || '| --- | --- | --- |' || refs || chr(10) || chr(10)
  || '### Configurations' || chr(10) || chr(10) || '#### Configuration 1 (Operator: OR, Negate: ' || CASE WHEN l_orderkey % 2 = 0 THEN 'True' ELSE 'False' END || ')' || chr(10) || chr(10) || '##### Node 1' || chr(10)
  || products || chr(10)) AS digest FROM s JOIN orders ON l_orderkey = o_orderkey""")
def advisory_report(spark, sf):
    return N.advisory_report(_advisories(spark, sf), "01/31/2025").select("cve", F.md5("report").alias("digest"))


@query("""SELECT p_partkey AS cwe, md5(chr(10) || '## CVE Details' || chr(10) || p_partkey || ': ' || p_name || chr(10) || 'Weakness ID: ' || p_partkey || chr(10) || 'Vulnerability Mappping: Usage: Allowed, Rationale: '
  || p_brand || chr(10) || 'Abstraction: Base' || chr(10) || chr(10) || '### Description' || chr(10) || p_type || chr(10) || chr(10) || '### Common Consequences' || chr(10) || '* Scope: a, ' || p_size || chr(10)
  || '  * Impact: high' || chr(10) || chr(10) || '### Relationships' || chr(10) || '* ChildOf: CWE-' || p_size || chr(10) || chr(10)) AS digest FROM part""")
def weakness_report(spark, sf):
    size = F.col("p_size").cast("string")
    record = F.struct(
        F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("Name"), F.lit("Base").alias("Abstraction"), F.col("p_type").alias("Description"),
        F.array(F.struct(F.array(F.lit("a"), size).alias("Scope"), F.array(F.lit("high")).alias("Impact"))).alias("Consequences"),
        F.array(F.struct(F.lit("M1").alias("MitigationID"), F.lit("left out in this view").alias("Description"))).alias("Mitigations"),
        F.array(F.struct(F.lit("ChildOf").alias("Nature"), size.alias("CweID")), F.struct(F.lit("PeerOf").alias("Nature"), F.lit(None).cast("string").alias("CweID"))).alias("RelatedWeaknesses"),
        F.struct(F.lit("Allowed").alias("Usage"), F.col("p_brand").alias("Rationale")).alias("MappingNotes"))
    payload = F.to_json(F.struct(F.array(record).alias("Weaknesses")))
    rows = T.table(spark, sf, "part").select(F.col("p_partkey").alias("cwe"), payload.alias("payload"))
    return N.weakness_report(rows, "conceptual").select("cwe", F.md5("report").alias("digest"))


@query(f"""WITH {T.LINKS_SQL} SELECT cve, array_to_string(urls, ' ') AS urls FROM fix_links""")
def ground_truth(spark, sf):
    """Advisory dictionaries as JSON, one advisory per line, read back into rows."""
    path = _folder(spark, "truth")
    entry = F.map_from_arrays(F.array("cve"), F.array(F.struct(F.struct(F.col("urls").alias("commit")).alias("ground_truth"))))
    T.fix_links(spark, sf).select(F.to_json(entry).alias("value")).write.text(path)
    return IO.read_ground_truth(spark, path).select("cve", F.array_join("urls", " ").alias("urls"))


# --- streams ----------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = T.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT event_id, user_id, value > 10 AS answer FROM events""")
def stream_verdicts(spark, sf):
    path = _folder(spark, "verdicts")

    def judge(batch):
        return batch.select("event_id", "user_id", (F.col("value") > 10).alias("answer"))

    for run in range(2):
        # The second run starts over with a new checkpoint and finds everything done.
        S.stream_verdicts(_event_stream(spark, sf), judge, path, f"{path}-progress{run}", ("event_id",)).awaitTermination()
    return spark.read.parquet(path)


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT event_id, user_id, value > 10 AS answer FROM events""")
def stream_verdicts_once(spark, sf):
    """The first attempt at a batch is lost after its files are written; a second stream starts over."""
    path = _folder(spark, "verdicts_once")

    def judge(batch):
        return batch.select("event_id", "user_id", (F.col("value") > 10).alias("answer"))

    events, lost = T.table(spark, sf, "events"), "stream=lost/batch=0/attempt=a0"
    events.select("event_id", F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/keys/{lost}")
    judge(events).write.parquet(f"{path}/rows/{lost}")
    for run in range(2):
        L.stream_verdicts_once(_event_stream(spark, sf), judge, path, f"{path}-progress{run}", ("event_id",)).awaitTermination()
    return L.committed(spark, path).select("event_id", "user_id", "answer")


@query("""SELECT DISTINCT user_id AS trace_id, event_id AS span_id FROM events""")
def stream_traces(spark, sf):
    path = _folder(spark, "spans")
    spans = S.stream_traces(T.as_spans(_event_stream(spark, sf)))
    return S.drain(spans, path, f"{path}-progress").select("trace_id", "span_id")


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events),
f(key, t) AS (SELECT key, min(t) FROM r GROUP BY key
  UNION ALL SELECT f.key, (SELECT min(r.t) FROM r WHERE r.key = f.key AND r.t >= f.t + 86400000000) FROM f
    WHERE EXISTS (SELECT 1 FROM r WHERE r.key = f.key AND r.t >= f.t + 86400000000))
SELECT key, r.t AS asked_us, (SELECT max(f.t) FROM f WHERE f.key = r.key AND f.t <= r.t) AS fetched_us FROM r""")
def stream_ttl_dedupe(spark, sf):
    path = _folder(spark, "reports")
    requests = _event_stream(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("asked_at"))
    served = S.drain(S.stream_ttl_dedupe(requests, 86400), path, f"{path}-progress")
    return served.select("key", F.unix_micros("asked_at").alias("asked_us"), F.unix_micros("fetched_at").alias("fetched_us"))


@query("""SELECT epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS n FROM events GROUP BY 1""")
def progress_counts(spark, sf):
    path = _folder(spark, "progress")
    events = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"))
    counts = S.drain_complete(S.progress_counts(events), path, f"{path}-progress")
    return counts.select(F.unix_micros("window_start").alias("day_us"), "n")
