"""Checked queries for the text, diff and link functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtrace.functions import diff as D
from fixtrace.functions import hashing as H
from fixtrace.functions import text as X
from fixtrace.plans import standins as T
from fixtrace.plans.registry import query

# Lines with their file number, hunk state and place, for the SQL forms of the diff functions.
DIFF_LINES = T.COMMITS_SQL + r""",
diff_lines AS (
  SELECT doc_id, unnest(string_split(diff, chr(10))) AS line,
    unnest(range(1, len(string_split(diff, chr(10))) + 1)) AS n FROM commits),
marked AS (
  SELECT *, starts_with(line, '@@') AS is_hunk, starts_with(line, 'diff --git') AS is_file,
    sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS file_no,
    sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS hunks
  FROM diff_lines),
hunked AS (
  SELECT *, sum(CASE WHEN is_hunk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, file_no ORDER BY n) AS file_hunks
  FROM marked),
bodies AS (
  SELECT doc_id, file_no, string_agg(line, chr(10) ORDER BY n) AS body FROM hunked
  WHERE file_no > 0 AND file_hunks > 0 GROUP BY doc_id, file_no),
heads AS (
  SELECT doc_id, file_no, trim(regexp_extract(line, 'diff --git a/(.+?) b/(.+)', 2)) AS path, line
  FROM hunked WHERE is_file),
file_texts AS (
  SELECT doc_id, path, min(file_no) AS place, arg_max(trim(body, E' \n\t\r\f\v'), file_no) AS text
  FROM heads JOIN bodies USING (doc_id, file_no) WHERE path != '' GROUP BY doc_id, path)"""

CODE = r"""
coded AS (
  SELECT doc_id, path, place,
    list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '+')),
      lambda l: trim(substr(l, 2), E' \n\t\r\f\v')),
      lambda l: NOT regexp_matches(l, '^(//|/\*|\*|#)')) AS added,
    list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '-')),
      lambda l: trim(substr(l, 2), E' \n\t\r\f\v')),
      lambda l: NOT regexp_matches(l, '^(//|/\*|\*|#)')) AS removed
  FROM file_texts)"""


@query(f"""WITH {DIFF_LINES}
SELECT doc_id, md5(string_agg(CASE WHEN is_hunk THEN
    regexp_replace(line, '^@@ -(\\d+),?(\\d*) \\+(\\d+),?(\\d*) @@.*$', '@@ -\\1,0 +\\3,0 @@') ELSE line END,
    chr(10) ORDER BY n)) AS digest, count(*) AS lines
FROM marked WHERE hunks = 0 OR is_hunk OR starts_with(line, '+') OR starts_with(line, '-') OR is_file
  OR starts_with(line, 'index') GROUP BY doc_id""")
def unified_zero(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", D.unified_zero("diff").alias("d"))
    return rows.select("doc_id", F.md5("d").alias("digest"), F.size(F.split("d", "\n")).cast("bigint").alias("lines"))


@query(f"""WITH {DIFF_LINES}
SELECT doc_id, md5(trim(string_agg(part, chr(10) ORDER BY file_no), E' \\n\\t\\r\\f\\v')) AS digest FROM (
  SELECT h.doc_id, h.file_no, h.line || coalesce(chr(10) || b.body, '') AS part
  FROM heads h LEFT JOIN bodies b ON h.doc_id = b.doc_id AND h.file_no = b.file_no) GROUP BY doc_id""")
def minimal_diff(spark, sf):
    return T.commits(spark, sf).select("doc_id", F.md5(D.minimal_diff("diff")).alias("digest"))


@query(f"""WITH {T.COMMITS_SQL}
SELECT doc_id, md5(array_to_string(string_split(diff, chr(10))[1:20], chr(10))) AS digest FROM commits""")
def head_lines(spark, sf):
    return T.commits(spark, sf).select("doc_id", F.md5(X.head_lines("diff", 20)).alias("digest"))


@query(f"""WITH {DIFF_LINES},
parts AS (
  SELECT h.doc_id, h.file_no, h.path, regexp_extract(h.line, 'diff --git a/(.+?) b/(.+)', 1) AS a, b.body
  FROM heads h JOIN bodies b USING (doc_id, file_no)),
kept AS (
  SELECT * FROM parts WHERE NOT contains(lower(a), 'test') AND NOT contains(lower(path), 'test')
  AND length(trim(array_to_string(list_transform(list_filter(string_split(body, chr(10)),
    lambda l: starts_with(l, '+') OR starts_with(l, '-')), lambda l: trim(substr(l, 2), E' \\n\\t\\r\\f\\v')), ''),
    E' \\n\\t\\r\\f\\v')) > 0),
joined AS (
  SELECT doc_id, count(*) AS files, trim('Commit Message: ' || chr(10) ||
    string_agg(chr(10) || 'a/' || a || chr(10) || 'b/' || path || chr(10) || body || chr(10), '' ORDER BY file_no),
    E' \\n\\t\\r\\f\\v') AS t FROM (
    -- The line end before the next file belongs to that file's command.
    SELECT * FROM kept) GROUP BY doc_id)
SELECT c.doc_id, md5(coalesce(t, 'PatchMinErrorType.EMPTY_CHANGE')) AS digest FROM commits c LEFT JOIN joined USING (doc_id)""")
def minimise_patch(spark, sf):
    return T.commits(spark, sf).select("doc_id", F.md5(D.minimise_patch("diff")).alias("digest"))


@query(f"""WITH {DIFF_LINES}
SELECT doc_id, path, md5(text) AS digest, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS place FROM file_texts""")
def file_diffs(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", F.posexplode_outer(D.file_diffs("diff")).alias("place", "f")).filter("f is not null")
    return rows.select("doc_id", "f.path", F.md5("f.text").alias("digest"), (F.col("place") + 1).cast("bigint").alias("place"))


@query(f"""WITH {DIFF_LINES}, {CODE}
SELECT doc_id, path, md5(array_to_string(list_transform(added, lambda l: l || chr(10)), '')) AS added,
  md5(array_to_string(list_transform(removed, lambda l: l || chr(10)), '')) AS removed FROM coded""")
def code_version(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", F.inline_outer(D.file_diffs("diff"))).filter("path is not null")
    return rows.select("doc_id", "path", F.md5(D.code_version("text", True)).alias("added"),
                       F.md5(D.code_version("text", False)).alias("removed"))


@query(f"""WITH {DIFF_LINES}, {CODE}
SELECT doc_id, path, md5(array_to_string(list_transform(added, lambda l: l || chr(10)), '') || '</s>'
  || array_to_string(list_transform(removed, lambda l: l || chr(10)), '')) AS digest
FROM coded WHERE len(added) > 0 OR len(removed) > 0""")
def file_code(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", F.inline_outer(D.file_code("diff", "</s>"))).filter("path is not null")
    return rows.select("doc_id", "path", F.md5("code").alias("digest"))


@query(f"""WITH {DIFF_LINES}
SELECT doc_id, n AS place, regexp_extract(p, '([^/]*)$', 1) AS filename, regexp_extract(p, '\\.([^./]*)$', 1) AS extension
FROM (SELECT doc_id, file_no::BIGINT AS n, regexp_extract(line, 'diff --git a/(.*?) b/', 1) AS p FROM heads)""")
def files_and_extensions(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", F.posexplode_outer(D.files_and_extensions("diff")).alias("at", "f")).filter("f is not null")
    return rows.select("doc_id", (F.col("at") + 1).cast("bigint").alias("place"), "f.filename", "f.extension")


@query(r"""SELECT doc_id, regexp_extract(text, '\b[a-fA-F0-9]{40}\b') AS hash FROM documents
WHERE regexp_matches(text, '\b[a-fA-F0-9]{40}\b')""")
def commit_hash(spark, sf):
    found = T.texts(spark, sf).select("doc_id", X.commit_hash("text").alias("hash"))
    return found.filter("hash is not null")


@query(f"""WITH {T.LINKS_SQL}, links AS (SELECT cve, unnest(urls) AS url FROM fix_links)
SELECT cve, url, nullif(regexp_extract(url, 'https?://github\\.com/([^/]+)/([^/]+)', 1), '') AS owner,
  nullif(regexp_extract(url, 'https?://github\\.com/([^/]+)/([^/]+)', 2), '') AS name FROM links""")
def github_repo(spark, sf):
    links = T.fix_links(spark, sf).select("cve", F.explode("urls").alias("url"))
    repo = X.github_repo("url")
    return links.select("cve", "url", repo["owner"].alias("owner"), repo["name"].alias("name"))


@query(f"""WITH {T.LINKS_SQL}, links AS (SELECT DISTINCT unnest(urls) AS url FROM fix_links),
api AS (SELECT url, replace(replace(url, 'github.com', 'api.github.com/repos'), 'commit', 'commits') AS api_url FROM links)
SELECT url, api_url, string_split(api_url, '/')[5] AS owner, string_split(api_url, '/')[6] AS repo,
  string_split(api_url, '/')[8] AS commit_id, 'https://github.com/' || regexp_extract(url, 'github\\.com[:/](.+?)/commit', 1) || '.git' AS clone_url,
  replace(url, string_split(url, '/')[7], 'parent0') AS parent_url
FROM api WHERE url LIKE '%github%'""")
def commit_link(spark, sf):
    links = T.fix_links(spark, sf).select(F.explode("urls").alias("url")).distinct().filter(F.contains("url", F.lit("github")))
    return links.select("url", X.commit_link("url").alias("l"), X.clone_url("url").alias("clone_url"),
                        X.parent_raw_url("url", F.lit("parent0")).alias("parent_url")).select("url", "l.*", "clone_url", "parent_url")


@query(f"""WITH {T.COMMITS_SQL}, n AS (SELECT doc_id, repo, nullif(regexp_extract(commit_message, '#(\\d+)', 1), '') AS number FROM commits)
SELECT doc_id, number, 'https://api.github.com/repos/' || repo || '/issues/' || number AS issue_url,
  'https://api.github.com/repos/' || repo || '/pulls/' || number AS pull_url FROM n WHERE number IS NOT NULL""")
def issue_ref(spark, sf):
    owner, name = F.split_part("repo", F.lit("/"), F.lit(1)), F.split_part("repo", F.lit("/"), F.lit(2))
    rows = T.commits(spark, sf).select("doc_id", X.issue_ref("commit_message", owner, name).alias("r"))
    return rows.filter("r is not null").select("doc_id", "r.*")


@query(f"""WITH {T.COMMITS_SQL}, words AS (
  SELECT doc_id, w, unnest(range(1, len(ws) + 1)) AS n FROM (SELECT doc_id, unnest(ws) AS w, ws FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(diff, '\\s+'), lambda w: regexp_full_match(w, '-\\d+,\\d+[^\\s,]*')) AS ws FROM commits)))
SELECT doc_id, count(*) AS hunks, sum(regexp_extract(w, '^-(\\d+)', 1)::BIGINT + 3)::BIGINT AS total FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(diff, '\\s+'), lambda w: regexp_full_match(w, '-\\d+,\\d+[^\\s,]*'))) AS w FROM commits)
GROUP BY doc_id""")
def hunk_old_lines(spark, sf):
    rows = X.explode_once(T.commits(spark, sf), ["doc_id"], D.hunk_old_lines("diff"), "line")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hunks"), F.sum("line").alias("total"))


@query(f"""WITH {DIFF_LINES}
SELECT path, CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'c' THEN 'c' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java'
  WHEN 'go' THEN 'go' END AS language, count(*) AS files FROM heads GROUP BY ALL""")
def language_of(spark, sf):
    paths = X.explode_once(T.commits(spark, sf), [], D.changed_paths("diff"), "path")
    return paths.groupBy("path", X.language_of("path").alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query(r"""SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'), ' ')) AS digest FROM documents""")
def tokenize(spark, sf):
    return T.texts(spark, sf).select("doc_id", F.md5(X.tokenize("text")).alias("digest"))


@query(f"""WITH {T.COMMITS_SQL}, m AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE commit_message END AS msg, diff FROM commits)
SELECT doc_id, md5(coalesce(msg, '') || ' ' || diff) AS filled, md5(coalesce(msg || ' ' || diff, '')) AS blanked FROM m""")
def combined_text(spark, sf):
    rows = T.commits(spark, sf).withColumn("msg", F.when(F.col("doc_id") % 6 != 1, F.col("commit_message")))
    return rows.select("doc_id", F.md5(X.combined_text("msg", "diff")).alias("filled"),
                       F.md5(X.combined_text("msg", "diff", "blank")).alias("blanked"))


@query(f"""WITH {T.COMMITS_SQL}
SELECT doc_id, md5(substr(diff, strpos(diff, 'diff --git'))) AS digest, length(diff) - length(substr(diff, strpos(diff, 'diff --git'))) AS cut
FROM commits""")
def extract_diff(spark, sf):
    rows = T.commits(spark, sf).select("doc_id", F.length("diff").alias("n"), D.extract_diff("diff").alias("d"))
    return rows.select("doc_id", F.md5("d").alias("digest"), (F.col("n") - F.length("d")).cast("bigint").alias("cut"))


@query("""SELECT o_orderkey, 'Author: ' || o_custkey || chr(10) || 'Date: ' || o_orderpriority || chr(10) || chr(10) || o_orderstatus AS header,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Commit ' || md5(o_orderkey::VARCHAR) || ' is the root commit. No diff available.' ELSE
    'diff --git a/f' || o_orderkey || ' b/f' || o_orderkey || chr(10) || 'index ' || substr(md5(o_custkey::VARCHAR), 1, 7) || '..'
    || substr(md5(o_orderkey::VARCHAR), 1, 7) || ' 100644' || chr(10) || '--- a/f' || o_orderkey || chr(10) || '+++ b/f' || o_orderkey
    || chr(10) || '@@' || CASE o_orderkey % 4 WHEN 0 THEN chr(10) || 'new file mode 100644' WHEN 1 THEN chr(10) || 'deleted file mode 100755'
      WHEN 2 THEN chr(10) || 'rename from old' || chr(10) || 'rename to f' || o_orderkey ELSE '' END END AS file_header
FROM orders""")
def commit_header(spark, sf):
    key = F.col("o_orderkey")
    change = F.when(key % 4 == 0, "new").when(key % 4 == 1, "deleted").when(key % 4 == 2, "renamed").otherwise("edited")
    parent = F.when(key % 5 != 0, F.md5(F.col("o_custkey").cast("string")))
    return T.table(spark, sf, "orders").select(
        "o_orderkey",
        X.commit_header(F.col("o_custkey").cast("string"), "o_orderpriority", "o_orderstatus").alias("header"),
        X.render_file_header(F.lit("old"), F.concat(F.lit("f"), key.cast("string")), parent, F.md5(key.cast("string")),
                             F.lit("100755"), F.lit("100644"), F.lit("@@"), change).alias("file_header"))


@query("""SELECT event_id, lower(event_type) IN ('true', '1', 'yes') OR event_id % 4 = 0 AS by_word, user_id = 1 AS by_number,
  value > 5 AS by_flag, false AS by_fraction FROM events""")
def asbool(spark, sf):
    events = T.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 4 == 0, "Yes").otherwise(F.col("event_type")).alias("word"),
        F.col("user_id").alias("number"), (F.col("value") > 5).alias("flag"), F.col("value").alias("fraction"))
    return events.select("event_id", X.asbool(events, "word").alias("by_word"), X.asbool(events, "number").alias("by_number"),
                         X.asbool(events, "flag").alias("by_flag"), X.asbool(events, "fraction").alias("by_fraction"))


@query("""SELECT conv_id, turn, contains(lower(CASE WHEN turn % 2 = 1 THEN text || ' so: TRUE' ELSE text END), 'true') AS says_true FROM conversations""")
def answer_contains_true(spark, sf):
    said = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" so: TRUE"))).otherwise(F.col("text"))
    return T.table(spark, sf, "conversations").select("conv_id", "turn", X.answer_contains_true(said).alias("says_true"))


@query("""SELECT conv_id, turn, length(text) * 0.3::DOUBLE AS tokens,
  CASE WHEN length(text) * 0.3::DOUBLE + length(role) * 0.3::DOUBLE < 200 THEN md5(text) ELSE md5('') END AS context FROM conversations""")
def fit_budget(spark, sf):
    return T.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.estimate_tokens("text").cast("double").alias("tokens"),
        F.md5(X.fit_budget(["role"], "text", 200)).alias("context"))


@query("""WITH t AS (SELECT conv_id, turn, text, sum(length(role) * 0.3::DOUBLE + length(text) * 0.3::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS sum_ FROM conversations)
SELECT conv_id, turn, round(sum_, 4) AS tokens_so_far, CASE WHEN sum_ < 250 THEN md5(text) ELSE md5('') END AS context FROM t""")
def running_budget(spark, sf):
    kept = X.running_budget(T.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 250)
    return kept.select("conv_id", "turn", F.round(F.col("tokens_so_far").cast("double"), 4).alias("tokens_so_far"), F.md5("kept_context").alias("context"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, sum(length(role) * 0.3::DOUBLE + length(text) * 0.3::DOUBLE) OVER (PARTITION BY k ORDER BY o NULLS FIRST) AS sum_
  FROM (SELECT *, CASE WHEN conv_id % 5 <> 0 THEN conv_id END AS k, CASE WHEN turn > 0 THEN conv_id * 1000 + turn END AS o FROM conversations) WHERE turn > 0)
SELECT conv_id, turn, round(sum_, 4) AS tokens_so_far, CASE WHEN sum_ < 250 THEN md5(text) ELSE md5('') END AS context FROM t
UNION ALL SELECT conv_id, NULL, count(*) * 0.6::DOUBLE, md5('') FROM conversations WHERE turn = 0 GROUP BY conv_id""")
def running_budget_odd(spark, sf):
    """A fifth of the conversations have no name; their turns are one group. Texts of first turns stand at a null place of a name of their own, with an equal row each."""
    turns = T.table(spark, sf, "conversations")
    named = turns.filter("turn > 0").withColumns({"k": F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")), "o": F.col("conv_id") * 1000 + F.col("turn")})
    rest = X.running_budget(named, "k", "o", "role", "text", 250).select(
        "conv_id", "turn", F.round(F.col("tokens_so_far").cast("double"), 4).alias("tokens_so_far"), F.md5("kept_context").alias("context"))
    twice = turns.filter("turn = 0").select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("x").alias("role"), F.lit(None).cast("string").alias("text"))
    same = X.running_budget(twice.union(twice), "conv_id", "turn", "role", "text", 250)
    most = same.groupBy("conv_id", "turn").agg(F.round(F.max("tokens_so_far").cast("double"), 4).alias("tokens_so_far"), F.md5(F.max("kept_context")).alias("context"))
    return rest.unionByName(most)


@query("""SELECT doc_id, md5(text || chr(65533) || 'x' || chr(65533)) AS replaced, md5(text || 'x') AS ignored FROM documents""")
def repair_utf8(spark, sf):
    """Texts with two bytes that are no UTF-8 behind them."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("ff78fe")))
    return T.texts(spark, sf).select("doc_id", raw.alias("raw")).select(
        "doc_id", F.md5(X.repair_utf8("raw")).alias("replaced"), F.md5(X.repair_utf8("raw", "ignore")).alias("ignored"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)),
  lambda l: length(trim(l, E' \n\t\r\f\v')) > 0), lambda l: '<s>' || l), '|')) AS digest FROM documents""")
def nonblank_lines(spark, sf):
    return T.texts(spark, sf).select("doc_id", F.md5(F.array_join(X.nonblank_lines("text", "<s>"), "|")).alias("digest"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(1, 129), lambda i: coalesce(w[i], '<pad>')), ' ')) AS tokens,
  least(len(w), 128)::BIGINT AS used FROM t""")
def pad_tokens(spark, sf):
    padded = T.texts(spark, sf).select("doc_id", X.pad_tokens(F.split("text", " "), 128, "<pad>").alias("p"))
    used = F.aggregate("p.mask", F.lit(0).cast("bigint"), lambda acc, m: acc + m)
    return padded.select("doc_id", F.md5(F.array_join("p.tokens", " ")).alias("tokens"), used.alias("used"))


@query("""WITH t AS (SELECT event_id, 'noise ' || CASE WHEN event_id % 11 = 0 THEN replace(props, '}', '')
    WHEN event_id % 13 = 0 THEN replace(props, ':', ' ') ELSE props END || ' tail' AS t FROM events),
f AS (SELECT event_id, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS j FROM t)
SELECT event_id, CASE WHEN json_valid(j) THEN json_extract(j, '$.k')::BIGINT END AS k,
  CASE WHEN j = '' THEN 'No JSON object found in string' WHEN NOT json_valid(j) THEN 'JSONDecodeError' END AS error FROM f""".replace("\\\\", "\\"))
def json_in_text(spark, sf):
    props = F.when(F.col("event_id") % 11 == 0, F.replace("props", F.lit("}"), F.lit(""))).when(
        F.col("event_id") % 13 == 0, F.replace("props", F.lit(":"), F.lit(" "))).otherwise(F.col("props"))
    read = X.json_in_text(F.concat(F.lit("noise "), props, F.lit(" tail")), "k bigint")
    return T.table(spark, sf, "events").select("event_id", read.alias("r")).select("event_id", "r.value.k", "r.error")


@query("""WITH v AS (SELECT event_id, event_id % 7 AS c, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"yes"' WHEN 3 THEN '1' ELSE 'null' END AS a,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS x, event_id % 17 = 0 AS quoted FROM events)
SELECT event_id, CASE WHEN a IN ('true', '1') THEN true WHEN a = 'false' THEN false END AS answer,
  CASE WHEN NOT quoted AND c BETWEEN 1 AND 5 THEN c END AS confidence, x AS explanation,
  CASE WHEN a NOT IN ('true', 'false', '1') THEN 'Answer must be either True or False'
    WHEN quoted OR c NOT BETWEEN 1 AND 5 THEN 'Confidence must be an integer between 1 and 5'
    WHEN x = '' THEN 'Explanation must be a non-empty string' END AS error FROM v""")
def validate_verdict(spark, sf):
    event = F.col("event_id")
    answer = F.element_at(F.array(*[F.lit(a) for a in ("true", "false", '"yes"', "1", "null")]), (event % 5 + 1).cast("int"))
    score = F.when(event % 17 == 0, F.concat(F.lit('"'), (event % 7).cast("string"), F.lit('"'))).otherwise((event % 7).cast("string"))
    words = F.when(event % 9 == 0, "").otherwise(F.col("event_type"))
    record = F.concat(F.lit('{"answer": '), answer, F.lit(', "confidence": '), score, F.lit(', "explanation": "'), words, F.lit('"}'))
    return T.table(spark, sf, "events").select("event_id", X.validate_verdict(record).alias("v")).select("event_id", "v.*")


@query("""SELECT event_id, lpad(printf('%x', user_id), 32, '0') AS trace, lpad(printf('%x', event_id), 16, '0') AS span FROM events""")
def hex_id(spark, sf):
    return T.table(spark, sf, "events").select("event_id", X.hex_id("user_id", 32).alias("trace"), X.hex_id("event_id", 16).alias("span"))


@query(f"""WITH {T.COMMITS_SQL}
SELECT doc_id, md5('Commit ' || commit_id || ' of ' || repo || ':' || chr(10) || commit_message || chr(10) || diff) AS digest FROM commits""")
def render_prompt(spark, sf):
    template = "Commit {{ commit }} of {{ repo }}:\n{{ message }}\n{{ diff }}"
    prompt = X.render_prompt(template, {"commit": "commit_id", "repo": "repo", "message": "commit_message", "diff": "diff"})
    return T.commits(spark, sf).select("doc_id", F.md5(prompt).alias("digest"))


@query(r"""SELECT p_partkey, printf('%.2f', p_size / 7.0::DOUBLE) AS metric,
  replace(replace(replace(replace(p_name || '_50%&$', '_', '\_'), '%', '\%'), '&', '\&'), '$', '\$') AS escaped FROM part""")
def format_metric(spark, sf):
    return T.table(spark, sf, "part").select(
        "p_partkey", X.format_metric(F.col("p_size") / 7.0).alias("metric"),
        X.escape_markup(F.concat("p_name", F.lit("_50%&$"))).alias("escaped"))


@query(f"""WITH {T.COMMITS_SQL}
SELECT doc_id, array_to_string(regexp_extract_all(commit_message, 'CVE-\\d{{4}}-\\d{{4,}}'), ',') AS ids FROM commits
WHERE regexp_matches(commit_message, 'CVE-\\d{{4}}-\\d{{4,}}')""")
def mentions_cve(spark, sf):
    from fixtrace.operators.preparation import mentions_cve as mentioning
    rows = mentioning(T.commits(spark, sf), "commit_message")
    return rows.select("doc_id", F.array_join(X.find_cve_ids("commit_message"), ",").alias("ids"))


@query("""SELECT doc_id, (('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 7)::BIGINT AS shard, (doc_id % 20)::BIGINT AS turn FROM documents""")
def hash_shard(spark, sf):
    return T.texts(spark, sf).select(
        "doc_id", H.hash_shard("doc_id", 7).alias("shard"), H.round_robin_shard("doc_id", 20).alias("turn"))
