"""The checked queries of the operators over whole corpora: manifest, phrases and URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtrace.llm.merkle import folded, leaf_digest, merkle_manifest
from fixtrace.llm.phrases import collocations
from fixtrace.llm.registry import query
from fixtrace.llm.url_filters import judge_urls, url_rules

#: The rules that URLs are judged by: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracle="""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS place
    FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE place = 1""")
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))


@query(oracle=f"""
WITH RECURSIVE k(c, i) AS (SELECT x, x FROM generate_series(0, 255) g(x)),
table_(i, c, step) AS (SELECT i, c, 0 FROM k UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM table_ WHERE step < 8),
byte_ AS (SELECT i, c FROM table_ WHERE step = 8),
crc(doc_id, c, done) AS (SELECT doc_id, 4294967295, 0 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL
    SELECT doc_id, xor(crc.c // 256, byte_.c), done + 1 FROM crc
    JOIN byte_ ON byte_.i = xor(crc.c % 256, ascii(substr(doc_id::VARCHAR, done + 1, 1))) WHERE done < length(doc_id::VARCHAR)),
even AS (SELECT doc_id FROM crc WHERE done = length(doc_id::VARCHAR) AND xor(c, 4294967295) % 2 = 0),
d AS (SELECT doc_id, source, sha256({_LEAF.format(text='text')}) AS leaf, sha256({_LEAF.format(text="replace(text, chr(10), '')")}) AS cut,
    doc_id IN (SELECT doc_id FROM even) AS odd FROM documents),
l AS (SELECT doc_id, source, leaf, CASE WHEN odd THEN cut ELSE leaf END AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT source, 0 AS lvl, pos, leaf AS digest FROM l UNION ALL
    SELECT source, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM
    (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY source, lvl, pos // 3),
top AS (SELECT source, lvl AS depth, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
    FROM (SELECT *, lvl = max(lvl) OVER (PARTITION BY source) AS last FROM t) WHERE last),
r AS (SELECT 0 AS lvl, pos, subroot AS digest FROM top UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM
    (SELECT *, count(*) OVER () AS n FROM r) WHERE n > 1 GROUP BY lvl, pos // 3),
root AS (SELECT digest AS root, lvl AS high FROM r WHERE lvl = (SELECT max(lvl) FROM r)),
below AS (SELECT l.source, l.pos AS leaf_pos, t.lvl, string_agg(CASE WHEN t.pos < l.pos // (3 ** t.lvl)::BIGINT THEN digest END, '' ORDER BY t.pos) AS a,
    string_agg(CASE WHEN t.pos > l.pos // (3 ** t.lvl)::BIGINT THEN digest END, '' ORDER BY t.pos) AS b
    FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source AND l.pos // (3 ** (t.lvl + 1))::BIGINT = t.pos // 3
    JOIN top ON top.source IS NOT DISTINCT FROM t.source AND t.lvl < depth GROUP BY ALL),
above AS (SELECT top.source, r.lvl, string_agg(CASE WHEN r.pos < top.pos // (3 ** r.lvl)::BIGINT THEN digest END, '' ORDER BY r.pos) AS a,
    string_agg(CASE WHEN r.pos > top.pos // (3 ** r.lvl)::BIGINT THEN digest END, '' ORDER BY r.pos) AS b
    FROM top JOIN r ON top.pos // (3 ** (r.lvl + 1))::BIGINT = r.pos // 3 JOIN root ON r.lvl < high GROUP BY ALL),
steps AS (SELECT source, leaf_pos, lvl, coalesce(a, '') AS a, coalesce(b, '') AS b FROM below UNION ALL
    SELECT l.source, l.pos, depth + lvl, coalesce(a, ''), coalesce(b, '') FROM l JOIN top ON l.source IS NOT DISTINCT FROM top.source
    JOIN above ON l.source IS NOT DISTINCT FROM above.source),
proof AS (SELECT source, leaf_pos, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof FROM steps GROUP BY ALL),
f AS (SELECT source, pos AS leaf_pos, 0 AS lvl, claimed AS cur FROM l UNION ALL
    SELECT f.source, f.leaf_pos, f.lvl + 1, sha256(a || cur || b) FROM f JOIN steps s
    ON f.source IS NOT DISTINCT FROM s.source AND f.leaf_pos = s.leaf_pos AND f.lvl = s.lvl),
e AS (SELECT source, leaf_pos, cur FROM (SELECT *, lvl = max(lvl) OVER (PARTITION BY source, leaf_pos) AS last FROM f) WHERE last)
SELECT l.doc_id, l.leaf, top.subroot, root.root, coalesce(proof, sha256('')) AS proof_sha256, e.cur AS folded_root, e.cur = root.root AS verified
FROM l JOIN top ON l.source IS NOT DISTINCT FROM top.source CROSS JOIN root
JOIN e ON e.source IS NOT DISTINCT FROM l.source AND e.leaf_pos = l.pos
LEFT JOIN proof ON proof.source IS NOT DISTINCT FROM l.source AND proof.leaf_pos = l.pos""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, by its id, is verified with its line ends removed."""
    docs = _table(spark, sf_dir, "documents")
    others: list = ["doc_id", "source", "lang", "n_chars"]
    # Without line ends a text is the same, and is not hashed twice.
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    digests = docs.select("doc_id", "source", leaf_digest([*others, "text"]).alias("leaf"),
                          F.when(changed, leaf_digest([*others, F.replace("text", F.lit("\n"), F.lit(""))])).alias("cut"))
    found = merkle_manifest(digests, "source", "doc_id", F.col("leaf"), F.coalesce("cut", "leaf"))
    found = found.withColumn("folded_root", folded("claimed", "steps"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


@query(oracle="""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i:i + size - 1])) AS ph
    FROM w, (VALUES (1), (2), (3), (4)) z(size) WHERE len(ws) >= size),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM f WHERE len(ph) > 1),
d AS (SELECT c.lang, c.ph, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:]),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
h AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len(ph)), lambda n: list_transform(range(1, len(ph) - n + 2),
    lambda i: ph[i:i + n - 1])))) AS ph FROM f WHERE len(ph) > 2),
m AS (SELECT lang, ph, max(f) AS most FROM h GROUP BY ALL),
o AS (SELECT e.*, array_to_string(e.ph, ' ') AS phrase FROM e LEFT JOIN m ON e.lang = m.lang AND e.ph = m.ph
    WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN s USING (lang) WHERE rank <= 2000""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(_table(spark, sf_dir, "documents").select("lang", "text"))
    return found.withColumn("rank", F.col("rank").cast("bigint"))
