"""Manifest, phrases and URL filters against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtrace.llm import phrases
from fixtrace.llm.merkle import folded, leaf_digest, merkle_manifest
from fixtrace.llm.phrases import CHUNK_WORDS, TRIGGER, Words, _chunks, _chunks_of_many, collocations, normalised
from fixtrace.llm.url_filters import digest_arrays, judge_urls, url_rules
from fixtrace.session import run_folder


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    """All levels of a tree, leaves first."""
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([h(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return found


def siblings(tree, at):
    """(left, right) of each level below the top."""
    steps = []
    for level in tree[:-1]:
        run = at // 3 * 3
        steps.append(("".join(level[run:at]), "".join(level[at + 1:run + 3])))
        at //= 3
    return steps


def brute_manifest(rows):
    """(id, source, leaf, subroot, root, steps) of rows (id, source, text)."""
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i, h(entry(i), entry(source), entry(text))))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for _, leaf in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    return sorted(((i, s, leaf, trees[s][-1][0], top[-1][0], siblings(trees[s], at) + siblings(top, k))
                   for k, s in enumerate(names) for at, (i, leaf) in enumerate(groups[s])), key=repr)


@pytest.mark.parametrize("sizes, slice_rows", [([1], 10), ([2, 1], 10), ([3, 4, 9, 10], 7), ([800, 243, 244, 1], 100), ([27] * 30, 50)])
def test_manifest_as_brute_force(spark, sizes, slice_rows):
    rows = [(k * 13 % 5000 - 100, f"s{g}", f"text {k}") for g, size in enumerate(sizes) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    found = merkle_manifest(docs, "source", "doc_id", leaf_digest(["doc_id", "source", "text"]), slice_rows=slice_rows)
    found = found.withColumn("again", folded("leaf", "steps")).collect()
    assert sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in found), key=repr) == brute_manifest(rows)
    assert all(r.again == r.root for r in found)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None), (None, "a", ""), (3, "a", "x\ny"), (3, "a", "x\ny"), (3, "a", "b"), (-1, "ü", "z" * 300_000), (2, "", "é:1")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(
        {c: F.lit(1) for c in ("grp", "place", "pos", "n", "digest", "one", "steps", "block")})
    changed = F.when(F.col("doc_id") == 3, leaf_digest(["doc_id", "source", F.replace("text", F.lit("\n"), F.lit(""))]))
    leaf = leaf_digest(["doc_id", "source", "text"])
    found = merkle_manifest(docs, "source", "doc_id", leaf, F.coalesce(changed, leaf)).withColumn("again", folded("claimed", "steps")).collect()
    assert sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in found), key=repr) == brute_manifest(rows)
    assert sorted((r.doc_id or 0, r.again == r.root) for r in found) == [(-1, True), (0, True), (0, True), (2, True), (3, False), (3, False), (3, True)]
    assert merkle_manifest(docs.limit(0), "source", "doc_id", leaf).count() == 0


# Phrases


def brute_phrases(rows, least, first):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            parts = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(parts)
            own = counts.setdefault(lang, Counter())
            for n in (1, 2, 3, 4):
                own.update(tuple(parts[i:i + n]) for i in range(len(parts) - n + 1))
    found = []
    for lang, own in counts.items():
        known = {p: f for p, f in own.items() if f >= least}
        scored = []
        for p, a in known.items():
            if len(p) < 2:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * f >= 80 * a for q, f in known.items()
                         if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(found)


def invented(seed, count):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Ab", "naïve", "x" * 50]
    shared = [" ".join(pick.choices(vocabulary, k=60)) for _ in range(3)]
    rows = []
    for _ in range(count):
        parts = [pick.choice(vocabulary) + pick.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " ! "]) for _ in range(pick.randint(0, 120))]
        rows.append((pick.choice(["en", "de", None]), "".join(parts) + (pick.choice(shared) if pick.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("least, first", [(1, 50), (5, 2000), (30, 2000)])
def test_phrases_as_brute_force(spark, least, first):
    rows = invented(least, 60 if least == 1 else 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = collocations(docs, least=least, first=first).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == brute_phrases(rows, least, first)


def test_phrases_of_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " .,;\n"), ("en", "one"), ("en", "hot dog " * 70_000), ("", "same same same same same"), ("", "same same same same same"),
            ("\u00e9", "A b\u000bA B\rA\u00a0b")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit(1) for c in ("chunk", "own", "times", "key", "f", "n", "size", "phrase", "rank", "k", "head")})
    found = collocations(docs, least=2).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == brute_phrases(rows, 2, 2000)
    assert collocations(docs.limit(0)).count() == 0


def test_phrases_broadcast_no_table(spark):
    """Their files are far below the threshold here, as they are at sizes where the repeated rows no longer fit into the driver."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    rows = invented(3, 200)
    found = collocations(spark.createDataFrame(rows, "lang string, text string"), least=4)
    planned = found._jdf.queryExecution().executedPlan().toString()
    counted = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())
    ended = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ended and counted and counted == brute_phrases(rows, 4, 2000)
    for plan in (planned, ended):
        assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan


def test_full_filter_changes_nothing(spark, monkeypatch):
    """Filters only leave out what cannot be frequent, so one that lets everything pass gives the same rows."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 10)
    rows = invented(7, 200)
    found = collocations(spark.createDataFrame(rows, "lang string, text string"), least=4).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == brute_phrases(rows, 4, 2000)


def test_chunks_share_words_and_follow_the_content():
    pick = random.Random(3)
    words = [f"w{pick.randint(0, 999)}" for _ in range(3000)]
    text = " ".join(words).encode()
    chunks, own = _chunks(text)
    assert sum(own) == 3000 and 3000 / len(chunks) < 2 * TRIGGER
    at = 0
    for chunk, count in zip(chunks, own):
        assert chunk.decode().split() == words[at:at + count + 3]
        at += count
    again, _ = _chunks(b"some other words before " + text)
    assert len(set(again) - set(chunks)) <= 2
    long, own = _chunks(b"same " * 20_000)
    assert sum(own) == 20_000 and max(own) <= CHUNK_WORDS
    assert len(set(long)) <= 3


@pytest.mark.parametrize("size", [8, 64])
def test_long_texts_are_cut_where_nothing_changes(size, monkeypatch):
    texts = [t.encode() for _, t in invented(11, 40)] + [b" . ", b"a" * 300 + b" b,", b",,a  b\t\n c"]
    wanted = [(normalised(t), _chunks(t)) for t in texts]
    monkeypatch.setattr(phrases, "PIECE_BYTES", size)
    assert [(phrases._normalised_parts(t), _chunks(t)) for t in texts] == wanted


def test_texts_parsed_together_as_one_by_one():
    texts = [t.encode() for _, t in invented(12, 50)] + [b"", b" . ", b"one", b"same " * 9000, b"", b".a,", b"B"]
    wanted = [(k, c, own) for k, t in enumerate(texts) for c, own in zip(*_chunks(t))]
    assert list(zip(*_chunks_of_many(texts))) == wanted
    assert _chunks_of_many([b"", b""]) == ([], [], [])


def test_numbers_of_sequences_never_overflow(monkeypatch):
    """With many distinct words the numbers of sequences are packed anew between two words."""
    raws = [b"a b c d", b"a b c d a b c d", b"a b\nc d"]
    wanted = None
    for distinct in (None, 1 << 40):
        grams = phrases.Grams(["x", "x", "y"], raws, np.array([4, 8, 4]), np.array([1, 2, 5]))
        grams.number_words()
        grams.distinct = distinct or grams.distinct
        found = []
        for size in (1, 2, 3, 4):
            first, times = phrases._merged(grams, grams.places(size), size)
            found.append(sorted((grams.words.raw[grams.words.starts[f]:grams.words.ends[f + size - 1]].tobytes(), int(grams.lang[f]), int(t))
                                for f, t in zip(first, times)))
        wanted = wanted or found
        assert found == wanted and found[3] == [(b"a b c d", 0, 5), (b"b c d a", 0, 2), (b"c d a b", 0, 2), (b"d a b c", 0, 2)]


def test_words_of_a_normalised_text():
    words = Words(b"a bc\nd")
    assert words.starts.tolist() == [0, 2, 5] and words.ends.tolist() == [1, 4, 6] and words.breaks.tolist() == [True, False, True]


# URL filters


def brute_urls(urls, rules):
    found = []
    for url in urls:
        rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(a + p), len(a), a + p, v) for (a, p), v in rules.items() if (host == a or host.endswith("." + a)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        found.append((url, host, path, best[2], best[3]))
    return sorted(found, key=repr)


def judged(spark, urls, rules, **options):
    table = spark.createDataFrame([(a, p, v) for (a, p), v in rules.items()], "host string, path string, verdict string")
    rows = spark.createDataFrame([(u, 1, 2) for u in urls], "url string, rule int, key int")
    found = judge_urls(rows, url_rules(table, **options))
    assert found.columns == ["url", "key", "host", "path", "rule", "verdict"]
    return sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=repr)


def test_urls_as_brute_force(spark):
    pick = random.Random(5)
    names = ["net", "example.net", "a.example.net", "org", "b-c.org", "É.org", "x"]
    rules = {(pick.choice(names), "/" + "/".join(pick.choices(["en", "de", "é", "p"], k=pick.randint(0, 3)))): pick.choice(["allow", "block"])
             for _ in range(40)} | {("com", ""): "block"}
    urls = [f"{pick.choice(['http', 'https', 'HTTP'])}://{pick.choice(['', 'www.', 'A.', 'notexample.'])}{pick.choice(names + ['com', 'deep.COM', 'netx'])}"
            f"{pick.choice(['', '/', '/en', '/en/de/', '/é/p/x', '/de?x=/en', '#/en', '?/en', '/p://x/'])}" for _ in range(400)]
    assert judged(spark, urls, rules, file_rules=4) == brute_urls(urls, rules)


def test_urls_of_odd_rows(spark):
    rules = {("net", "/"): "block", ("a.net", "/x"): "allow", ("net", "/abc"): "block", ("", ""): "block"}
    urls = [None, "", "no scheme", "://", "://net", "://NET/", "http://net?/", "http://u@net:80/", "http://a.net/x", "http://a.net/xbc", "http://.net/", "http://net./",
            "http://x\n.net/y\nz?", "http://" + "a." * 50_000 + "net/" + "p" * 100_000, "http://a.net/x", "http://a.net/x"]
    assert judged(spark, urls, rules) == brute_urls(urls, rules)
    assert judged(spark, [], rules) == []
    assert judged(spark, urls, {}) == brute_urls(urls, {})


def test_rules_that_repeat_or_fit_nothing(spark):
    table = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("x", "y", "block"), ("com", "/", "odd")],
                                  "host string, path string, verdict string")
    urls = spark.createDataFrame([(u,) for u in ("http://net/", "http://org", "http://x/y", "http://com/")], "url string")
    found = {r.url: (r.rule, r.verdict) for r in judge_urls(urls, url_rules(table), default="none").collect()}
    assert found == {"http://net/": ("net/", "block"), "http://org": ("org", "block"), "http://x/y": (None, "none"), "http://com/": (None, "none")}


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    import xxhash

    entries = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "entry string, value long")
    arrays = digest_arrays(entries, run_folder(spark, "t"), "few")
    assert arrays.find([b"a", b"b", b"c", b"d", b""]).tolist() == [1, 2, 3, -1, -1]
    arrays.parts[0] = (np.full(3, 7, dtype=np.uint64), *arrays.parts[0][1:])
    arrays.first[:] = 7
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: 7)
    assert arrays.find([b"a", b"b", b"c", b"d"]).tolist() == [1, 2, 3, -1]


def test_crc_of_the_id_is_as_in_sql(spark):
    found = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in found)
