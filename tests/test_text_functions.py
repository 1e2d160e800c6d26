"""Golden rows for the text functions."""

import json

import pytest
from pyspark.sql import functions as F

from fixtrace.functions import hashing as H
from fixtrace.functions import text as X
from fixtrace.functions import vectors as V


def test_links(one):
    url = "https://github.com/own/committer/commit/abc"
    assert one(X.github_repo, "see http://github.com/a/b/issues") == {"owner": "a", "name": "b"}
    assert one(X.github_repo, "https://gitlab.com/a/b") is None
    assert one(X.commit_link, url) == {
        "api_url": "https://api.github.com/repos/own/commitster/commits/abc",
        "owner": "own", "repo": "commitster", "commit_id": "abc"}
    assert one(X.clone_url, "https://github.com/own/name/commit/abc") == "https://github.com/own/name.git"
    assert one(X.clone_url, "git@github.com:a/b/commit/1") == "https://github.com/a/b.git"
    assert one(X.clone_url, "https://github.com/a/b") is None
    assert one(X.parent_raw_url, "https://github.com/a/b/raw/abc/f.c", "def") == "https://github.com/a/b/raw/def/f.c"


def test_ids(one):
    digest = "0123456789abcdefABCDEF0123456789abcdef01"
    assert one(X.commit_hash, f"x/{digest}?q") == digest
    assert one(X.commit_hash, f"{digest}0") is None
    assert one(X.find_cve_ids, "CVE-2020-1234 CVE-20-1 cve-2020-1234 CVE-2021-123456") == ["CVE-2020-1234", "CVE-2021-123456"]
    assert one(X.issue_ref, "fix #12 and #3", "o", "r")["issue_url"] == "https://api.github.com/repos/o/r/issues/12"
    assert one(X.issue_ref, "none", "o", "r") is None


@pytest.mark.parametrize("path, language", [
    ("a/b.C", "c"), ("x.h", "c"), ("x.hpp", "cpp"), ("s/x.PY", "python"), ("x.php", "php"), ("x.rs", None),
    ("Makefile", None), (".go", None), ("a.go/b", None)])
def test_language_of(one, path, language):
    assert one(X.language_of, path) == language


def test_asbool(spark):
    words = spark.createDataFrame([("true",), ("True",), ("1",), ("yes",), ("false",), ("0",), ("no",), (None,)], "v string")
    assert [r[0] for r in words.select(X.asbool(words, "v")).collect()] == [True, True, True, True, False, False, False, False]
    numbers = spark.createDataFrame([(1,), (0,), (2,), (None,)], "v int")
    assert [r[0] for r in numbers.select(X.asbool(numbers, "v")).collect()] == [True, False, False, False]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in flags.select(X.asbool(flags, "v")).collect()] == [True, False, False]
    fractions = spark.createDataFrame([(1.0,)], "v double")
    assert fractions.select(X.asbool(fractions, "v")).first()[0] is False


def test_json_in_text(one):
    schema = "answer int, analysis string"
    assert one(X.json_in_text, 'x {"answer": 1,\n "analysis": "a"} y', schema=schema)["value"] == {"answer": 1, "analysis": "a"}
    assert one(X.json_in_text, "no braces", schema=schema) == {"value": None, "error": "No JSON object found in string"}
    # From the first to the last brace: two objects are no JSON.
    assert one(X.json_in_text, '{"answer": 1} and {"answer": 2}', schema=schema)["error"] == "JSONDecodeError"


@pytest.mark.parametrize("record, answer, confidence, error", [
    ({"answer": True, "confidence": 5, "explanation": "x"}, True, 5, None),
    ({"answer": False, "confidence": 0, "explanation": "x"}, False, None, "Confidence must be an integer between 1 and 5"),
    ({"answer": False, "confidence": 6, "explanation": "x"}, False, None, "Confidence must be an integer between 1 and 5"),
    ({"answer": True, "confidence": "3", "explanation": "x"}, True, None, "Confidence must be an integer between 1 and 5"),
    ({"answer": True, "confidence": None, "explanation": "x"}, True, None, "Confidence must be an integer between 1 and 5"),
    ({"answer": True, "confidence": True, "explanation": "x"}, True, 1, None),
    ({"answer": True, "confidence": False, "explanation": "x"}, True, None, "Confidence must be an integer between 1 and 5"),
    ({"answer": True, "confidence": 3, "explanation": ""}, True, 3, "Explanation must be a non-empty string"),
    ({"answer": True, "confidence": 3, "explanation": 7}, True, 3, "Explanation must be a non-empty string"),
    ({"answer": "yes", "confidence": 9}, None, None, "Answer must be either True or False"),
    ({"confidence": 3, "explanation": "x"}, None, 3, "Answer must be either True or False")])
def test_validate_verdict(one, record, answer, confidence, error):
    found = one(X.validate_verdict, json.dumps(record))
    assert (found["answer"], found["confidence"], found["error"]) == (answer, confidence, error)


def test_validate_verdict_bad_json(one):
    assert one(X.validate_verdict, "{oops")["error"] == "JSONDecodeError"


def test_prompt(one):
    assert one(lambda a, b: X.render_prompt("{{ a }} of {{b}}: {{ a }}", {"a": a, "b": b}), "x", "y") == "x of y: x"
    with pytest.raises(ValueError):
        X.render_prompt("{{ a }}", {})
    with pytest.raises(ValueError):
        X.render_prompt("none", {"a": "a"})


def test_texts(one):
    assert one(X.tokenize, "a_b, été(1)") == "a_b , été ( 1 )"
    assert one(X.combined_text, None, "d") == " d"
    assert one(X.combined_text, None, "d", nulls="blank") == ""
    assert one(X.head_lines, "a\nb\nc", n=2) == "a\nb"
    assert one(X.nonblank_lines, "a\n \n\tb", sep="|") == ["|a", "|\tb"]
    assert one(X.escape_markup, "a_b %&$") == "a\\_b \\%\\&\\$"


def test_format_metric(spark):
    import random
    rng = random.Random(7)
    values = [0.0, 1.0, 0.125, 0.375, 0.625, 0.155, 1.005, 2.675, 0.145, 0.285, 0.995, -0.125, -1.5, 12345.675, 99.995]
    values += [i / 8 for i in range(40)] + [i / 1000 for i in range(1000)] + [rng.random() * 100 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.format_metric("v").alias("t")).collect()
    assert [(r["v"], r["t"]) for r in rows if r["t"] != f"{r['v']:.2f}"] == []
    assert spark.range(1).select(X.format_metric(F.lit(None).cast("double"))).first()[0] is None


def test_fit_budget(spark):
    row = spark.range(1).select(F.lit("x" * 10).alias("c"), F.lit("y" * 10).alias("p"))
    assert row.select(X.fit_budget(["p"], "c", 7)).first()[0] == "x" * 10
    assert row.select(X.fit_budget(["p"], "c", 6)).first()[0] == ""


def test_pad_tokens(one):
    assert one(lambda c: X.pad_tokens(F.split(c, " "), 3, "-"), "a b") == {"tokens": ["a", "b", "-"], "mask": [1, 1, 0]}
    assert one(lambda c: X.pad_tokens(F.split(c, " "), 2, "-"), "a b c") == {"tokens": ["a", "b"], "mask": [1, 1]}


def test_repair_utf8(spark):
    row = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    assert row.select(X.repair_utf8("b"), X.repair_utf8("b", "ignore")).first() == ("a�b", "ab")


def test_hex_id(spark):
    assert spark.range(255, 256).select(X.hex_id("id", 32), X.hex_id("id", 16)).first() == ("0" * 30 + "ff", "0" * 14 + "ff")


def test_file_header(one):
    args = ["old", "new", None, "c" * 40, "1", "2", "@@", "new"]
    assert one(X.render_file_header, *args) == f"Commit {'c' * 40} is the root commit. No diff available."
    args[2] = "p" * 40
    assert one(X.render_file_header, *args) == (
        "diff --git a/new b/new\nindex ppppppp..ccccccc 2\n--- a/new\n+++ b/new\n@@\nnew file mode 2")


def test_hash_shard(one):
    import hashlib
    for key in ("CVE-2020-1", "", "x" * 100):
        for n in (1, 7, 12, 2 ** 31 - 1):
            assert one(H.hash_shard, key, n=n) == int(hashlib.md5(key.encode()).hexdigest(), 16) % n
    with pytest.raises(ValueError):
        H.md5_mod("x", 2 ** 31)


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    found = row.select(V.cosine("a", "b"), V.cosine("a", "z")).first()
    assert found[0] == pytest.approx(2 ** -0.5) and found[1] == 0.0


def test_running_budget_keeps_every_row_once(spark):
    """Null commits, null and equal places, equal rows."""
    rows = [("c", 1, "p" * 10, "x" * 10), ("c", 1, "p" * 10, "x" * 10), (None, 1, "p" * 10, "y"), (None, None, None, None), ("d", None, "p", "z"), ("c", 2, "p", "late")]
    files = spark.createDataFrame(rows, "commit string, place int, patch string, context string")
    found = X.running_budget(files, "commit", "place", "patch", "context", 12).collect()
    assert found[0].asDict().keys() == {"commit", "place", "patch", "context", "tokens_so_far", "kept_context"}
    assert sorted((str(r["commit"]), str(r["place"]), round(r["tokens_so_far"], 3), r["kept_context"]) for r in found) == [
        ("None", "1", 3.3, "y"), ("None", "None", 0.0, ""), ("c", "1", 6.0, "x" * 10), ("c", "1", 12.0, ""), ("c", "2", 13.5, ""), ("d", "None", 0.6, "z")]
