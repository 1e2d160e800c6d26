"""Samples, splits, deduplication and joins against plain Python, with hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from fixtrace.operators import joins as J
from fixtrace.operators import ordering as O
from fixtrace.operators import preparation as P
from fixtrace.operators import spans as L
from fixtrace.operators import splitting as S


def hot_rows(n=600, seed=1):
    """A third of all rows share one key; scores have many ties."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", f"id{i:04d}", float(rng.randrange(12))) for i in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(hot_rows(), "cve string, commit_id string, score double")


def order():
    return [F.col("score").desc(), F.col("commit_id")]


def expected_ranks(rows):
    groups = {}
    for cve, commit, score in rows:
        groups.setdefault(cve, []).append((-score, commit))
    return {(cve, commit): i + 1 for cve, members in groups.items() for i, (_, commit) in enumerate(sorted(members))}


@pytest.mark.parametrize("hot", [0, 50, O.HOT_ROWS])
def test_rank_within_hot_group(scored, hot):
    ranked = O.rank_within(scored, ["cve"], order(), hot_rows=hot)
    assert {(r["cve"], r["commit_id"]): r["rank"] for r in ranked.collect()} == expected_ranks(hot_rows())


def test_number_rows(spark):
    numbered = O.number_rows(spark.range(100).withColumn("x", F.col("id") % 7), [F.col("x"), F.col("id")])
    found = [r["id"] for r in numbered.orderBy("row_id").collect()]
    assert found == sorted(range(100), key=lambda i: (i % 7, i))


@pytest.mark.parametrize("k", [3, 10, 1001])
def test_top_k(scored, k):
    wanted = {key: rank for key, rank in expected_ranks(hot_rows()).items() if rank <= k}
    assert {(r["cve"], r["commit_id"]): r["rank"] for r in O.top_k(scored, ["cve"], order(), k).collect()} == wanted


@pytest.mark.parametrize("agg, fold", [("min", min), ("max", max), ("sum", lambda *v: sum(v))])
def test_running_values(scored, agg, fold):
    found = O.running_values(scored, ["cve"], [F.col("commit_id")], {"v": (agg, F.col("score"))}, hot_rows=0)
    plain = O.running_values(scored, ["cve"], [F.col("commit_id")], {"v": (agg, F.col("score"))})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_join_small_keeps_all_rows(spark, scored):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "cve string, v int")
    assert O.join_small(scored, small, ["cve"], "left").count() == 600
    assert O.join_small(scored, small, ["cve"]).filter("cve = 'hot'").count() == 200


def greedy(weights, p_train, p_test):
    total, filled, sides = sum(weights.values()), {"train": 0, "test": 0}, {}
    for key, weight in sorted(weights.items(), key=lambda kv: (-kv[1], kv[0])):
        side = ("train" if filled["train"] + weight <= total * p_train else
                "test" if filled["test"] + weight <= total * p_test else
                "train" if filled["train"] < filled["test"] else "test")
        sides[key] = side
        filled[side] += weight
    return sides


@pytest.mark.parametrize("seed", range(12))
def test_weighted_group_split(spark, seed):
    rng = random.Random(seed)
    shapes = [
        lambda: 5, lambda: rng.randrange(1, 4), lambda: rng.randrange(1, 200),
        lambda: 1000 if rng.random() < 0.05 else rng.randrange(1, 3)]
    weights = {f"r{i:03d}": shapes[seed % 4]() for i in range(rng.randrange(1, 60))}
    shares = [(0.8, 0.2), (0.5, 0.5), (0.3, 0.7)][seed % 3]
    table = spark.createDataFrame(list(weights.items()), "repo string, weight bigint")
    found = {r["repo"]: r["side"] for r in S.weighted_group_split(table, "repo", *shares).collect()}
    assert found == greedy(weights, *shares)


def test_weighted_group_split_edges(spark):
    empty = spark.createDataFrame([], "repo string, weight bigint")
    assert S.weighted_group_split(empty, "repo").count() == 0
    with pytest.raises(ValueError):
        S.weighted_group_split(empty, "repo", 0.8, 0.1)
    giant = spark.createDataFrame([("big", 90), ("a", 5), ("b", 5)], "repo string, weight bigint")
    found = {r["repo"]: r["side"] for r in S.weighted_group_split(giant, "repo").collect()}
    assert found == greedy({"big": 90, "a": 5, "b": 5}, 0.8, 0.2)


def test_random_group_split_is_disjoint_and_complete(spark):
    split = S.random_group_split(spark.range(1000).withColumnRenamed("id", "cve"), "cve")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 800, "validate": 100, "test": 100} and split.select("cve").distinct().count() == 1000


def test_reservoir_sample(spark):
    rows = spark.range(500)
    assert S.reservoir_sample(rows, 77, "id").distinct().count() == 77
    assert S.reservoir_sample(rows, 500, "id").count() == 500
    for bad in (0, -1, 501):
        with pytest.raises(ValueError):
            S.reservoir_sample(rows, bad, "id")


def test_sample_negatives(spark):
    commits = spark.createDataFrame([("big" if i % 3 else "small", f"c{i}") for i in range(90)], "repo string, commit_id string")
    patches = spark.createDataFrame([("c1",), ("c3",)], "commit_id string")
    found = S.sample_negatives(commits, patches, 40).collect()
    assert not {"c1", "c3"} & {r["commit_id"] for r in found}
    assert {repo: sum(r["repo"] == repo for r in found) for repo in ("big", "small")} == {"big": 40, "small": 29}


def test_dedupe_and_resume(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "commit_id string, n int")
    kept = P.dedupe_keep_first(rows, ["commit_id"], [F.col("n")])
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 3)]
    pairs = spark.createDataFrame([("x", "1"), ("y", "1")], "cve string, commit_id string")
    done = pairs.limit(1).filter("cve = 'x'")
    assert P.resume(pairs, done).count() == 1
    assert P.resume(pairs, done, ("commit_id",)).count() == 0
    assert P.resume(pairs, None).count() == 2
    left = P.resume(pairs, done)
    assert P.resume(left, done).count() == left.count()


def test_assemble_pairs(spark):
    mapping = spark.createDataFrame([("A", "1", 1), ("A", "2", 0), ("B", "1", 0), ("B", "9", 0), ("C", "1", 0)],
                                    "cve string, commit_id string, label int")
    advisory = spark.createDataFrame([("A", "da"), ("B", "db")], "cve string, desc string")
    patches = spark.createDataFrame([("1", "fix")], "commit_id string, text string")
    others = spark.createDataFrame([("1", "shadowed"), ("2", "two")], "commit_id string, text string")
    loose = J.assemble_pairs(mapping, advisory, patches, others)
    assert sorted((r["cve"], r["commit_id"], r["text"]) for r in loose.collect()) == [("A", "1", "fix"), ("A", "2", "two"), ("B", "1", "fix")]
    strict = J.assemble_pairs(mapping, advisory, patches, others, strict_group=True)
    assert sorted((r["cve"], r["commit_id"]) for r in strict.collect()) == [("A", "1"), ("A", "2")]


def test_spans_over_many_blocks(spark):
    lines = spark.createDataFrame([("r", "p", i, f"line {i}") for i in range(1, 301)], "repo string, path string, line_no int, line string")
    spans = spark.createDataFrame([("r", "p", 10, 250, "outer"), ("r", "p", 60, 70, "inner")],
                                  "repo string, path string, start int, end int, name string")
    found = {r["line_no"]: r["name"] for r in L.lines_in_functions(lines, spans).collect()}
    assert found == {i: "outer" if 10 <= i <= 250 else "NULL" for i in range(1, 301)}
    calls = spark.createDataFrame([("r", "p", 11), ("r", "p", 127), ("r", "p", 249), ("r", "p", 5)], "repo string, path string, line_no int")
    context = {r["line_no"]: r["context"] for r in L.call_context(calls, lines, spans).collect()}
    text = lambda a, b: "\n".join(f"line {i}" for i in range(a, b + 1))
    assert context == {11: text(10, 20), 127: text(124, 136), 249: text(246, 250), 5: None}
