"""Similarity, neighbours and metrics against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtrace.operators import classification as C
from fixtrace.operators import neighbours as N
from fixtrace.operators import ranking as K
from fixtrace.operators import similarity as S
from fixtrace.operators import summaries as R
from fixtrace.operators import training as M


def tfidf(desc, texts):
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    counts = [Counter(words(t)) for t in texts]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    asked = {w: n * idf[w] for w, n in Counter(words(desc)).items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    scores = []
    for c in counts:
        vector = {w: n * idf[w] for w, n in c.items()}
        below = norm(vector) * norm(asked)
        scores.append(sum(asked.get(w, 0) * x for w, x in vector.items()) / below if below else 0.0)
    return scores


@pytest.mark.parametrize("share", [S.GROUP_SHARE, 7])
def test_tfidf_similarity(spark, monkeypatch, share):
    monkeypatch.setattr(S, "GROUP_SHARE", share)
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "été", "x_1", "all", "y", "fix", "bug"]
    groups = {"one": 1, "hot": 40, "few": 3, "none": 2}
    descs = {"one": "alpha all", "hot": "Gamma été fix fix y", "few": "beta", "none": "unseen words"}
    mapping, commits, wanted = [], [], {}
    for cve, n in groups.items():
        texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)) + ["all"]) for _ in range(n)]
        if cve == "few":
            texts[0] = None
        for i, text in enumerate(texts):
            mapping.append((cve, f"{cve}{i}", i % 2))
            commits.append((f"{cve}{i}", text))
        wanted |= {(cve, f"{cve}{i}"): s for i, s in enumerate(tfidf(descs[cve], texts))}
    found = S.tfidf_similarity(
        spark.createDataFrame(mapping, "cve string, commit_id string, label int"),
        spark.createDataFrame(list(descs.items()), "cve string, desc string"),
        spark.createDataFrame(commits, "commit_id string, text string"))
    rows = {(r["cve"], r["commit_id"]): r["similarity"] for r in found.collect()}
    assert rows.keys() == wanted.keys()
    for key, score in wanted.items():
        assert rows[key] == pytest.approx(score, abs=1e-9), key
        assert 0 <= rows[key] <= 1 + 1e-9


def shuffled(df):
    """Bytes that the shuffles of a plan wrote."""
    def walk(plan):
        kind = plan.getClass().getSimpleName()
        own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_tfidf_moves_postings_once(spark, monkeypatch, tmp_path):
    """What moves is little more than the texts and one short row for each word of a pair."""
    moved = []

    def watched(df, folder, name):
        moved.append(shuffled(df))
        return staged(df, folder, name)

    staged = S.staged
    monkeypatch.setattr(S, "staged", watched)
    rows = spark.range(2000).select(
        (F.col("id") % 4).cast("string").alias("cve"), F.sha1(F.col("id").cast("string")).alias("commit_id"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("word"), F.pmod(F.col("id") * 7 + i * i, F.lit(997)))), " ").alias("text"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    advisory = spark.createDataFrame([(str(i), "word1 word2 word30") for i in range(4)], "cve string, desc string")
    found = S.tfidf_similarity(rows.select("cve", "commit_id"), advisory, rows.select("commit_id", "text"))
    assert sum(moved) + shuffled(found) < 2000 * 70 * 24


def test_tfidf_repeated_rows(spark, monkeypatch):
    """A pair, a commit or an advisory that comes twice weighs the same with few and with many candidates."""
    mapping = spark.createDataFrame([("A", "1"), ("A", "1"), ("A", "2"), ("A", "3"), ("A", None), (None, "1")], "cve string, commit_id string")
    advisory = spark.createDataFrame([("A", "red red"), ("A", "blue"), ("B", "red"), (None, "red")], "cve string, desc string")
    commits = spark.createDataFrame([("1", "red blue"), ("2", "blue green"), ("2", "red"), ("3", "green"), (None, "red")], "commit_id string, text string")
    found = []
    for share in (S.GROUP_SHARE, 2):
        monkeypatch.setattr(S, "GROUP_SHARE", share)
        found.append(sorted((str(r["cve"]), str(r["commit_id"]), round(r["similarity"], 9)) for r in S.tfidf_similarity(mapping, advisory, commits).collect()))
    assert found[0] == found[1] and len(found[0]) == 6


def test_tfidf_same_commit_for_two_advisories(spark):
    mapping = spark.createDataFrame([("A", "1", 1), ("A", "2", 0), ("B", "1", 0)], "cve string, commit_id string, label int")
    advisory = spark.createDataFrame([("A", "red"), ("B", "red")], "cve string, desc string")
    commits = spark.createDataFrame([("1", "red blue"), ("2", "blue")], "commit_id string, text string")
    rows = {(r["cve"], r["commit_id"]): r["similarity"] for r in S.tfidf_similarity(mapping, advisory, commits).collect()}
    a, b = tfidf("red", ["red blue", "blue"]), tfidf("red", ["red blue"])
    assert rows == {("A", "1"): pytest.approx(a[0]), ("A", "2"): 0.0, ("B", "1"): pytest.approx(b[0])}


def test_greedy_match(spark):
    rows = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0]]), (2, [], [[1.0, 0.0]]), (3, None, [[1.0, 0.0]])],
                                 "id int, c array<array<double>>, r array<array<double>>")
    found = {r["id"]: r for r in S.greedy_match(rows, "c", "r").collect()}
    half = 2 ** -0.5
    assert [found[1][k] for k in ("precision", "recall", "f1")] == pytest.approx([half, half, half])
    assert found[2]["f1"] == found[3]["f1"] == 0.0


@pytest.mark.parametrize("block", [1, 7, 256])
def test_greedy_match_in_blocks(spark, monkeypatch, block):
    """As ``greedy_match`` on whole texts, whatever the block; empty texts, null keys, unusable vectors, repeated pairs."""
    monkeypatch.setattr(S, "BLOCK_TOKENS", block)
    rng = np.random.default_rng(block)
    texts = {f"t{i}": rng.normal(size=(n, 5)).tolist() for i, n in enumerate([1, 3, 20, 33])} | {"zero": [[0.0] * 5], "none": []}
    tokens = spark.createDataFrame([(k, i, v) for k, vs in texts.items() for i, v in enumerate(vs)], "t string, i int, v array<double>")
    sides = [tokens.withColumnsRenamed({"t": c, "i": "position", "v": "vector"}) for c in ("candidate", "reference")]
    named = [(a, b, 1) for a in texts for b in texts] + [("t1", "t2", 2), (None, "t1", 3)]
    pairs = spark.createDataFrame(named, "candidate string, reference string, c_block int")
    found = S.greedy_match_tokens(pairs, *sides).collect()
    whole = spark.createDataFrame([(a, b, n, texts.get(a), texts[b]) for a, b, n in named],
                                  "candidate string, reference string, c_block int, x array<array<double>>, y array<array<double>>")
    wanted = S.greedy_match(whole, "x", "y").collect()
    order = lambda r: (r["candidate"] or "", r["reference"], r["c_block"])
    assert len(found) == len(named)
    for one, other in zip(sorted(found, key=order), sorted(wanted, key=order)):
        assert order(one) == order(other)
        assert [one[k] for k in ("precision", "recall", "f1")] == pytest.approx([other[k] for k in ("precision", "recall", "f1")])


def test_greedy_match_of_unusable_tokens(spark, monkeypatch):
    schema = "position int, vector array<double>"
    ones = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, None), ("a", 2, [float("nan"), 1.0]), ("a", 3, [None, 1.0])], f"candidate string, {schema}")
    others = spark.createDataFrame([("b", 0, [2.0, 0.0])], f"reference string, {schema}")
    row = S.greedy_match_tokens(spark.createDataFrame([("a", "b")], "candidate string, reference string"), ones, others).first()
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((0.25, 1.0, 0.4))
    monkeypatch.setattr(S, "BLOCK_TOKENS", 2)
    with pytest.raises(Exception, match="positions repeat"):
        S.token_blocks(ones.withColumn("position", F.lit(0)), "candidate", "position", "vector").collect()


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_history_with_copies(spark, monkeypatch, k):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    store = rng.normal(size=(150, 6)).round(2)
    store[::3] = store[0]  # a third of the store are copies
    keys = rng.integers(0, 4, 150)
    queries = np.vstack([store[:20], rng.normal(size=(30, 6))]).round(2)
    query_keys = rng.integers(0, 4, 50)
    frame = lambda vs, ks: spark.createDataFrame(
        [(i, int(key), [float(x) for x in v]) for i, (v, key) in enumerate(zip(vs, ks))], "id bigint, key int, vector array<double>")
    found = {}
    for r in N.nearest_history(frame(queries, query_keys), frame(store, keys), k).collect():
        found.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    for i, (q, key) in enumerate(zip(queries, query_keys)):
        ranked = sorted((round(float(((q - s) ** 2).sum()), 9), j) for j, s in enumerate(store) if keys[j] != key)
        assert [n for _, n in sorted(found[i])] == [j for _, j in ranked[:k]], i


def test_nearest_history_edges(spark):
    schema = "id string, key string, vector array<float>"
    store = spark.createDataFrame([("s", "A", [0.0])], schema)
    same = spark.createDataFrame([("q", "A", [0.0])], schema)
    other = spark.createDataFrame([("q", "B", [2.0])], schema)
    assert N.nearest_history(same, store).count() == 0
    assert N.nearest_history(other, store).first()["distance"] == 4.0
    with pytest.raises(ValueError):
        N.nearest_history(other, store.filter("id = 'x'"))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_history_keeps_chunks_small(spark, monkeypatch, k):
    """What a task holds of either side is bounded, also where one cell holds most of the vectors, and the results are exact."""
    for name, rows in (("BLOCK_ROWS", 8), ("CHUNK_ROWS", 32), ("MAX_PIVOTS", 4)):
        monkeypatch.setattr(N, name, rows)
    whole = N._best_of_chunks

    def bounded(*arguments):
        best = whole(*arguments)

        def checked(asking, stored):
            assert max(len(asking), len(stored)) <= 64, "too many rows in a task"
            return best(asking, stored)
        return checked

    monkeypatch.setattr(N, "_best_of_chunks", bounded)
    vectors, keys = np.random.default_rng(3).normal(size=(400, 3)), np.arange(400) % 5
    vectors[100:] *= 0.01
    rows = spark.createDataFrame([(i, None if i == 7 else int(key), v.tolist()) for i, (v, key) in enumerate(zip(vectors, keys))], "id bigint, key int, vector array<double>")
    found = {(r["id"], r["place"]): r["neighbour"] for r in N.nearest_history(rows, rows, k).collect()}
    for i, vector in enumerate(vectors):
        other = [j for j in range(400) if (None if j == 7 else keys[j]) != (None if i == 7 else keys[i])]
        ranked = sorted(other, key=lambda j: (round(float(((vector - vectors[j]) ** 2).sum()), 9), j))
        assert [found[i, place + 1] for place in range(k)] == ranked[:k]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_by_buckets_finds_far_neighbours(spark, data, k):
    """On the given embeddings neighbours are 60 degrees away: what a query meets by chance must not settle it."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vector"))
    copies = rows.filter("id % 2 = 0").select((F.col("id") + 1000000).alias("id"), (F.col("key") + 100).alias("key"), "vector")
    wanted, found = ({(r["id"], r["neighbour"]) for r in search(rows, rows.union(copies), k).collect()}
                     for search in (N.nearest_history, N.nearest_by_buckets))
    assert len(found) == len(wanted) == k * rows.count()
    assert len(found & wanted) / len(wanted) >= 0.9


def test_nearest_by_buckets_of_odd_rows(spark):
    schema = "id string, key string, vector array<double>"
    store = spark.createDataFrame([("s", "A", [1.0, 0.0]), ("t", "A", [1.0, 0.0]), ("u", "B", [0.0, 9.0]), ("v", "C", [1.0]), ("w", "C", None), ("x", None, [1.0, 0.0]),
                                   ("y", "C", [float("nan"), 0.0]), ("z", "C", [])], schema)
    asked = spark.createDataFrame([("near", "Q", [1.0, 0.0]), ("far", "A", [-1.0, 0.1]), ("short", "Q", [-5.0]), ("long", "Q", [1.0] * 3), ("none", "Q", None),
                                   ("void", "Q", [None, 1.0]), ("same", "C", [1.0])], schema)
    assert {(r["id"], r["neighbour"], r["place"]) for r in N.nearest_by_buckets(asked, store).collect()} == {
        ("near", "s", 1), ("far", "u", 1), ("short", "v", 1)}
    assert {(r["id"], r["neighbour"], r["place"]) for r in N.nearest_by_buckets(asked, store, k=2).collect()} == {
        ("near", "s", 1), ("near", "t", 2), ("far", "u", 1), ("short", "v", 1)}
    assert N.nearest_by_buckets(asked, store.limit(0)).count() == 0 and N.nearest_by_buckets(asked.limit(0), store).count() == 0


RANKED = [("A", 1, 0), ("A", 2, 1), ("A", 3, 1), ("B", 1, 1), ("C", 1, 0), ("C", 2, 0)]


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame(RANKED, "cve string, rank int, label int")


def test_zero_based_metrics(ranked):
    rows = {r["k"]: r for r in K.ranking_metrics_zero_based(ranked, [1, 2, 10]).collect()}
    assert rows[1]["recall"] == pytest.approx((0 + 1 + 0) / 3)
    assert rows[2]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    # A: ranks 1 and 2 from 0, B: rank 0, C: none.
    assert rows[10]["manual_effort"] == pytest.approx((1.5 + 0 + 0) / 3)
    assert rows[1]["manual_effort"] == pytest.approx((1 + 0 + 0) / 3)
    assert rows[10]["mrr"] == pytest.approx(((1 / 2 + 1 / 3) / 2 + 1 + 0) / 3)


def test_first_hit_metrics(ranked):
    rows = {r["k"]: r for r in K.ranking_metrics_first_hit_effort(ranked, [1, 2, 10]).collect()}
    assert rows[1]["manual_effort"] == 1.0
    assert rows[2]["manual_effort"] == pytest.approx((2 + 1 + 2) / 3)
    assert rows[10]["manual_effort"] == pytest.approx((2 + 1 + 10) / 3)
    assert rows[2]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_first_rr_metrics(ranked):
    row = K.ranking_metrics_first_rr(ranked, 2).first()
    assert row["recall"] is None and row["undefined"] == 1 and row["mrr"] == pytest.approx((1 / 2 + 1 + 0) / 3)
    row = K.ranking_metrics_first_rr(ranked.filter("cve != 'C'"), 2).first()
    assert row["recall"] == pytest.approx(0.75)


def test_average_rank_metrics(ranked):
    ranks = K.average_positive_rank(ranked)
    assert {r["cve"]: r["avg_rank"] for r in ranks.collect()} == {"A": 2.5, "B": 1.0, "C": None}
    known = ranks.filter("avg_rank is not null")
    assert {r["k"]: r["recall"] for r in K.recall_at_k_avg_rank(known, [1, 2, 3]).collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    assert K.mrr_avg_rank(known).first()[0] == pytest.approx((1 / 2.5 + 1) / 2)
    assert {r["k"]: r["manual_effort"] for r in K.manual_effort_avg_rank(known, [2, 9]).collect()} == {2: 1.5, 9: 1.75}
    recalls = [r["recall"] for r in K.recall_at_k_avg_rank(known).orderBy("k").collect()]
    assert recalls == sorted(recalls) and len(recalls) == 14


def test_grid_search_prefers_weight_nearest_one(spark):
    rows = [("A", "x", 1, 0.5, 0.5), ("A", "y", 0, 0.4, 0.4), ("B", "z", 0, 0.1, 0.1)]
    table = spark.createDataFrame(rows, "cve string, commit_id string, label int, similarity double, f1 double")
    found = K.grid_search_weight(table, k=1).collect()
    assert [r["weight"] for r in found if r["best"]] == [1.1]
    assert {r["hits"] for r in found} == {1} and {r["advisories"] for r in found} == {2}


@pytest.mark.parametrize("rows, wanted", [
    ([(0.1, 0), (0.9, 1)], 1.0), ([(0.9, 0), (0.1, 1)], 0.0), ([(0.5, 0), (0.5, 1)], 0.5), ([(0.5, 1), (0.7, 1)], 0.0),
    ([(0.2, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.8, 1), (0.1, 1)], None)])
def test_roc_auc(spark, rows, wanted):
    if wanted is None:
        pairs = [(p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b]
        wanted = sum(pairs) / len(pairs)
    assert C.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()["auc"] == pytest.approx(wanted)


def test_reports(spark):
    rows = spark.createDataFrame([("A", True, True), ("A", False, True), ("B", False, False)], "cve string, answer boolean, label boolean")
    report = C.classification_report(rows).first().asDict()
    assert report == pytest.approx({"accuracy": 2 / 3, "precision": 1.0, "recall": 0.5, "f1": 2 / 3})
    assert C.advisory_accuracy(rows).first().asDict() == {"correct_cves": 1, "total_cves": 2, "cve_accuracy": 0.5}
    nothing = rows.filter("cve = 'B'")
    assert C.classification_report(nothing).first()["f1"] == 0.0
    assert {(r["label"], r["answer"]): r["n"] for r in C.confusion_matrix(nothing).collect()} == {
        (False, False): 1, (False, True): 0, (True, False): 0, (True, True): 0}


def test_narrow_numeric_bounds(spark):
    rows = spark.createDataFrame([(127, 126, -128, -127, 40000, 1.5), (0, 0, 0, 0, 0, 2.5)],
                                 "a bigint, b bigint, c int, d int, e bigint, f double")
    report = R.narrow_numeric(rows)
    assert {r["column"]: r["to_type"] for r in report.collect()} == {
        "a": "smallint", "b": "tinyint", "c": "smallint", "d": "tinyint", "e": "int", "f": "float"}
    assert dict(R.apply_types(rows, report).dtypes)["b"] == "tinyint"


def test_training_logs(spark):
    log = spark.createDataFrame(
        [("r", i, loss) for i, loss in enumerate([5.0, 4.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3])] + [("s", i, 5.0 - i) for i in range(4)],
        "run string, epoch int, loss double")
    assert {r["run"]: r["epoch"] for r in M.early_stop_epoch(log, 2).collect()} == {"r": 3, "s": 3}
    assert {r["run"]: r["epoch"] for r in M.early_stop_epoch(log, 3).collect()} == {"r": 7, "s": 3}
    assert {r["run"]: (r["epoch"], r["loss"]) for r in M.best_checkpoint(log).collect()} == {"r": (4, 3.0), "s": (3, 2.0)}
    steps = spark.createDataFrame([("r", 1, 0.5, 0.5), ("r", 2, 0.9, 0.4), ("r", 3, 0.6, 0.6), ("r", 4, 0.6, 0.9)],
                                  "run string, epoch int, recall double, mrr double")
    assert M.best_checkpoint_by_metrics(steps).first().asDict() == {"run": "r", "epoch": 3, "recall": 0.6, "mrr": 0.6}


def test_classifier_heads(spark):
    rng = random.Random(1)
    rows = [("u%d" % i, i % 2, [float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)]) for i in range(60)]
    table = spark.createDataFrame(rows, "url string, label int, embedding array<double>")
    scored = M.score_commits(M.fit_commit_classifier(table), table)
    assert C.roc_auc(scored.withColumnRenamed("prob", "score")).first()["auc"] > 0.95
    pairs = table.select(F.lit("A").alias("cve"), F.col("url").alias("commit_id"), "label",
                         F.col("embedding").alias("desc_vector"), F.col("embedding").alias("commit_vector"))
    predicted = M.score_pairs(M.fit_pair_classifier(pairs), pairs).collect()
    assert all((r["prediction"] > 0.5) == (r["label"] == 1) for r in predicted)


def test_nearest_by_buckets_settles_copies_in_fine_buckets(spark, monkeypatch):
    """Near copies are settled by buckets that hold little else; only what these leave meets the coarser ones."""
    used, whole = [], N._by_buckets
    monkeypatch.setattr(N, "_by_buckets", lambda *a: (used.append(a[4]), whole(*a))[1])
    vectors = np.random.default_rng(2).normal(size=(40, 16))
    frame = lambda shift, some: spark.createDataFrame([(i + shift, i + shift, (v + shift * 1e-9).tolist()) for i, v in enumerate(some)], "id bigint, key bigint, vector array<double>")
    rows = frame(0, vectors)
    found = N.nearest_by_buckets(rows, rows.union(frame(1000, vectors))).collect()
    assert {(r["id"], r["neighbour"]) for r in found} == {(i, i + 1000) for i in range(40)} and used == [24]
