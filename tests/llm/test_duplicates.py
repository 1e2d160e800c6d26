"""Near and exact duplicates against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fixtrace.llm import exact_dedup
from fixtrace.llm.components import components
from fixtrace.llm.exact_dedup import directory, exact_duplicates, key_filter, marked
from fixtrace.llm.near_dedup import bands_needed, near_duplicates
from fixtrace.llm.shingles import PIECE_BYTES, shingle_set, word_hashes
from fixtrace.session import run_folder


def grams(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    """Smallest reachable id per row, by comparing every two rows."""
    sets = [grams(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]) and group[x] != group[y]:
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    return {(i, least[g]) for (i, _), g in zip(rows, group)}


def invented(seed, groups, copies):
    """Texts in groups of copies with one to three changed words each."""
    pick = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{pick.randint(0, 400)}" for _ in range(pick.randint(1, 90))]
        for _ in range(pick.randint(1, copies)):
            own = list(words)
            for _ in range(pick.randint(0, 3)):
                own[pick.randrange(len(own))] = f"x{pick.randint(0, 10 ** 6)}"
            rows.append((len(rows) * 7 % 1000 + len(rows) * 1000, " ".join(own)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_as_brute_force(spark, width, percent):
    rows = invented(width, 30, 12)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {(r.doc_id, r.component_id) for r in found} == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(grams(t, width)) for i, t in rows}


def test_near_duplicates_of_one_large_group(spark):
    """A chain of texts, each like the next but not like the far ones, is one group although leaders miss most of it."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join([f"n{j}" for j in range(k)] + words[k:])))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in found} == brute(rows, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, long), (7, long + " end"), (7, long + " end"),
            (None, long), (None, "only here and there"), (8, "ÄB c d"), (9, "äB c d"), (10, "x" * (2 * PIECE_BYTES) + " y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("node", "n", "a", "b", "key", "label", "component_id")})
    found = near_duplicates(docs, width=3, percent=85).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].kept for i in (1, 2, 3))
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[4].n_shingles == 1
    assert by_id[7].component_id == 6 and [r.kept for r in found if r.doc_id == 7] == [False, False]
    assert by_id[9].component_id == 9 and by_id[8].component_id == 8  # only A-Z is lowered
    assert sorted((r.component_id is None, r.kept) for r in found if r.doc_id is None) == [(False, False), (True, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_two_texts(spark):
    """Each row goes by its own text, whatever other texts its id has."""
    def text(letter, end=""):
        return " ".join(f"{letter}{k}" for k in range(60)) + end

    rows = [(1, text("a")), (1, text("b")), (2, text("a", " end")), (5, text("c")), (5, text("d")), (5, text("d")), (3, text("c", " end")), (4, text("d", " end"))]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == [
        (1, 58, 1, True), (1, 58, 1, True), (2, 59, 1, False), (3, 59, 3, True), (4, 59, 4, True),
        (5, 58, 3, False), (5, 58, 4, False), (5, 58, 4, False)]


def test_shingles_of_long_texts_do_not_depend_on_pieces():
    text = " ".join(f"word{k}" for k in range(100_000))
    assert len(text) > PIECE_BYTES
    whole = word_hashes(text.encode())
    assert len(whole) == 100_000 and len(set(whole.tolist())) == 100_000
    assert (whole[-3:] == word_hashes(b"word99997 word99998 word99999")).all()
    assert len(shingle_set(text, 5)) == 100_000 - 4


def test_bands_meet_the_bound():
    bands = bands_needed(85, 4, 1e-5)
    assert 2 * (1 - 0.85 ** 4) ** bands <= 1e-5 < 2 * (1 - 0.85 ** 4) ** (bands - 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.label for r in components(links, run_folder(spark, "t"), "c").collect()}
    assert found == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_exact_duplicates_of_odd_rows(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (6, "A"), (6, "A"), (7, "a "), (None, "a"), (None, "lone"), (8, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("key", "slot", "bucket", "keep_id", "text_sha256")})
    found = exact_duplicates(docs, capacity=2).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [(by_id[i].keep_id, by_id[i].group_size, by_id[i].kept) for i in (1, 5, 3)] == [(5, 4, False), (5, 4, True), (5, 4, False)]
    assert by_id[2].keep_id == 4 and not by_id[2].kept and by_id[4].kept
    assert by_id[6].group_size == 2 and by_id[6].kept and by_id[7].group_size == 1 and by_id[8].kept
    assert sorted((r.keep_id is None, r.kept) for r in found if r.doc_id is None) == [(False, False), (True, True)]
    assert exact_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("key, hot_rows, filter_bits", [
    (lambda c: F.xxhash64(c), 64, 1 << 24), (lambda c: F.xxhash64(c), 1, 1 << 6),
    (lambda c: F.lit(7).cast("bigint"), 64, 1 << 12), (lambda c: F.pmod(F.xxhash64(c), F.lit(3)) - 1, 2, 1 << 12)])
def test_exact_duplicates_chain_colliding_keys(spark, monkeypatch, key, hot_rows, filter_bits):
    """Whatever the keys, hot or not and however full the filter: texts are told apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "_key", key)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", filter_bits)
    rows = [(i, f"text {i % 40}" if i % 3 else "hot") for i in range(300)] + [(1000 + i, f"lone {i}") for i in range(50)]
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    expected = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), capacity=8)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_key_filter_misses_no_key(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"), (F.col("id") % 100 + 1).alias("n"))
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("key"))
    found = marked(rows, key_filter(keys)).collect()
    repeated = {i for i in range(1000) if i % 100 > 0}
    hot = {i for i in range(1000) if i % 100 >= exact_dedup.HOT_ROWS}
    assert repeated <= {r.id for r in found if r.repeats} and sum(r.repeats for r in found) < len(repeated) + 10
    assert hot <= {r.id for r in found if r.hot} and sum(r.hot for r in found) < len(hot) + 10
    assert marked(rows, key_filter(keys.limit(0))).filter("repeats OR hot").isEmpty()


@pytest.mark.parametrize("count, capacity", [(0, 4), (1, 4), (1000, 16), (1000, 1)])
def test_directory_leads_each_key_to_one_bucket(spark, count, capacity):
    keys = spark.range(count).select(F.xxhash64("id").alias("key"))
    slots, depth = directory(keys, run_folder(spark, "t"), capacity)
    placed = keys.withColumn("slot", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")).join(slots, "slot")
    assert placed.count() == count
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert not sizes or max(sizes) <= capacity
    if count:
        assert slots.groupBy("slot").count().filter("count > 1").isEmpty()
