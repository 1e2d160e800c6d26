"""Average-rank metrics against published values.

FIXTRACE_RANKS names a CSV file with header, columns cve and rank: the ranks behind these values.
"""

import os

import pytest
from pyspark.sql import functions as F

from fixtrace.operators import ranking as K

# Share of 480 advisories found, and mean effort, within the first k.
RECALL = {
    1: 0.35208333333333336, 2: 0.40208333333333335, 3: 0.45208333333333334, 4: 0.47708333333333336, 5: 0.5104166666666666,
    6: 0.5270833333333333, 7: 0.5375, 8: 0.5479166666666667, 9: 0.5625, 10: 0.5729166666666666, 20: 0.6541666666666667,
    30: 0.6916666666666667, 50: 0.725, 100: 0.7770833333333333}
EFFORT = {
    1: 1.0, 2: 1.6479166666666667, 3: 2.245833333333333, 4: 2.79375, 5: 3.314583333333333, 6: 3.8041666666666667,
    7: 4.277083333333334, 8: 4.739583333333333, 9: 5.191666666666666, 10: 5.629166666666666, 20: 9.516666666666667,
    30: 12.759375, 50: 18.576041666666665, 100: 31.186458333333334}
MRR = 0.42430104228110016


@pytest.fixture(scope="module")
def ranks(spark):
    path = os.environ.get("FIXTRACE_RANKS")
    if not path:
        pytest.skip("FIXTRACE_RANKS is not set")
    table = spark.read.schema("cve string, rank double").option("header", True).csv(path)
    return table.select("cve", F.col("rank").alias("avg_rank"))


def test_recall(ranks):
    assert {r["k"]: r["recall"] for r in K.recall_at_k_avg_rank(ranks).collect()} == pytest.approx(RECALL)


def test_effort(ranks):
    assert {r["k"]: r["manual_effort"] for r in K.manual_effort_avg_rank(ranks).collect()} == pytest.approx(EFFORT)


def test_mrr(ranks):
    assert K.mrr_avg_rank(ranks).first()["mrr"] == pytest.approx(MRR)
