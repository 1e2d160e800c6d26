"""Sources, sinks and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace import schema as S
from fixtrace import session
from fixtrace.sources import files as IO
from fixtrace.sources import named
from fixtrace.streaming import feeds, ledger


def test_commits_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    rows = [{"commit_id": "1", "owner": "o", "repo": "r", "commit_message": "m", "diff": "short"},
            {"commit_id": "2", "owner": "o", "repo": "r", "commit_message": "m", "diff": "x" * 50}]
    path.write_text("\n".join(map(json.dumps, rows)))
    assert IO.read_commits_jsonl(spark, str(path)).count() == 2
    kept = IO.read_commits_jsonl(spark, str(path), 49).collect()
    assert [(r["commit_id"], r["repo"]) for r in kept] == [("1", "o/r")]


def test_append_and_resume_jsonl(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "cve string, n int"
    assert IO.read_jsonl_if_there(spark, path, schema) is None
    rows = spark.createDataFrame([("A", 1)], schema)
    IO.append_jsonl(rows, path)
    IO.append_jsonl(rows.withColumn("n", F.lit(2)), path)
    (tmp_path / "out" / "broken.json").write_text('{"cve": "B", "n"')
    assert sorted(map(tuple, IO.read_jsonl_if_there(spark, path, schema).collect())) == [("A", 1), ("A", 2)]


def test_scores_csv(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([("A", "r", "1", 0.1, 1)], S.LEXICAL_SCORES)
    IO.write_scores_csv(rows, path)
    IO.write_scores_csv(rows, path)
    assert IO.read_scores_csv(spark, path).collect() == rows.collect() * 2


def test_stages_are_reused(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert IO.load_stage(spark, path, build).count() == IO.load_stage(spark, path, build).count() == 3
    assert len(built) == 1


def test_load_split_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.save_stage(spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test")), path, ["split"])
    part = IO.load_split(spark, path, "test")
    assert part.count() == 2
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()


def test_infer_schema_first_record(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"i": 1, "b": true, "f": 1.5, "s": "x", "l": [1], "n": null}\n{"i": "no"}\n')
    kinds = {f.name: f.dataType for f in IO.infer_schema_first_record(spark, str(path))}
    assert kinds == {"i": T.IntegerType(), "b": T.IntegerType(), "f": T.FloatType(), "s": T.StringType(), "l": T.StringType(), "n": T.StringType()}


def shard_sizes(spark, path):
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    return sorted((r["bytes"], r["n"]) for r in rows.groupBy("file").agg(
        F.sum(F.octet_length(F.to_json(F.struct("i", "t")))).alias("bytes"), F.count("*").alias("n")).collect())


def test_write_sharded(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(1000).select(F.col("id").alias("i"), F.lit("x" * 80).alias("t")).repartition(3)
    files = IO.write_sharded(rows, path, max_bytes=2000)
    sizes = shard_sizes(spark, path)
    assert len(sizes) == files and sum(n for _, n in sizes) == 1000
    assert sizes[-1][0] <= 2000 and sum(b for b, _ in sizes) / files >= 950


def test_one_wide_row_does_not_split_the_others(spark, tmp_path):
    narrow = spark.range(1000).select(F.col("id").alias("i"), F.lit("short").alias("t"))
    for wide, cap, files in ((200_000, 400_000, 2), (500_000, 400_000, 2), (10, 400_000, 1)):
        path = str(tmp_path / f"wide-{wide}")
        rows = narrow.union(spark.range(1).select(F.lit(-1).cast("long").alias("i"), F.lit("w" * wide).alias("t")))
        assert IO.write_sharded(rows, path, max_bytes=cap) <= files
        sizes = shard_sizes(spark, path)
        assert len(sizes) <= files and sum(n for _, n in sizes) == 1001
        assert all(b <= cap or n == 1 for b, n in sizes)
    assert IO.write_sharded(narrow.limit(0), str(tmp_path / "none")) == 0
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_small_shards_share_tasks(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(4000).select(F.col("id").alias("i"), F.repeat(F.lit("x"), F.when(F.col("id") % 500 == 0, 3000).otherwise(80).cast("int")).alias("t"))
    spark.sparkContext.setJobGroup("shards", "shards")
    try:
        files = IO.write_sharded(rows.repartition(3), path, max_bytes=2000)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("shards") for s in tracker.getJobInfo(job).stageIds}
        most = max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = shard_sizes(spark, path)
    assert most < 20 < 300 < len(sizes) <= files
    assert all(b <= 2000 or n == 1 for b, n in sizes) and sum(n for _, n in sizes) == 4000
    IO.write_sharded(rows.limit(10), path, max_bytes=2000, mode="append")
    assert spark.read.parquet(path).count() == 4010
    IO.write_sharded(rows.limit(10), path, max_bytes=2000)
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if not p.name.startswith(("part-", "."))) == ["_SUCCESS"]
    assert spark.read.parquet(path).count() == 10
    IO.write_sharded(rows, path, max_bytes=2000, mode="ignore")
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(AnalysisException):
        IO.write_sharded(rows, path, max_bytes=2000, mode="error")


def test_small_shards_keep_types(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.sql("""SELECT CAST(id AS TINYINT) a, TIMESTAMP'2020-01-01 00:00:00' b, TIMESTAMP_NTZ'1900-01-01 00:00:00' c, DATE'0999-01-01' d,
        CAST(id AS DECIMAL(20, 3)) e, map('k', array(id, NULL)) f, named_struct('x', X'00ff', 'y', IF(id = 1, NULL, 'e')) g, id > 2 h, float(id) i
        FROM range(50)""")
    IO.write_sharded(rows, path, max_bytes=500)
    found = spark.read.parquet(path)
    assert found.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))


def test_commits_with_invalid_bytes(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_bytes(b'{"commit_id": "1", "owner": "o", "repo": "r", "commit_message": "m", "diff": "a\xffb\xc3"}\n\n{"commit_id": "2"}\nno json\n')
    rows = sorted((str(r["commit_id"]), r["repo"], str(r["diff"])) for r in IO.read_commits_jsonl(spark, str(path)).collect())
    assert rows == [("1", "o/r", "a\ufffdb\ufffd"), ("2", "", "None"), ("None", "", "None")]


def test_traces_by_project(spark, tmp_path):
    spans = spark.createDataFrame([("t", "1", "p"), ("t", "2", "q")], "trace_id string, span_id string, project string")
    IO.write_traces_by_project(spans, str(tmp_path / "tr"))
    assert {p.name for p in (tmp_path / "tr").glob("project=*")} == {"project=p", "project=q"}


def test_results_by_name(spark, tmp_path):
    record = {"input": {"cve": "A", "label": 1}, "output": {"answer": True}, "metadata": {}}
    for name in ("top_10_model_x.jsonl", "random_10_y.jsonl", "other.txt"):
        (tmp_path / name).write_text(json.dumps(record))
    found = {(r["subset"], r["model"]) for r in IO.read_results_glob(spark, str(tmp_path)).collect()}
    assert found == {("top_10", "model_x"), ("random_10", "y")}
    names = spark.createDataFrame([("predictions_candidates_x_random_10.csv",)], "file string")
    assert IO.with_prediction_subset(names).first()["subset"] == "random_10"
    (tmp_path / "results_Agent.csv").write_text("subset,model,correct_cves,total_cves,cve_accuracy,accuracy,precision,recall,f1\ns,m,1,2,0.5,1,1,1,1\n")
    row = IO.read_results_csv(spark, str(tmp_path)).first()
    assert (row["approach"], row["total_cves"]) == ("Agent", 2)


def test_ground_truth(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"CVE-1": {"ground_truth": {"commit": ["u1", "u2"]}}, "CVE-2": {"ground_truth": {"commit": ["u3"]}}}, indent=1))
    rows = IO.read_ground_truth(spark, str(tmp_path / "truth.json")).collect()
    assert {r["cve"]: r["urls"] for r in rows} == {"CVE-1": ["u1", "u2"], "CVE-2": ["u3"]}



RESULT = "cve string, score double"


def test_named_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"top_{i % 3}_m_{i % 4}.jsonl", f"CVE-{i}", i / 7) for i in range(500)] + [("top_0_m_9.jsonl", None, None), ("x.txt", "a\nb", 1.0)]
    df = spark.createDataFrame(rows, f"file string, {RESULT}").repartition(5)
    named.write_named(df, folder)
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {r[0] for r in rows}
    found = named.read_named(spark, folder, RESULT).collect()
    assert sorted((r.file, r.cve or "", r.score or 0) for r in found) == sorted((f, c or "", s or 0) for f, c, s in rows if f.endswith(".jsonl"))
    assert {(r.subset, r.model) for r in found if r.file == "top_1_m_2.jsonl"} == {("top_1", "m_2")}
    assert {r.file for r in named.read_named(spark, folder, RESULT, prefix="top_2").collect()} == {r[0] for r in rows if r[0].startswith("top_2")}
    assert [(r.cve, r.score) for r in named.read_named(spark, folder, RESULT, suffix=".txt").collect()] == [("a\nb", 1.0)]
    assert named.read_named(spark, folder, RESULT, prefix="none").count() == 0


def test_named_files_replace_or_refuse(spark, tmp_path):
    folder, schema = str(tmp_path / "out"), f"file string, {RESULT}"
    named.write_named(spark.createDataFrame([("a_b_c.jsonl", "1", 1.0), ("a_b_d.jsonl", "2", 1.0)], schema), folder)
    again = spark.createDataFrame([("a_b_c.jsonl", "3", 1.0), ("a_b_e.jsonl", "4", 1.0)], schema)
    with pytest.raises(Exception, match="is there already"):
        named.write_named(again, folder)
    assert sorted(r.cve for r in named.read_named(spark, folder, RESULT).collect()) == ["1", "2"]
    named.write_named(again, folder, overwrite=True)
    assert sorted(r.cve for r in named.read_named(spark, folder, RESULT).collect()) == ["2", "3", "4"]
    named.write_named(again.limit(0), folder)
    for name in (None, "", "a/b", "_c"):
        with pytest.raises(Exception, match="cannot name a file"):
            named.write_named(spark.createDataFrame([(name, "1", 1.0)], schema), folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")) == []


@pytest.mark.parametrize("task_bytes", [1, 7, 64, 1 << 20])
def test_named_files_are_cut_at_line_ends(spark, tmp_path, task_bytes):
    (tmp_path / "a_b_c.jsonl").write_bytes(b'{"cve": "x\xff"}\r\n\n' + b"".join(b'{"cve": "%d"}\n' % 10 ** (i % 9) for i in range(30)) + b'no json\n{"cve": "end"}')
    (tmp_path / "a_b_d.jsonl").write_bytes(b"")
    reader = named.NamedReader(str(tmp_path), "", ".jsonl", task_bytes)
    lines = [v for p in reader.partitions() for batch in reader.read(p) for v in batch.column("value").to_pylist()]
    assert lines == ['{"cve": "x\ufffd"}'] + ['{"cve": "%d"}' % 10 ** (i % 9) for i in range(30)] + ["no json", '{"cve": "end"}']


def test_named_files_push_names_down(spark, tmp_path):
    for name in ("top_1_a", "top_2_a", "low_1_b"):
        (tmp_path / f"{name}.jsonl").write_text('{"cve": "1"}\n')
    (tmp_path / "top_9_z.jsonl").mkdir()
    before = spark.conf.get(named.PUSHDOWN, "false")
    spark.conf.set(named.PUSHDOWN, "true")
    try:
        rows = named.read_named(spark, str(tmp_path), RESULT)
        assert {r.file for r in rows.filter("file LIKE 'top%' AND score IS NULL").collect()} == {"top_1_a.jsonl", "top_2_a.jsonl"}
        assert [r.file for r in rows.filter("file IN ('low_1_b.jsonl', NULL)").collect()] == ["low_1_b.jsonl"]
        assert rows.filter("file = 'top_1_a.jsonl' AND file LIKE '%b.jsonl'").count() == 0
    finally:
        spark.conf.set(named.PUSHDOWN, before)


def write_batches(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_verdicts_restart_and_overlap(spark, tmp_path):
    schema = "cve string, commit_id string"
    source, sink, judged = tmp_path / "in", str(tmp_path / "out"), []

    def judge(batch):
        judged.append(batch.count())
        return batch.withColumn("answer", F.lit(True))

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(source))
        feeds.stream_verdicts(stream, judge, sink, str(tmp_path / checkpoint)).awaitTermination()

    write_batches(spark, source, [[("A", "1"), ("A", "2"), ("A", "2")]], schema)
    run("c1")
    write_batches(spark, source, [[("A", "2"), ("B", "2")]], schema)
    run("c1")
    run("c2")
    rows = sorted((r["cve"], r["commit_id"]) for r in spark.read.parquet(sink).collect())
    assert rows == [("A", "1"), ("A", "2"), ("B", "2")]
    assert judged == [2, 1, 0]


def _verdict_run(spark, tmp_path, checkpoint, judge):
    stream = spark.readStream.schema("cve string, commit_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.stream_verdicts_once(stream, judge, str(tmp_path / "out"), str(tmp_path / checkpoint), buckets=4).awaitTermination()


def _verdicts(spark, tmp_path):
    rows = ledger.committed(spark, str(tmp_path / "out"))
    return [] if rows is None else sorted((r["cve"], r["commit_id"]) for r in rows.collect())


def _yes(batch):
    return batch.withColumn("answer", F.lit(True))


def test_ledger_judges_each_key_once(spark, tmp_path):
    judged = []

    def judge(batch):
        judged.append(batch.count())
        return _yes(batch)

    schema = "cve string, commit_id string"
    write_batches(spark, tmp_path / "in", [[("A", "1"), ("A", "2"), ("A", "2")]], schema)
    _verdict_run(spark, tmp_path, "c1", judge)
    write_batches(spark, tmp_path / "in", [[("A", "2"), ("B", "2")]], schema)
    _verdict_run(spark, tmp_path, "c1", judge)
    _verdict_run(spark, tmp_path, "c2", judge)
    assert _verdicts(spark, tmp_path) == [("A", "1"), ("A", "2"), ("B", "2")]
    assert judged[:2] == [2, 1] and not any(judged[2:])


@pytest.mark.parametrize("step", ["before the commit", "after the commit"])
def test_ledger_survives_a_lost_driver(spark, tmp_path, monkeypatch, step):
    """Files without an entry do not count and are judged anew; an entry without the stream's own record is not repeated."""
    write_batches(spark, tmp_path / "in", [[("A", "1"), ("B", "1")]], "cve string, commit_id string")
    commit = ledger.commit

    def killed(*args):
        if step == "after the commit":
            commit(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger, "commit", killed)
    with pytest.raises(Exception, match="lost"):
        _verdict_run(spark, tmp_path, "c", _yes)
    monkeypatch.setattr(ledger, "commit", commit)
    assert len(list((tmp_path / "out" / "rows").glob("*/*/*"))) == 1
    assert _verdicts(spark, tmp_path) == ([] if step == "before the commit" else [("A", "1"), ("B", "1")])
    _verdict_run(spark, tmp_path, "c", _yes)
    assert _verdicts(spark, tmp_path) == [("A", "1"), ("B", "1")]
    assert len(list((tmp_path / "out" / "rows").glob("*/*/*"))) == (2 if step == "before the commit" else 1)


def test_ledger_takes_the_first_of_two_attempts(spark, tmp_path):
    sink = str(tmp_path / "out")
    assert not ledger.is_committed(spark, sink, "s", 0)
    assert ledger.commit(spark, sink, "s", 0, "a") and not ledger.commit(spark, sink, "s", 0, "b")
    assert ledger.is_committed(spark, sink, "s", 0) and not ledger.is_committed(spark, sink, "s", 1)
    assert [tuple(r) for r in spark.read.schema(ledger.LEDGER).json(f"{sink}/ledger/*/*.json").collect()] == [("s", 0, "a")]


def test_ledger_of_empty_and_null_batches(spark, tmp_path):
    sink, schema = str(tmp_path / "out"), "cve string, commit_id string"
    assert ledger.committed(spark, sink) is None
    assert ledger.write_batch(spark.createDataFrame([], schema), _yes, sink, "s", 0)
    rows = spark.createDataFrame([("A", None), (None, None), ("B", "1"), ("B", "1")], schema)
    assert ledger.write_batch(rows, _yes, sink, "s", 1) and not ledger.write_batch(rows, _yes, sink, "s", 1)
    assert ledger.committed(spark, sink).count() == 3
    assert ledger.write_batch(rows, _yes, sink, "s", 2)
    assert ledger.committed(spark, sink).filter("cve = 'B'").count() == 1


def test_stream_traces_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{i % 5}", f"s{i % 40}", start + dt.timedelta(seconds=i)) for i in range(100)]
    write_batches(spark, tmp_path / "in", [rows[:50], rows[50:]], "trace_id string, span_id string, start timestamp")
    stream = spark.readStream.schema("trace_id string, span_id string, start timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = feeds.drain(feeds.stream_traces(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted((r["trace_id"], r["span_id"]) for r in found.collect()) == sorted({(t, s) for t, s, _ in rows})


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_ttl(spark, tmp_path, batches):
    rng = random.Random(batches)
    start, at, rows = dt.datetime(2024, 1, 1), 0, []
    for _ in range(120):
        at += rng.choice([1, 600, 1800, 3600, 4000])
        rows.append((rng.choice("abh"), start + dt.timedelta(seconds=at)))
    schema = "key string, asked_at timestamp"
    size = len(rows) // batches
    for i in range(batches):
        write_batches(spark, tmp_path / "in", [rows[i * size:(i + 1) * size]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = feeds.drain(feeds.stream_ttl_dedupe(stream, 3600), str(tmp_path / "out"), str(tmp_path / "c"))
    last, wanted = {}, []
    for key, asked in rows:
        if key not in last or (asked - last[key]).total_seconds() >= 3600:
            last[key] = asked
        wanted.append((key, asked, last[key], last[key] == asked))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_streams_return_every_late_row(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [[("a", start + dt.timedelta(hours=5)), ("b", start + dt.timedelta(days=9))],
            [("a", start), ("c", start)], [("a", start + dt.timedelta(hours=6)), ("b", start)]]
    schema = "key string, asked_at timestamp"
    for batch in rows:
        write_batches(spark, tmp_path / "in", [batch], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    served = feeds.drain(feeds.stream_ttl_dedupe(stream, 3600), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted((r["key"], r["asked_at"]) for r in served.collect()) == sorted(r for batch in rows for r in batch)
    assert {(r["asked_at"] - start).total_seconds(): r["fetched"] for r in served.filter("key = 'a'").collect()} == {18000: True, 0: False, 21600: True}
    counted = feeds.drain_complete(feeds.progress_counts(stream, time="asked_at"), str(tmp_path / "counts"), str(tmp_path / "c2"))
    assert sum(r["n"] for r in counted.collect()) == 6
    spans = stream.select(F.col("key").alias("trace_id"), F.col("asked_at").cast("string").alias("span_id"), F.col("asked_at").alias("start"))
    assert feeds.drain(feeds.stream_traces(spans), str(tmp_path / "spans"), str(tmp_path / "c3")).count() == 6


def test_progress_counts_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24),) for i in range(90)]
    write_batches(spark, tmp_path / "in", [rows[:40], rows[40:]], "ts timestamp")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = feeds.drain_complete(feeds.progress_counts(stream, late="10 days"), str(tmp_path / "out"), str(tmp_path / "c"))
    batch = feeds.progress_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
