"""Pipelines around a user's model: score, judge, record, flatten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace.functions.text import asbool
from fixtrace.operators.joins import join_small
from fixtrace.operators.neighbours import history_for_verdicts, nearest_history
from fixtrace.session import reliable

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

#: Rows that a scorer gets and gives back at once; rows may hold several long texts.
SCORED_ROWS = 1000


def score_with(df: DataFrame, scorer: Scorer, schema: str, on_error: str = "keep") -> DataFrame:
    """Add the columns of ``schema`` by calling a batch scorer, such as a model client.

    A batch has at most ``SCORED_ROWS`` rows. If one fails it is tried in halves, so good rows are called again about log n times at most. A failing row
    is kept with null results and the message in the column ``error`` (``keep``), or left out (``skip``).
    """
    if on_error not in ("skip", "keep"):
        raise ValueError(f"on_error must be 'skip' or 'keep', not {on_error!r}")
    added = T.StructType.fromDDL(schema)
    fields = list(df.schema.fields) + list(added.fields)
    if on_error == "keep":
        fields.append(T.StructField("error", T.StringType()))
    names = [f.name for f in added.fields]

    def attempt(rows: pd.DataFrame) -> pd.DataFrame:
        scored = scorer(rows)
        result = rows.reset_index(drop=True)
        for name in names:
            result[name] = scored[name].to_numpy()
        if on_error == "keep":
            result["error"] = None
        return result

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            todo = [batch.iloc[at:at + SCORED_ROWS] for at in reversed(range(0, len(batch), SCORED_ROWS))]
            while todo:
                rows = todo.pop()
                try:
                    yield attempt(rows)
                except Exception as error:
                    if len(rows) > 1:
                        half = len(rows) // 2
                        todo += [rows.iloc[half:], rows.iloc[:half]]
                    elif on_error == "keep":
                        yield rows.assign(**{name: None for name in names}, error=str(error))

    return df.mapInPandas(run, T.StructType(fields))


def three_stage(candidates: DataFrame, store: DataFrame, advisory: DataFrame, summarise: Scorer,
                embed: Scorer, judge: Scorer,
                search: Callable[[DataFrame, DataFrame], DataFrame] = nearest_history) -> DataFrame:
    """Summarise each candidate, embed the summary, fetch the nearest past fix, judge.

    ``candidates`` has cve, commit_id, diff; ``store`` id, key, vector, document. ``summarise`` adds
    summary, ``embed`` embedding, ``judge`` answer. Rows that fail leave the chain at their stage. ``search`` is
    ``nearest_history`` or, where most have a near copy in the store, ``nearest_by_buckets``. The
    embedded rows are written down before the search reads them again and again: each model is called once.
    """
    summed = score_with(candidates, summarise, "summary string", on_error="skip").filter("summary is not null")
    embedded = reliable(score_with(summed, embed, "embedding array<double>", on_error="skip").filter("embedding is not null"))
    pair = F.concat_ws("|", "cve", "commit_id")
    queries = embedded.select(pair.alias("id"), F.col("cve").alias("key"), F.col("embedding").alias("vector"))
    history = history_for_verdicts(queries, store, advisory, search).drop("distance", "place")
    informed = embedded.drop("embedding").withColumn("id", pair).join(history, "id").drop("id")
    return score_with(informed, judge, "answer string", on_error="skip").filter("answer is not null")


def select_relevant_files(files: DataFrame) -> DataFrame:
    """Files (commit_id, path, relevant) to look at, with the commit's class.

    One file: kept, class 1. Else the relevant ones: several 2, one 1. None relevant: class 0, all are kept.
    """
    sizes = files.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("relevant") == 1).alias("wanted"))
    verdict = (
        F.when((F.col("files") == 1) | (F.col("wanted") == 1), 1).when(F.col("wanted") > 1, 2).otherwise(0))
    keep = (F.col("files") == 1) | (F.col("wanted") == 0) | (F.col("relevant") == 1)
    return join_small(files, sizes, ["commit_id"]).filter(keep).select("commit_id", "path", verdict.alias("class"))


def impact_gate(files: DataFrame) -> DataFrame:
    """(commit_id, gate, file_order): ``local`` if all answers are 1, else ``context`` and the first other file.

    A commit whose files have no answer at all needs context for all of them: file_order is null.
    """
    gates = files.groupBy("commit_id").agg(
        F.count("answer").alias("answers"),
        F.min(F.when(F.col("answer") != 1, F.col("file_order"))).alias("file_order"))
    local = (F.col("answers") > 0) & F.col("file_order").isNull()
    return gates.select("commit_id", F.when(local, "local").otherwise("context").alias("gate"), "file_order")


def gate_functions(gates: DataFrame, functions: DataFrame) -> DataFrame:
    """(commit_id, function): distinct functions (commit_id, file_order, function) whose callers to look up."""
    open_gates = gates.filter("gate = 'context'").select("commit_id", F.col("file_order").alias("_only"))
    wanted = F.col("_only").isNull() | (F.col("file_order") == F.col("_only"))
    return join_small(functions, open_gates, ["commit_id"]).filter(wanted).select("commit_id", "function").distinct()


def build_verdict_record(df: DataFrame, output: list[str], metadata: list[str]) -> DataFrame:
    """Nested record input / output / metadata from flat columns."""
    given = ["cve", "desc", "repo", "commit_id", "commit_message", "diff", "label"]
    return df.select(
        F.struct(*[c for c in given if c in df.columns]).alias("input"),
        F.struct(*output).alias("output"), F.struct(*metadata).alias("metadata"))


def flatten_verdicts(records: DataFrame, answer: str = "answer") -> DataFrame:
    """(cve, commit_id, answer, label, confidence, correct) of nested verdict records."""
    fields = records.schema["output"].dataType.names
    flat = records.select(
        F.col("input.cve").alias("cve"), F.col("input.commit_id").alias("commit_id"),
        F.col(f"output.{answer}").alias("answer"), F.col("input.label").alias("label"),
        (F.col("output.confidence") if "confidence" in fields else F.lit(None).cast("int")).alias("confidence"))
    judged = flat.withColumns({"answer": asbool(flat, "answer"), "label": asbool(flat, "label")})
    return judged.withColumn("correct", F.col("answer") == F.col("label"))
