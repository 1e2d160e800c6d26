"""Continuous forms of the verdict run, the trace feed, the report cache and the progress counter.

All of them work on any streaming source and keep their progress in a checkpoint folder, so a stopped
query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fixtrace import constants as K
from fixtrace.operators.preparation import resume


def written(spark, path: str) -> DataFrame | None:
    """Rows a sink has written so far, None before the first ones."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over all input there is now; gives back what the sink holds."""
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def stream_verdicts(candidates: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str,
                    checkpoint: str, keys: tuple[str, ...] = ("cve", "commit_id")) -> StreamingQuery:
    """Judge arriving candidates once each, also after a restart.

    The keys of what the stream has seen are its state. Only what the sink holds when the stream starts, from another
    run or a batch whose end was not recorded, is looked up as well, so a batch reads no more of the sink as it grows.
    """
    before = written(candidates.sparkSession, path)
    done = None if before is None else before.select(*keys)

    def run(batch: DataFrame, _: int) -> None:
        judge(resume(batch, done, keys)).write.mode("append").parquet(path)

    return (candidates.dropDuplicates(list(keys)).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_traces(spans: DataFrame, late: str | None = None) -> DataFrame:
    """Distinct spans (trace_id, span_id) of all traces as they arrive. The state is kept per span.

    With ``late`` the state of a span ends that long after it, and spans that are later than that are left out.
    """
    if late is None:
        return spans.dropDuplicates(["trace_id", "span_id"]).select("trace_id", "span_id", "start")
    return (spans.withWatermark("start", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
            .select("trace_id", "span_id", "start"))


def stream_ttl_dedupe(requests: DataFrame, ttl_seconds: int = K.REPORT_TTL_SECONDS,
                      late: str | None = None) -> DataFrame:
    """(key, asked_at, fetched_at, fetched): answers from a cache that forgets after a time to live.

    A fetched report serves until ``ttl_seconds`` after it was fetched; serving does not prolong it.
    ``requests`` has key and asked_at. State per key: the time of its last fetch, one number. No request is left
    out: one that arrives behind others of its key, however late, is served from what was fetched last. With
    ``late`` the state of a key ends when its report has expired, and requests later than that are left out.
    """
    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        asked = np.sort(np.concatenate([b["asked_at"].to_numpy(dtype="datetime64[us]") for b in batches]))
        ttl = np.timedelta64(ttl_seconds, "s")
        fetched_at = np.empty_like(asked)
        fetched = np.zeros(len(asked), dtype=bool)
        last = np.datetime64(state.get[0], "us") if state.exists else None
        at = 0
        while at < len(asked):
            if last is None or asked[at] - last >= ttl:
                last = asked[at]
                fetched[at] = True
            # All requests before the report expires get it.
            end = int(np.searchsorted(asked, last + ttl))
            fetched_at[at:end] = last
            at = end
        state.update((int(last.astype("int64")),))
        if late is not None:
            expires = int(last.astype("int64") // 1000) + ttl_seconds * 1000
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "asked_at": asked, "fetched_at": fetched_at, "fetched": fetched})

    kind = requests.schema["key"].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout
    if late is not None:
        requests, timeout = requests.withWatermark("asked_at", late), GroupStateTimeout.EventTimeTimeout
    return requests.groupBy("key").applyInPandasWithState(
        serve, f"key {kind}, asked_at timestamp, fetched_at timestamp, fetched boolean", "fetched_at bigint", "append", timeout)


def progress_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, n): finished items per window; works on a stream or a table.

    With ``late`` the state of a window ends that long after it, and items that are later than that are left out.
    """
    counted = events.withWatermark(time, late) if events.isStreaming and late is not None else events
    return counted.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "n")


def drain_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over all input there is now; the sink holds its latest full result."""
    query = (stream.writeStream.outputMode("complete")
             .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
