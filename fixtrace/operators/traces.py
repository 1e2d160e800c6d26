"""Traces made of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_trace(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id): the distinct spans of the trace that began last.

    ``spans`` has trace_id, span_id and start. The spans stay rows, however many there are.
    """
    begun = spans.groupBy("trace_id").agg(F.min("start").alias("begun"))
    newest = begun.agg(F.max_by("trace_id", F.struct("begun", "trace_id"))).scalar()
    return spans.filter(F.col("trace_id") == newest).select("trace_id", "span_id").distinct()
