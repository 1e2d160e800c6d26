"""Joins of source lines with the line ranges of functions and call sites.

Ranges are looked up by blocks of lines: a range is listed under each block it touches, so both joins are
on (repo, path, block) and a long file is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
FILE = ["repo", "path"]


def _in_blocks(df: DataFrame, start: str, end: str) -> DataFrame:
    first, last = (F.floor(F.col(c) / BLOCK) for c in (start, end))
    return df.withColumn("_block", F.explode(F.sequence(first, last)))


def lines_in_functions(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(repo, path, line_no) with the first function whose span (start, end, name) holds the line.

    Lines outside every function get the name ``NULL`` and no span.
    """
    places = lines.select(*FILE, "line_no", F.floor(F.col("line_no") / BLOCK).alias("_block"))
    listed = _in_blocks(spans.select(*FILE, "start", "end", "name"), "start", "end")
    inside = (F.col("line_no") >= F.col("start")) & (F.col("line_no") <= F.col("end"))
    hits = (
        places.join(listed, [*FILE, "_block"]).filter(inside)
        .groupBy(*FILE, "line_no")
        .agg(F.min(F.struct("start", "end", "name")).alias("span"))
    )
    found = places.drop("_block").join(hits, [*FILE, "line_no"], "left")
    return found.select(*FILE, "line_no", F.coalesce("span.name", F.lit("NULL")).alias("name"),
                        F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def call_context(calls: DataFrame, lines: DataFrame, spans: DataFrame, before: int = 3,
                 after: int = 10) -> DataFrame:
    """(repo, path, line_no, context): the lines around each call, clipped to its function.

    From ``before`` lines above the call to ``after`` lines with the call's own counted in. A call outside
    every function has no context.
    """
    placed = lines_in_functions(calls, spans)
    windows = placed.filter("start is not null").select(
        *FILE, F.col("line_no").alias("call_line"),
        F.greatest(F.col("line_no") - before, F.col("start")).alias("from_line"),
        F.least(F.col("line_no") + after - 1, F.col("end")).alias("to_line"))
    listed = _in_blocks(windows, "from_line", "to_line")
    texts = lines.select(*FILE, "line_no", "line", F.floor(F.col("line_no") / BLOCK).alias("_block"))
    around = (
        listed.join(texts, [*FILE, "_block"])
        .filter(F.col("line_no").between(F.col("from_line"), F.col("to_line")))
        .groupBy(*FILE, "call_line")
        # At most before + after lines per call.
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    )
    context = around.select(*FILE, F.col("call_line").alias("line_no"),
                            F.array_join(F.col("lines.line"), "\n").alias("context"))
    return placed.select(*FILE, "line_no", "name").join(context, [*FILE, "line_no"], "left")
