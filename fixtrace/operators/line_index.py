"""A stored index of the pieces of source lines, which many searches share.

The lines are written once, in blocks, with posting lists of the pieces of a few characters that blocks hold. A search
looks its pieces up, reads only the folders of blocks that hold them all, and tests the lines there as a whole.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.operators.search import AUTOMATON_CHARACTERS, _answers, _hit, _matches, _met, _small
from fixtrace.session import run_folder, staged

#: Characters of a piece, lines of a block, folders that blocks and pieces are dealt to.
PIECE = 5
BLOCK_LINES = 4096
FOLDERS = 64
#: Pieces of a text that have to be met, the rarest ones.
ASKED_PIECES = 4
#: Alternatives that a regular expression is broken into; one with more is read against all lines.
MOST_WAYS = 64


def _pieces(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)))


def _folder_of(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(FOLDERS)).cast("int")


class LineIndex:
    """Tables of an index in a folder: lines (block, path, line_no, line), postings (key, block), held (key, blocks)."""

    SCHEMAS = {"lines": "path string, line_no bigint, line string, block bigint, part int",
               "postings": "key bigint, block bigint, bucket int", "held": "key bigint, blocks bigint, bucket int"}

    def __init__(self, spark: SparkSession, folder: str):
        self.lines, self.postings, self.held = (self.table(spark, folder, name) for name in self.SCHEMAS)

    @classmethod
    def table(cls, spark: SparkSession, folder: str, name: str) -> DataFrame:
        return spark.read.schema(cls.SCHEMAS[name]).parquet(f"{folder}/{name}")


def build_line_index(lines: DataFrame, folder: str) -> LineIndex:
    """Write lines (path, line_no, line) and the posting lists of their pieces to a folder of the shared storage.

    A block is some thousand lines that follow each other as they are read, so that the many lines with a common piece cost one
    posting. A piece stands once for each block that holds it; a block's lines lie in one file, so its pieces are made distinct
    before they move. Lines are dealt to folders by block, postings by piece, so a search reads few of them.
    Null lines and paths hold nothing and are left out.
    """
    rows = lines.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line").filter(
        "path IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL")
    # Written once, and all else is made from what is written: the numbers are not the same in another run.
    blocked = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("block", F.expr(f"_at div {BLOCK_LINES}")).drop("_at")
    blocked.withColumn("part", _folder_of("block")).write.partitionBy("part").parquet(f"{folder}/lines")
    stored = LineIndex.table(lines.sparkSession, folder, "lines")
    pieces = stored.select("block", F.explode(_pieces("line")).alias("piece"))
    postings = pieces.select(F.xxhash64("piece").alias("key"), "block").distinct().withColumn("bucket", _folder_of("key"))
    postings.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{folder}/postings")
    held = LineIndex.table(lines.sparkSession, folder, "postings").groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("blocks"))
    held.write.partitionBy("bucket").parquet(f"{folder}/held")
    return LineIndex(lines.sparkSession, folder)


def _candidates(index: LineIndex, texts: DataFrame) -> DataFrame:
    """(text, block): blocks that hold the rarest pieces of a text; texts whose pieces no block holds have none."""
    keys = texts.select("text", F.explode(F.transform(_pieces("text"), lambda p: F.xxhash64(p))).alias("key")).distinct()
    keys = staged(keys.withColumn("bucket", _folder_of("key")), run_folder(texts.sparkSession, "asked"), "keys")
    folders = [r[0] for r in keys.select("bucket").distinct().collect()]  # FOLDERS numbers at most
    counted = keys.join(index.held.filter(F.col("bucket").isin(folders)), ["bucket", "key"], "left").select(
        "text", "bucket", "key", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    rare = counted.groupBy("text").agg(F.slice(F.sort_array(F.collect_list(F.struct("blocks", "bucket", "key"))), 1, ASKED_PIECES).alias("few"))
    rare = rare.filter(F.col("few")[0]["blocks"] > 0).select("text", F.size("few").alias("wanted"), F.explode("few").alias("p"))
    asked = rare.select("text", "wanted", "p.bucket", "p.key")
    met = index.postings.filter(F.col("bucket").isin(folders)).join(asked, ["bucket", "key"])
    return (met.groupBy("text", "block").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"))
            .filter("n = wanted").select("text", "block"))


def _lines_of(index: LineIndex, blocks: DataFrame, once: bool = False) -> DataFrame:
    """Lines with the texts whose blocks they stand in; only folders with such blocks are read."""
    blocks = staged(blocks.withColumn("part", _folder_of("block")), run_folder(blocks.sparkSession, "met"), "blocks")
    folders = [r[0] for r in blocks.select("part").distinct().collect()]
    return index.lines.filter(F.col("part").isin(folders)).join(F.broadcast(blocks) if once else blocks, ["part", "block"])


def _lines_once(index: LineIndex, blocks: DataFrame, name: str) -> DataFrame:
    """Lines of the blocks, each once, with all that is asked there (column ``name``) as a list. Lines do not move."""
    return _lines_of(index, blocks.groupBy("block").agg(F.collect_set(name).alias("asked")), once=True)


def indexed_search(index: LineIndex, queries: DataFrame, cap: int | None = None) -> DataFrame:
    """As ``code_search``, over a stored index.

    Texts of five characters or more read only blocks that hold their rarest pieces; shorter ones read all lines. What is
    read is searched by one automaton while the texts are few, else each text meets the lines of its blocks.
    """
    queries = queries.select("query", "path").filter("query <> ''").distinct()
    texts = queries.select(F.col("query").alias("text")).distinct()
    long = F.length("text") >= PIECE
    candidates = _candidates(index, texts.filter(long))
    few = (texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0) <= AUTOMATON_CHARACTERS
    if few:
        own = {is_long: sorted(r[0] for r in texts.filter(long if is_long else ~long).collect()) for is_long in (True, False)}
        read = [(_lines_once(index, candidates, "text"), own[True]), (index.lines, own[False])]
        parts = [_met(lines, wanted).withColumnRenamed("query", "text") for lines, wanted in read if wanted]
    else:
        short = texts.filter(~long).select("text", F.substring("text", 1, 1).alias("symbol"))
        symbols = index.lines.select("path", "line_no", "line", F.explode(F.array_distinct(F.split("line", ""))).alias("symbol"))
        parts = [_lines_of(index, candidates).select("path", "line_no", "line", "text"), symbols.join(short, "symbol").drop("symbol")]
    found = reduce(lambda a, b: a.unionByName(b), parts) if parts else index.lines.select("path", "line_no", "line", F.lit("").alias("text")).filter(F.lit(False))
    asked = queries.select(F.col("query").alias("text"), F.col("path").alias("only"))
    hits = (found.filter(F.contains("line", F.col("text"))).join(_small(asked, few), "text")
            .filter(F.col("only").isNull() | (F.col("only") == F.col("path"))).select(F.col("text").alias("query"), _hit()))
    return _answers(hits, queries.select("query").distinct(), cap, K.SEARCH_TOO_MANY, K.SEARCH_NONE)


_ATOM = re.compile(r"\\[dDwWsSbBAzZ]|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[\^$.]|[^\\\[\]().*+?{}|^$]", re.S)
_TIMES = re.compile(r"(?:[*?]|\{0?,?\d*\}|\{0,\d*\})[+?]?")
_REPEATED = re.compile(r"(?:\+|\{[1-9]\d*(?:,\d*)?\})[+?]?")


def required_texts(pattern: str) -> list[list[str]] | None:
    """Texts that a line matching an expression holds, as alternatives (or) of lists (and).

    Understood are plain characters, classes and ``.`` (which only end a text), ``* + ? {n}`` behind these, and plain
    alternatives ``|`` in one level of brackets or outside. None for an expression with anything else, or whose
    alternatives do not all need a text of a piece's length.
    """
    if re.search(r"\(\?|\\[QEpPxukNc0-9]", pattern):
        return None
    whole = _ways(pattern)
    if whole is None:
        return None
    needed = [[run for run in way if len(run) >= PIECE] for way in whole]
    return needed if all(needed) else None


def _ways(pattern: str) -> list[list[str]] | None:
    """Runs of plain characters that must occur, for each way through the alternatives."""
    done: list[list[list[str]]] = []
    ways: list[list[str]] = [[""]]
    at = 0
    while at < len(pattern):
        if pattern[at] == "|":
            done.append(ways)
            ways, at = [[""]], at + 1
            continue
        if pattern[at] == "(":
            close = pattern.find(")", at)
            inner = pattern[at + 1:close]
            if close < 0 or re.search(r"[(\\\[]", inner):
                return None
            parts, at = _ways(inner), close + 1
            optional, repeated = _TIMES.match(pattern, at), _REPEATED.match(pattern, at)
            if parts is None:
                return None
            if optional:
                ways = [way + [""] for way in ways]
            else:
                ways = [way[:-1] + [way[-1] + part[0], *part[1:]] if len(part) > 1 else way[:-1] + [way[-1] + part[0]] for way in ways for part in parts]
            if repeated:
                ways = [way + [""] for way in ways]
            at = (optional or repeated).end() if optional or repeated else at
        else:
            atom = _ATOM.match(pattern, at)
            if not atom:
                return None
            at = atom.end()
            optional, repeated = _TIMES.match(pattern, at), _REPEATED.match(pattern, at)
            text = atom[0]
            plain = text if len(text) == 1 and text not in "^$." else text[1] if len(text) == 2 and text[0] == "\\" and not text[1].isalnum() else None
            if plain is None or optional:
                ways = [way + [""] for way in ways]
            else:
                ways = [way[:-1] + [way[-1] + plain] for way in ways]
                if repeated:
                    ways = [way + [""] for way in ways]
            at = (optional or repeated).end() if optional or repeated else at
        if len(ways) > MOST_WAYS:
            return None
    return [way for alternative in [*done, ways] for way in alternative]


def indexed_grep(index: LineIndex, queries: list[tuple[str, str | None]], cap: int | None = None) -> DataFrame:
    """As ``grep`` with extended expressions, over a stored index.

    An expression whose every alternative needs a text of five characters or more reads only the blocks that hold all texts of
    one alternative; another one reads all lines.
    """
    spark = index.lines.sparkSession
    known = {pattern: required_texts(pattern) for pattern, _ in queries}
    needs = [(pattern, way, text) for pattern, ways in known.items() if ways for way, texts in enumerate(ways) for text in set(texts)]
    parts = []
    if needs:
        table = spark.createDataFrame(needs, "query string, way int, text string")
        total = table.groupBy("query", "way").agg(F.count(F.lit(1)).alias("texts"))
        met = _candidates(index, table.select("text").distinct()).join(table, "text").groupBy("query", "way", "block").agg(F.count(F.lit(1)).alias("n"))
        blocks = met.join(total, ["query", "way"]).filter("n = texts").select("query", "block").distinct()
        parts.append(_matches(_lines_once(index, blocks, "query"), [(pattern,) for pattern, ways in known.items() if ways],
                              lambda q: F.array_contains("asked", q[0]) & F.col("line").rlike(q[0])))
    parts.append(_matches(index.lines, [(pattern,) for pattern, ways in known.items() if not ways], lambda q: F.col("line").rlike(q[0])))
    asked = spark.createDataFrame(queries, "query string, only string").distinct()
    hits = reduce(lambda a, b: a.unionByName(b), [p.select("path", "line_no", "line", "query") for p in parts])
    hits = hits.join(F.broadcast(asked), "query").filter(F.col("only").isNull() | (F.col("only") == F.col("path"))).select("query", _hit())
    return _answers(hits, asked.select("query").distinct(), cap, K.GREP_TOO_MANY, K.SEARCH_NONE)
