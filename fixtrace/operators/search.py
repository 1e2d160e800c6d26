"""Many searches at once over a table of source lines or file paths.

A list of searches is short, the corpus is large: each line is read once and tested inside its row, and only
hits move. Fixed texts come as a table of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace import constants as K
from fixtrace.functions.text import explode_once
from fixtrace.operators.ordering import join_small, top_k
from fixtrace.session import run_folder, staged

BATCH = 256
#: Lengths of the pieces of texts, longest first.
PIECES = (16, 8, 4)
#: Characters of fixed texts that are sent to all tasks as one automaton, of some 50 bytes a character.
AUTOMATON_CHARACTERS = 1 << 20


def _matches(corpus: DataFrame, queries: list[tuple], test: Callable[[Column, int], Column]) -> DataFrame:
    """Corpus rows once per matching search, as column ``query``; searches are taken in batches."""
    parts = []
    for at in range(0, len(queries), BATCH):
        batch = queries[at:at + BATCH]
        hits = F.array_compact(F.array(*[F.when(test(query), F.lit(query[0])) for query in batch]))
        parts.append(explode_once(corpus, corpus.columns, hits, "query"))
    empty = corpus.withColumn("query", F.lit("")).filter(F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


def _answers(hits: DataFrame, queries: DataFrame, cap: int | None, too_many: str, none: str) -> DataFrame:
    """(query, answer): the hits of a search, or one line saying there are too many or none.

    Without a cap all hits are given; they are written down, as they also tell which searches have none, and are not
    brought together by search, of which one may have most of them. With a cap, a hit over it is enough to know, so each task
    passes on at most ``cap + 1`` per search.
    """
    before, after = none.split("%s")
    if cap is None:
        hits = staged(hits.select("query", "answer"), run_folder(hits.sparkSession, "hits"), "hits")
        unmet = queries.join(hits.select("query").distinct(), "query", "left_anti")
        return hits.unionByName(unmet.select("query", F.concat(F.lit(before), "query", F.lit(after)).alias("answer")))
    few = top_k(hits, ["query"], [F.col("answer")], cap + 1)
    lists = few.groupBy("query").agg(F.collect_list("answer").alias("answers"))
    shown = (
        F.when(F.col("answers").isNull(), F.array(F.concat(F.lit(before), "query", F.lit(after))))
        .when(F.size("answers") > cap, F.array(F.lit(too_many)))
        .otherwise(F.col("answers")))
    return queries.join(lists, "query", "left").select("query", F.explode(shown).alias("answer"))


def _small(asked: DataFrame, few: bool) -> DataFrame:
    """Searches sent to all tasks where there are few, so that their hits need not move."""
    return F.broadcast(asked) if few and asked.count() <= AUTOMATON_CHARACTERS else asked


def _hit() -> Column:
    return F.concat_ws(":", "path", F.col("line_no").cast("string"), "line").alias("answer")


def _pieces(size: int) -> Column:
    """All runs of ``size`` characters of the line."""
    return F.regexp_extract_all(F.col("line"), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _holding(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of a table of fixed texts. A line can only hold a text if it holds each piece of the text.

    Texts are taken by length: those of a class share the length of their pieces, so a short text costs what it
    matches and does not shorten the pieces of others. Of a text's pieces the one is looked for that the fewest lines
    hold, so texts that begin alike do not meet. A line is cut up once per class; only places and pieces move,
    and what met is compared as a whole. Texts shorter than the shortest piece are tested inside each row.
    """
    hit = F.contains("line", F.col("query")) & (F.col("only").isNull() | (F.col("only") == F.col("path")))
    asked = queries.select("query", F.col("path").alias("only"))
    parts = []
    for at, size in enumerate(PIECES):
        longer = PIECES[at - 1] if at else None
        own = asked.filter(F.length("query") >= size)
        if longer is not None:
            own = own.filter(F.length("query") < longer)
        grams = own.select("query", "only", F.explode(F.array_distinct(
            F.regexp_extract_all("query", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))).alias("piece"))
        wanted = grams.select("piece").distinct()
        cut = explode_once(lines, ["path", "line_no"], F.array_distinct(_pieces(size)), "piece").join(wanted, "piece", "left_semi")
        counts = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("held"))
        # A text one of whose pieces no line holds has no hit; the inner join with min over all pieces drops it.
        rarest = (grams.join(counts, "piece", "left").groupBy("query", "only")
                  .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "piece")).alias("best"))
                  .filter("best.held > 0").select("query", "only", F.col("best.piece").alias("piece")))
        places = cut.join(rarest, "piece").select("path", "line_no", "query", "only").distinct()
        parts.append(places.join(lines, ["path", "line_no"]).filter(hit).select("query", _hit()))
    tiny = asked.filter((F.length("query") < PIECES[-1]) & (F.length("query") > 0))
    symbols = tiny.select("query", "only", F.substring("query", 1, 1).alias("piece"))
    first = explode_once(lines, ["path", "line_no", "line"], F.array_distinct(F.split("line", "")), "piece").join(symbols, "piece")
    parts.append(first.filter(hit).select("query", _hit()))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _automaton(texts: list[str]):
    """Automaton over fixed texts; a process builds it once for a list of texts."""
    import hashlib

    import ahocorasick  # a module of the process itself, so that what hangs on it outlives a task

    held = ahocorasick.__dict__.setdefault("_fixtrace_automata", {})
    key = hashlib.blake2b("\0".join(texts).encode("utf-8", "surrogatepass")).digest()
    if key not in held:
        held.clear()
        made = ahocorasick.Automaton()
        for number, text in enumerate(texts):
            made.add_word(text, number)
        made.make_automaton()
        held[key] = made
    return held[key]


def _met(lines: DataFrame, texts: list[str]) -> DataFrame:
    """(path, line_no, line, query) for each text that a line holds, in one pass over the lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(texts)
        for batch in batches:
            rows, found = [], []
            for row, line in enumerate(batch.column(2).to_pylist()):
                if line:
                    own = {number for _, number in automaton.iter(line)}
                    rows += [row] * len(own)
                    found += own
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array([texts[k] for k in found], pa.string())],
                                                 names=["path", "line_no", "line", "query"])

    kept = lines.select("path", "line_no", "line")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("query", T.StringType())]))


def _held(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of a table of fixed texts: by one automaton while all texts together have at most AUTOMATON_CHARACTERS, which
    every task then holds, else by pieces that are joined. The rows are the same."""
    texts = queries.select("query").filter("query <> ''").distinct()
    if not 0 < (texts.agg(F.sum(F.length("query") + 1)).first()[0] or 0) <= AUTOMATON_CHARACTERS:
        return _holding(lines, queries)
    met = _met(lines, sorted(r[0] for r in texts.collect()))
    asked = queries.select("query", F.col("path").alias("only"))
    return (met.join(_small(asked, True), "query").filter(F.col("only").isNull() | (F.col("only") == F.col("path")))
            .select("query", _hit()))


def code_search(lines: DataFrame, queries: DataFrame, cap: int | None = None) -> DataFrame:
    """Lines holding a fixed text (case counts), each search optionally in one file only.

    ``lines`` has path, line_no, line; ``queries`` has query (not empty) and path (null for all files). Lines are read
    once, by an automaton over all texts while these are few, else cut into pieces that meet those of the texts.
    Answers read ``path:line:content``; no hit gives one line saying so, as do more than ``cap`` hits if there is a cap.
    """
    queries = queries.select("query", "path").distinct()
    hits = _held(lines, queries)
    return _answers(hits, queries.select("query").distinct(), cap, K.SEARCH_TOO_MANY, K.SEARCH_NONE)


def basic_to_regex(pattern: str) -> str:
    """The pattern of a POSIX basic expression, as line search tools read it by default, for ``rlike``.

    There ``+ ? | ( ) { }`` are plain characters and their escaped forms are the operators.
    """
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "[":
            close = pattern.find("]", i + (3 if pattern[i + 1:i + 2] == "^" else 2))
            if close > 0:
                inside = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out.append("[" + inside + "]")
                i = close + 1
                continue
            out.append("\\[")
        elif char == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(pattern[i] if pattern[i] in "+?|(){}" else "\\" + pattern[i])
        elif char in "+?|(){}" or char == "*" and not out:
            out.append("\\" + char)
        else:
            out.append(char)
        i += 1
    return "".join(out)


def grep(lines: DataFrame, queries: list[tuple[str, str | None]], cap: int | None = None, basic: bool = False) -> DataFrame:
    """As ``code_search`` with a list of (regular expression, path or None).

    Expressions are extended ones, as Spark reads them; with ``basic`` they are POSIX basic ones.
    """
    def matches(query):
        pattern, path = query
        pattern = basic_to_regex(pattern) if basic else pattern
        hit = F.col("line").rlike(pattern)
        return hit if path is None else hit & (F.col("path") == path)

    hits = _matches(lines, queries, matches).select("query", _hit())
    asked = lines.sparkSession.createDataFrame([(q[0],) for q in queries], "query string").distinct()
    return _answers(hits, asked, cap, K.GREP_TOO_MANY, K.SEARCH_NONE)


def parse_hits(answer: Column | str) -> Column:
    """Struct (file, line, content) of ``file:line:content``; the content may hold colons."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    parts = F.split(answer, ":", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("file"), F.get(parts, F.lit(1)).alias("line"),
                    F.get(parts, F.lit(2)).alias("content"))


def _glob_class(inside: str, negated: bool) -> str:
    """Character class of a glob; a range that runs backwards holds nothing."""
    parts, i = [], 0
    while i < len(inside):
        if i + 2 < len(inside) and inside[i + 1] == "-":
            if inside[i] <= inside[i + 2]:
                parts.append(f"\\x{{{ord(inside[i]):x}}}-\\x{{{ord(inside[i + 2]):x}}}")
            i += 3
        else:
            parts.append(f"\\x{{{ord(inside[i]):x}}}")
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(parts) + "]"


def glob_to_regex(glob: str) -> str:
    """Regular expression for a glob over the whole path; ``*`` and ``?`` also match ``/``."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        begin = i + 2 if glob[i + 1:i + 2] == "!" else i + 1
        close = glob.find("]", begin + 1) if char == "[" else -1  # a bracket that comes first is a plain character
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            out.append(_glob_class(glob[begin:close], begin == i + 2))
            i = close
        else:
            out.append("\\" + char if not char.isalnum() and char != "_" and ord(char) < 128 else char)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def file_search(paths: DataFrame, queries: list[str], cap: int | None = None) -> DataFrame:
    """(query, answer): paths matching a glob, or, without glob characters, holding the text in any case.

    No hit gives one line saying so, as do more than ``cap`` hits if there is a cap.
    """
    def matches(query):
        text = query[0]
        if any(char in text for char in K.GLOB_CHARS):
            return F.col("path").rlike(glob_to_regex(text))
        return F.contains(F.lower(F.col("path")), F.lit(text.lower()))

    hits = _matches(paths, [(q,) for q in queries], matches).select("query", F.col("path").alias("answer"))
    asked = paths.sparkSession.createDataFrame([(q,) for q in queries], "query string").distinct()
    return _answers(hits, asked, cap, K.FILES_TOO_MANY, K.FILES_NONE)


def page_lines(lines: DataFrame, start: Column | int, size: int = K.PAGE_SIZE) -> DataFrame:
    """(path, line_no, line, header): the page of each file that begins at a line, counted from 1.

    A start outside the file gives one row with an error as header. ``start`` may be a column over the
    file's number of lines, ``n``; see ``scroll``.
    """
    wanted = start if isinstance(start, Column) else F.lit(start)
    sizes = lines.groupBy("path").agg(F.max("line_no").alias("n")).withColumn("first", wanted)
    bad = F.col("first").isNull() | (F.col("first") < 1) | (F.col("first") > F.col("n"))
    last = F.least(F.col("first") + size - 1, F.col("n"))
    one, two, three, _ = K.PAGE_HEADER.replace("%s", "|").split("|")
    head = F.concat(F.lit(one), F.col("first").cast("string"), F.lit(two), last.cast("string"),
                    F.lit(three), F.col("n").cast("string"), F.lit(":"))
    pages = sizes.filter(~bad).select("path", "first", last.alias("last"), head.alias("header"))
    shown = join_small(lines, pages, ["path"], spread_by=["line_no"]).filter(F.col("line_no").between(F.col("first"), F.col("last")))
    sorry = K.PAGE_INVALID.split("%s")
    errors = sizes.filter(bad).select(
        "path", F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"),
        F.concat(F.lit(sorry[0]), F.col("n").cast("string"), F.lit(sorry[1])).alias("header"))
    return shown.select("path", F.col("line_no").cast("bigint"), "line", "header").unionByName(errors)


def scroll(start: Column | int, direction: str, size: int = K.PAGE_SIZE) -> Column:
    """First line after scrolling a page ``up`` or ``down``; it stays inside the file."""
    start = start if isinstance(start, Column) else F.lit(start)
    if direction == "up":
        return F.greatest(start - size, F.lit(1))
    if direction == "down":
        return F.greatest(F.least(start + size, F.col("n") - size + 1), F.lit(1))
    raise ValueError(f"pages go up or down, not {direction!r}")
