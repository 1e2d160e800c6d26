"""Column functions over unified diffs.

Every function works inside its row (split, filter, transform), so a diff column is rewritten in the
scan stage and nothing is shuffled. Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.functions.text import as_col, base_name, extension_of, let, lines_of, strip


def starts_with_any(line: Column, prefixes: list[str]) -> Column:
    hit = F.startswith(line, F.lit(prefixes[0]))
    for prefix in prefixes[1:]:
        hit = hit | F.startswith(line, F.lit(prefix))
    return hit


def unified_zero(diff: Column | str) -> Column:
    """The diff as if made with no context lines.

    Up to the first hunk everything stays; after it only file headers, hunk headers and changed lines.
    Hunk headers get zero line counts and lose their trailing text.
    """
    lines = F.transform(lines_of(diff), lambda line: F.struct(
        line.alias("text"), F.startswith(line, F.lit("@@")).alias("hunk")))

    def keep(lines, first):
        kept = F.filter(
            lines,
            lambda line, i: (first == 0) | (i < first) | line["hunk"]
            | starts_with_any(line["text"], ["+", "-", "diff --git", "index"]),
        )
        return F.transform(kept, lambda line: F.when(
            line["hunk"], F.regexp_replace(line["text"], K.HUNK_HEADER, "@@ -$1,0 +$3,0 @@")
        ).otherwise(line["text"]))

    first = let(lines, lambda ls: F.struct(
        ls.alias("lines"), F.array_position(F.transform(ls, lambda line: line["hunk"]), True).alias("first")))
    return F.array_join(let(first, lambda s: keep(s["lines"], s["first"])), "\n")


def file_sections(diff: Column | str) -> Column:
    """One text per ``diff --git`` section; text before the first one is left out."""
    text = F.replace(as_col(diff), F.lit("\r\n"), F.lit("\n"))
    sections = F.split(F.regexp_replace(text, r"\n\z", ""), r"(?md)^(?=diff --git)")
    sections = F.filter(sections, lambda s: F.startswith(s, F.lit("diff --git")))
    return F.transform(sections, lambda s: F.regexp_replace(s, r"\n\z", ""))


def _first_line(section: Column) -> Column:
    return F.substring_index(section, "\n", 1)


def _from_first_hunk(section: Column) -> Column:
    """Text from the first hunk header on, or null."""
    at = F.locate("\n@@", section)
    return F.when(at > 0, F.substr(section, at + 1))


def minimal_diff(text: Column | str) -> Column:
    """Per file its ``diff --git`` line and everything from the first hunk on."""
    sections = F.transform(
        file_sections(text),
        lambda s: F.concat_ws("\n", _first_line(s), _from_first_hunk(s)),
    )
    return strip(F.array_join(sections, "\n"))


def file_diffs(diff: Column | str) -> Column:
    """Array of structs (path, text): the new path and its hunks. Explode it for one row per file.

    Files without a hunk or with a path that does not parse give nothing. A path that comes twice keeps
    its first place and its last text.
    """
    entries = F.transform(
        file_sections(F.coalesce(as_col(diff), F.lit(""))),
        lambda s: F.struct(
            strip(F.regexp_extract(_first_line(s), K.FILE_PATHS, 2)).alias("path"),
            strip(_from_first_hunk(s)).alias("text"),
        ),
    )
    entries = F.filter(entries, lambda e: (e["path"] != "") & e["text"].isNotNull())

    def merge(entries):
        paths = F.array_distinct(F.transform(entries, lambda e: e["path"]))
        merged = F.transform(
            paths, lambda path: F.element_at(F.filter(entries, lambda e: e["path"] == path), -1))
        return F.when(F.size(paths) == F.size(entries), entries).otherwise(merged)

    return let(entries, merge)


def code_version(diff: Column | str, added: bool) -> Column:
    """The added (or removed) lines without sign and outer blanks, comments left out, one per line."""
    mark = "+" if added else "-"
    marked = F.filter(lines_of(diff), lambda line: F.startswith(line, F.lit(mark)))
    bare = F.transform(marked, lambda line: strip(F.substr(line, F.lit(2))))
    code = F.filter(bare, lambda line: ~starts_with_any(line, K.COMMENT_STARTS))
    return F.array_join(F.transform(code, lambda line: F.concat(line, F.lit("\n"))), "")


def file_code(diff: Column | str, sep: str) -> Column:
    """Array of structs (path, code) with ``added + sep + removed``; files without code are left out."""
    versions = F.transform(
        file_diffs(diff),
        lambda f: F.struct(
            f["path"].alias("path"),
            code_version(f["text"], True).alias("added"),
            code_version(f["text"], False).alias("removed"),
        ),
    )
    kept = F.filter(versions, lambda v: (v["added"] != "") | (v["removed"] != ""))
    return F.transform(
        kept,
        lambda v: F.struct(
            v["path"].alias("path"),
            F.concat(v["added"], F.lit(sep), v["removed"]).alias("code"),
        ),
    )


def changed_paths(diff: Column | str) -> Column:
    """Array of the old paths named by ``diff --git`` lines."""
    return F.regexp_extract_all(as_col(diff), F.lit("(?md)^" + K.FILE_A_PATH), F.lit(1))


def files_and_extensions(diff: Column | str) -> Column:
    """Array of structs (filename, extension) over the changed files."""
    return F.transform(
        changed_paths(diff),
        lambda path: F.struct(
            base_name(path).alias("filename"), extension_of(path).alias("extension")
        ),
    )


def hunk_old_lines(patch: Column | str) -> Column:
    """Array of first changed line numbers: the start of each ``-a,b`` word plus three context lines."""
    starts = F.regexp_extract_all(as_col(patch), F.lit(K.OLD_RANGE_WORD), F.lit(1))
    return F.transform(starts, lambda s: s.cast("bigint") + K.HUNK_CONTEXT)


def extract_diff(show: Column | str) -> Column:
    """Everything from the first ``diff --git`` line on, '' if there is none."""
    text = F.regexp_replace(as_col(show), r"\r?\n\z", "")
    at = F.locate("\ndiff --git", text)
    return (
        F.when(F.startswith(text, F.lit("diff --git")), text)
        .when(at > 0, F.substr(text, at + 1))
        .otherwise(F.lit(""))
    )


def minimise_patch(patch: Column | str, remove_test: bool = True) -> Column:
    """Commit message and the changed files worth reading, or the name of an error.

    Left out are files whose changes are blank, whose paths do not parse and, unless switched off, with
    ``test`` in a path. A file without hunk is swallowed by the next one, as its command runs on to ``@``.
    """
    patch = as_col(patch)
    commands = F.regexp_extract_all(patch, F.lit(K.PATCH_COMMAND), F.lit(0))
    pieces = F.split(patch, K.PATCH_COMMAND)
    head = F.get(pieces, F.lit(0))
    head = F.when(F.contains(head, F.lit("\n")), F.substr(head, F.locate("\n", head) + 1)).otherwise("")
    head = F.substring_index(head, "\n---\n", 1)
    head = F.regexp_replace(head, r"\nSubject: \[([^\]]+)\] ", "\nSubject: ")
    head = F.concat(
        F.lit("Commit Message: "), strip(F.substring_index(head, "\nSubject: ", -1)), F.lit("\n")
    )

    def changed_text(body):
        changed = F.filter(F.split(body, "\n"), lambda line: starts_with_any(line, ["-", "+"]))
        return F.array_join(F.transform(changed, lambda line: strip(F.substr(line, F.lit(2)))), "")

    files = let(F.struct(commands.alias("commands"), pieces.alias("pieces")), lambda s: F.transform(
        F.arrays_zip(s["commands"].alias("command"),
                     F.slice(s["pieces"], F.lit(2), F.size(s["commands"])).alias("body")),
        lambda f: F.struct(
            F.regexp_extract(f["command"], K.PATCH_COMMAND_PATHS, 1).alias("a"),
            F.regexp_extract(f["command"], K.PATCH_COMMAND_PATHS, 2).alias("b"),
            f["body"].alias("body"),
            (strip(changed_text(f["body"])) == "").alias("blank"),
        ),
    ))

    def wanted(f):
        tested = F.contains(F.lower(f["a"]), F.lit("test")) | F.contains(F.lower(f["b"]), F.lit("test"))
        return ~f["blank"] & (f["a"] != "") & (~tested if remove_test else F.lit(True))

    def assemble(files):
        sections = F.transform(F.filter(files, wanted), lambda f: F.concat(
            F.lit("\na/"), f["a"], F.lit("\nb/"), f["b"], F.lit("\n"), f["body"], F.lit("\n")))
        return F.struct(
            F.concat(head, F.array_join(sections, "")).alias("text"),
            F.exists(files, lambda f: f["a"] == "").alias("odd"),
            F.exists(files, lambda f: f["blank"]).alias("empty"))

    return let(let(files, assemble), lambda r: (
        F.when(F.contains(r["text"], F.lit("\na/")), strip(r["text"]))
        .when(r["odd"], F.lit(K.PATCH_ERRORS["odd"]))
        .when(r["empty"], F.lit(K.PATCH_ERRORS["empty"]))
        .otherwise(F.lit(K.PATCH_ERRORS["fail"]))))
