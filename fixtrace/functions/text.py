"""Column functions over messages, URLs, model answers and other short texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtrace import constants as K
from fixtrace.operators.ordering import running_values
from fixtrace.session import reliable

WHITESPACE = " \t\n\r\x0b\x0c"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    An expression used inside a lambda is computed again for every element; a bound one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per element. A plain ``explode`` would compute the array a second time to drop empty ones."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def strip(text: Column | str) -> Column:
    """Trim ASCII white space on both sides (plain ``trim`` only takes blanks)."""
    return F.btrim(as_col(text), F.lit(WHITESPACE))


def lines_of(text: Column | str) -> Column:
    r"""Lines of a text: split on ``\n`` or ``\r\n``, a final line end adds no empty line."""
    return F.split(F.regexp_replace(as_col(text), r"\r?\n\z", ""), r"\r?\n")


def none_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- ids and links --------------------------------------------------------------


def find_cve_ids(text: Column | str) -> Column:
    """All CVE ids in the text, in order of appearance."""
    return F.regexp_extract_all(as_col(text), F.lit(K.CVE_ID), F.lit(0))


def commit_hash(text: Column | str) -> Column:
    """First 40-digit hexadecimal word, or null."""
    return none_if_blank(F.regexp_extract(as_col(text), K.COMMIT_HASH, 0))


def github_repo(url: Column | str) -> Column:
    """Struct (owner, name) of the first repository link in the text, or null."""
    owner = F.regexp_extract(as_col(url), K.GITHUB_REPO, 1)
    name = F.regexp_extract(as_col(url), K.GITHUB_REPO, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), name.alias("name")))


def commit_url(repo: Column | str, commit_id: Column | str, prefix: str = "") -> Column:
    """``owner/name/commit/id``, or the web address with ``prefix='https://github.com/'``."""
    return F.concat(F.lit(prefix), as_col(repo), F.lit("/commit/"), as_col(commit_id))


def commit_link(url: Column | str) -> Column:
    """Struct (api_url, owner, repo, commit_id) of a commit's web address.

    Every ``commit`` in the address turns into ``commits``, also inside a repository name.
    """
    api = F.replace(
        F.replace(as_col(url), F.lit("github.com"), F.lit("api.github.com/repos")),
        F.lit("commit"), F.lit("commits"),
    )
    parts = F.split(F.try_parse_url(api, F.lit("PATH")), "/")
    return F.struct(
        api.alias("api_url"),
        F.get(parts, F.lit(2)).alias("owner"),
        F.get(parts, F.lit(3)).alias("repo"),
        F.get(parts, F.lit(5)).alias("commit_id"),
    )


def clone_url(url: Column | str) -> Column:
    """Clone address for a commit link (web or ssh form); null if it is no commit link."""
    path = F.regexp_extract(as_col(url), K.CLONE_PATH, 1)
    return F.when(path != "", F.concat(F.lit("https://github.com/"), path, F.lit(".git")))


def parent_raw_url(raw_url: Column | str, parent_id: Column | str) -> Column:
    """Raw-file address with its commit id (seventh part) swapped for the parent's."""
    url = as_col(raw_url)
    return F.replace(url, F.get(F.split(url, "/"), F.lit(6)), as_col(parent_id))


def issue_ref(message: Column | str, owner: Column | str, repo: Column | str) -> Column:
    """Struct (number, issue_url, pull_url) for the first ``#<digits>``, or null."""
    number = none_if_blank(F.regexp_extract(as_col(message), K.ISSUE_NUMBER, 1))
    base = F.concat_ws("/", F.lit("https://api.github.com/repos"), as_col(owner), as_col(repo))
    return F.when(
        number.isNotNull(),
        F.struct(
            number.alias("number"),
            F.concat_ws("/", base, F.lit("issues"), number).alias("issue_url"),
            F.concat_ws("/", base, F.lit("pulls"), number).alias("pull_url"),
        ),
    )


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def extension_of(path: Column | str) -> Column:
    """Text after the last dot of the base name; '' for none and for dot files."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?\.([^.]*)$", 1)


def language_of(path: Column | str) -> Column:
    """Language by file extension, or null."""
    pairs = [F.lit(x) for item in K.EXTENSION_LANGUAGE.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(extension_of(path)))


# --- joining, cutting and cleaning ----------------------------------------------


def tokenize(text: Column | str) -> Column:
    """Words and single punctuation marks, joined by blanks."""
    words = F.regexp_extract_all(as_col(text), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    return F.array_join(words, " ")


def combined_text(message: Column | str, diff: Column | str, nulls: str = "fill") -> Column:
    """``message + ' ' + diff``. A null part counts as '' (``fill``) or blanks the pair (``blank``)."""
    message, diff = as_col(message), as_col(diff)
    if nulls == "fill":
        return F.concat(F.coalesce(message, F.lit("")), F.lit(" "), F.coalesce(diff, F.lit("")))
    if nulls == "blank":
        return F.coalesce(F.concat(message, F.lit(" "), diff), F.lit(""))
    raise ValueError(f"nulls must be 'fill' or 'blank', not {nulls!r}")


def head_lines(text: Column | str, n: int) -> Column:
    """The first ``n`` lines (part of the data preparation, not a safety cut)."""
    return F.array_join(F.slice(F.split(as_col(text), "\n"), 1, n), "\n")


def nonblank_lines(code: Column | str, sep: str) -> Column:
    """Array of the non-blank lines, each with ``sep`` in front."""
    kept = F.filter(F.split(as_col(code), "\n"), lambda line: strip(line) != "")
    return F.transform(kept, lambda line: F.concat(F.lit(sep), line))


def pad_tokens(tokens: Column | str, n: int, pad) -> Column:
    """Struct (tokens, mask), both of length ``n``: longer input is cut, shorter is padded."""
    tokens = as_col(tokens)
    used = F.least(F.size(tokens), F.lit(n))
    return F.struct(
        F.concat(F.slice(tokens, 1, n), F.array_repeat(F.lit(pad), n - used)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), n - used)).alias("mask"),
    )


def repair_utf8(raw: Column | str, errors: str = "replace") -> Column:
    """Text of a binary column: undecodable bytes are replaced (U+FFFD) or, with ``ignore``, dropped."""
    text = F.make_valid_utf8(as_col(raw).cast("string"))
    if errors == "replace":
        return text
    if errors == "ignore":
        return F.replace(text, F.lit("�"), F.lit(""))
    raise ValueError(f"errors must be 'replace' or 'ignore', not {errors!r}")


def commit_header(author: Column | str, date: Column | str, message: Column | str) -> Column:
    return F.concat(
        F.lit("Author: "), as_col(author), F.lit("\nDate: "), as_col(date),
        F.lit("\n\n"), as_col(message),
    )


def render_file_header(
    old_path: Column | str, new_path: Column | str, parent_id: Column | str, commit_id: Column | str,
    old_mode: Column | str, new_mode: Column | str, body: Column | str, change: Column | str,
) -> Column:
    """One file section of a diff; ``change`` is 'new', 'deleted', 'renamed' or anything else.

    A commit without parent (null ``parent_id``) gives the fixed root-commit sentence.
    """
    new, parent, commit = as_col(new_path), as_col(parent_id), as_col(commit_id)
    change = as_col(change)
    head = F.concat(
        F.lit("diff --git a/"), new, F.lit(" b/"), new,
        F.lit("\nindex "), F.left(parent, F.lit(7)), F.lit(".."), F.left(commit, F.lit(7)),
        F.lit(" "), as_col(new_mode),
        F.lit("\n--- a/"), new, F.lit("\n+++ b/"), new,
    )
    note = (
        F.when(change == "new", F.concat(F.lit("new file mode "), as_col(new_mode)))
        .when(change == "deleted", F.concat(F.lit("deleted file mode "), as_col(old_mode)))
        .when(change == "renamed",
              F.concat(F.lit("rename from "), as_col(old_path), F.lit("\nrename to "), new))
    )
    before, after = K.ROOT_COMMIT.split("%s")
    return F.when(parent.isNull(), F.concat(F.lit(before), commit, F.lit(after))).otherwise(
        F.concat_ws("\n", head, as_col(body), note)
    )


# --- answers ----------------------------------------------------------------------


def asbool(df: DataFrame, name: str) -> Column:
    """Truth of a boolean-like column: booleans as they are, words true / 1 / yes, the integer 1."""
    column, kind = F.col(name), df.select(name).schema[0].dataType
    if isinstance(kind, T.BooleanType):
        truth = column
    elif isinstance(kind, T.StringType):
        truth = F.lower(column).isin(K.TRUE_WORDS)
    elif isinstance(kind, T.IntegralType):
        truth = column == 1
    else:
        truth = F.lit(False)
    return F.coalesce(truth, F.lit(False))


def answer_contains_true(text: Column | str) -> Column:
    return F.contains(F.lower(as_col(text)), F.lit("true"))


def estimate_tokens(text: Column | str) -> Column:
    return F.length(as_col(text)) * F.lit(K.TOKENS_PER_CHAR)


def fit_budget(parts: list[Column | str], context: Column | str, budget: int) -> Column:
    """The context text, blanked when all parts with it are not below the token budget."""
    total = estimate_tokens(context)
    for part in parts:
        total = total + estimate_tokens(part)
    return F.when(total < budget, as_col(context)).otherwise(F.lit(""))


def running_budget(files: DataFrame, commit: str, order: str, patch: str, context: str, budget: int) -> DataFrame:
    """Adds tokens_so_far and kept_context: the contexts of a commit's files in order, while there is budget.

    The tokens of patches and contexts add up over the files of a commit; a file at which the sum reaches the budget, and
    all after it, get an empty context. Null texts count as empty. Files without a commit are those of one commit; a null
    place comes first, and files at the same place follow each other by their texts. Every row comes back once.

    Rows get a number that is written down. Only keys and counts are sorted, a commit of any size in slices; the
    texts are joined back by the number.
    """
    tokens = estimate_tokens(F.coalesce(F.col(patch), F.lit(""))) + estimate_tokens(F.coalesce(F.col(context), F.lit("")))
    numbered = reliable(files.withColumn("_file", F.monotonically_increasing_id()))
    counted = numbered.select("_file", F.col(commit).alias("_commit"), F.col(order).alias("_order"), tokens.alias("_tokens"),
                              F.xxhash64(patch, context).alias("_texts"))
    ahead = running_values(counted, ["_commit"], [F.col("_order").asc_nulls_first(), F.col("_texts"), F.col("_file")],
                           {"_ahead": ("sum", F.col("_tokens"))})
    sums = ahead.select("_file", (F.coalesce("_ahead", F.lit(0.0)) + F.col("_tokens")).alias("tokens_so_far"))
    kept = F.when(F.col("tokens_so_far") < budget, F.coalesce(F.col(context), F.lit(""))).otherwise(F.lit(""))
    return numbered.join(sums, "_file").withColumn("kept_context", kept).drop("_file")


def _one_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else; parsers stop after the first value."""
    length = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce((length == 1) & F.try_parse_json(text).isNotNull(), F.lit(False))


def json_in_text(text: Column | str, schema: str) -> Column:
    """Struct (value, error): the text from the first ``{`` to the last ``}`` read as ``schema``."""
    found = F.regexp_extract(as_col(text), K.JSON_OBJECT, 1)
    valid = _one_json(found)
    return F.struct(
        F.when(valid, F.from_json(found, schema)).alias("value"),
        F.when(found == "", F.lit(K.NO_JSON)).when(~valid, F.lit(K.BAD_JSON)).alias("error"),
    )


def validate_verdict(record: Column | str) -> Column:
    """Struct (answer, confidence, explanation, error) of a verdict given as JSON text.

    The answer has to be a boolean (0 and 1 count as one), the confidence an integer from 1 to 5 (true counts as
    1), the explanation a non-empty string. The first broken rule gives the error. A bad confidence turns null.
    """
    value = F.when(_one_json(as_col(record)), F.try_parse_json(as_col(record)))

    def kind(path):
        return F.schema_of_variant(F.variant_get(value, path, "variant"))

    def get(path, dtype):
        return F.try_variant_get(value, path, dtype)

    number = get("$.answer", "double")
    answer = (
        F.when(kind("$.answer") == "BOOLEAN", get("$.answer", "boolean"))
        .when((kind("$.answer") != "STRING") & number.isin(0.0, 1.0), number == 1.0)
    )
    score = get("$.confidence", "bigint")
    confidence = (
        F.when((kind("$.confidence") == "BIGINT") & score.between(1, 5), score)
        .when((kind("$.confidence") == "BOOLEAN") & get("$.confidence", "boolean"), F.lit(1).cast("bigint"))
    )
    explanation = get("$.explanation", "string")
    worded = F.coalesce((kind("$.explanation") == "STRING") & (explanation != ""), F.lit(False))
    return F.struct(
        answer.alias("answer"),
        confidence.alias("confidence"),
        explanation.alias("explanation"),
        F.when(value.isNull(), F.lit(K.BAD_JSON))
        .when(answer.isNull(), F.lit(K.BAD_ANSWER))
        .when(confidence.isNull(), F.lit(K.BAD_CONFIDENCE))
        .when(~worded, F.lit(K.BAD_EXPLANATION))
        .alias("error"),
    )


# --- rendering --------------------------------------------------------------------


def hex_id(value: Column | str, digits: int) -> Column:
    """Lower-case hexadecimal digits, padded with zeros: 32 for traces, 16 for spans."""
    return F.lpad(F.lower(F.hex(as_col(value))), digits, "0")


def render_prompt(template: str, slots: dict[str, Column | str]) -> Column:
    """Fill ``{{ name }}`` slots. The template is cut up once on the driver into one ``concat``.

    A slot without a column is an error, as is a column without a slot.
    """
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    names = set(pieces[1::2])
    if names != set(slots):
        raise ValueError(f"template slots {sorted(names)} differ from columns {sorted(slots)}")
    return F.concat(*[
        F.coalesce(as_col(slots[piece]).cast("string"), F.lit("None")) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
    ])


def format_metric(value: Column | str) -> Column:
    """Two decimals, rounded by the exact binary value and half to even, unlike ``format_string``."""
    value = as_col(value).cast("double")

    def cents(x):
        # The factor splits a double into two halves whose products with 100 are exact.
        shifted = x * F.lit(134217729.0)
        high = shifted - (shifted - x)
        return F.struct((high * 100).alias("high"), ((x - high) * 100).alias("low"))

    def rounded(s):
        total = s["high"] + s["low"]
        below = F.floor(total)
        over = (total - below - 0.5) + ((s["high"] - total) + s["low"])
        return below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)

    number = let(let(F.abs(value), cents), rounded)
    sign = F.when((value < 0) & (number > 0), "-").otherwise("")
    return F.when(value.isNotNull(), F.concat(
        sign, F.format_string("%d.%02d", F.floor(number / 100), number % 100)))


def escape_markup(text: Column | str) -> Column:
    escaped = as_col(text)
    for mark in K.MARKUP_ESCAPES:
        escaped = F.replace(escaped, F.lit(mark), F.lit("\\" + mark))
    return escaped
