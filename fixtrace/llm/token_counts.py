"""Token counts by rank-synchronous merging in ragged arrays (operator 5)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose counts a worker remembers, and pre-tokens whose symbols are merged together.
REMEMBERED = 200_000
TOGETHER = 1 << 15

#: White space of Unicode. Fixed values.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on, in their order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeTable:
    """Merges of a byte-level BPE with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(merges)
        self.by_rank = made
        self.specials = [t["content"] for t in described.get("added_tokens", ())]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for pairs that do not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each word (bytes, at least one) is merged into.

        All words are one ragged array. In each round every word merges its pair of lowest rank wherever it
        occurs, from the left; a word without such a pair leaves the array.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        result = lengths.copy()
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        pairs = np.full(len(symbols), self.none, dtype=np.int64)  # rank of a symbol with the next one of its word
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        pairs[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            low = np.minimum.reduceat(pairs, starts)
            result[owner[starts]] = sizes
            going = low < self.none
            if not going.all():
                keep = np.repeat(going, sizes)
                symbols, owner, pairs = symbols[keep], owner[keep], pairs[keep]
                sizes, low = sizes[going], low[going]
                if not len(symbols):
                    break
            merge = pairs == np.repeat(low, sizes)
            # Of overlapping places of one pair, as in "aaa", take every second from the left.
            run = merge & np.r_[False, merge[:-1]]
            if run.any():
                at = np.flatnonzero(merge)
                first = np.r_[True, np.diff(at) > 1]
                begin = at[first][np.cumsum(first) - 1]
                merge[at[(at - begin) % 2 == 1]] = False
            at = np.flatnonzero(merge)
            symbols[at] = self.by_rank[pairs[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            moved = at - np.arange(len(at))  # where the merged symbols are now
            pairs = pairs[keep]
            changed = np.unique(np.r_[moved, moved[moved > 0] - 1])
            next_ = np.minimum(changed + 1, len(symbols) - 1)
            same = (changed + 1 < len(symbols)) & (owner[changed] == owner[next_])
            pairs[changed] = np.where(same, self.rank(symbols[changed], symbols[next_]), self.none)
        return result


class WordCounter:
    """Tokens of texts: special strings, normalisation, pre-tokens, and the merges of each pre-token."""

    def __init__(self, path: str):
        self.path, self.table = path, None

    def __getstate__(self):  # tables are read where they are used
        return {"path": self.path, "table": None}

    def _open(self):
        import regex

        self.table = MergeTable(self.path)
        self.known: dict[str, int] = {}
        self.space = regex.compile(f"[{_SPACE}]+")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        specials = sorted(self.table.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return self.words.findall(text.lower())

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special string counts as one token, a null text as empty."""
        if self.table is None:
            self._open()
        totals, waiting, held = [], [], 0
        for text in texts:
            count, words = 0, []
            if text:
                if self.special is not None and self.special.search(text):
                    count = len(self.special.findall(text))
                    for part in self.special.split(text):
                        words += self._words(part)
                else:
                    words = self._words(text)
            waiting.append((count, words))
            held += len(words)
            if held >= 1 << 18:
                totals += self._resolve(waiting)
                waiting, held = [], 0
        return totals + self._resolve(waiting)

    def _resolve(self, waiting: list[tuple[int, list[str]]]) -> list[int]:
        known = self.known
        new = sorted(set().union(*(w for _, w in waiting)).difference(known)) if waiting else []
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(set().union(*(w for _, w in waiting)))
        for at in range(0, len(new), TOGETHER):
            part = new[at:at + TOGETHER]
            known.update(zip(part, self.table.counts([w.encode("utf-8", "replace") for w in part]).tolist()))
        return [count + sum(map(known.__getitem__, words)) for count, words in waiting]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the number of tokens of the whole text, without begin and end tokens.

    ``tokenizer`` is the path of a byte-level BPE with word ends in the JSON form of the tokenizers library, whose
    text is normalised by NFC and lower case; it has to be readable on all machines. A null text counts as empty and
    has no tokens. Special strings inside a text are one token each. Rows are independent, so ties, repeats and an
    empty table need no rule. A column already named ``name`` is replaced.
    """
    counter = WordCounter(tokenizer)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter.counts([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    return docs.withColumn(name, count(F.col(text)))
