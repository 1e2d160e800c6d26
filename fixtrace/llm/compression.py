"""Compressed sizes of texts under zstandard dictionaries of raw content."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excerpts(sample: DataFrame, label: str, per_text: int) -> DataFrame:
    """(value, excerpt) from the middle of each sampled text, for dictionaries."""
    start = F.greatest(F.lit(1), F.floor((F.length("text") - per_text) / 2) + 1).cast("int")
    return sample.select(F.col(label).alias("value"), "doc_id",
                         F.substring(F.col("text"), start, F.lit(per_text)).alias("excerpt"))


def dictionary(parts: Iterable[str], size: int) -> bytes:
    """Texts one after the other, up to ``size`` bytes; a text that was taken is not taken again."""
    seen, content, held = set(), [], 0
    for part in parts:
        raw = part.encode("utf-8", "surrogatepass")
        mark = zlib.crc32(raw)
        if mark in seen or not raw:
            continue
        seen.add(mark)
        content.append(raw)
        held += len(raw) + 1
        if held >= size:
            break
    return b"\n".join(content)[:size]


class SizeMeter:
    """Bytes that a text takes with each of several dictionaries, compressed in pieces of ``piece`` bytes.

    Within a piece the dictionary counts for more than what the text itself repeats. ``piece`` 0 means the
    whole text at once.
    """

    def __init__(self, contents: list[bytes], level: int, piece: int, **settings):
        self.piece, self.coders = piece, []
        how = zstandard.ZstdCompressionParameters.from_level(
            level, write_content_size=False, write_checksum=False, write_dict_id=False, **settings)
        for content in contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        self.empty = [len(c.compress(b"")) for c in self.coders]

    def sizes(self, raw: bytes) -> np.ndarray:
        step = self.piece or max(1, len(raw))
        totals = np.zeros(len(self.coders))
        for at in range(0, len(raw), step):
            part = raw[at:at + step]
            for k, coder in enumerate(self.coders):
                totals[k] += len(coder.compress(part)) - self.empty[k]
        return totals
