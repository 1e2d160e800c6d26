"""Hash functions whose values other systems can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixtrace.functions.text import as_col


def md5_mod(key: Column | str, n: int) -> Column:
    """The whole 128-bit md5 value modulo ``n``, taken 32 bits at a time."""
    if not 0 < n < 2 ** 31:
        raise ValueError("n must be between 1 and 2**31 - 1")
    digest = F.md5(as_col(key).cast("string"))
    rest = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(2 ** 32 % n) + word, F.lit(n))
    return rest


def hash_shard(key: Column | str, n: int) -> Column:
    """Shard that owns a key."""
    return md5_mod(key, n)


def round_robin_shard(position: Column | str, n: int) -> Column:
    """Shard of a numbered row."""
    return F.pmod(as_col(position), F.lit(n))


def shuffle_key(seed: int, *ids: Column | str) -> Column:
    """Pseudo-random order of rows that is the same on every run: md5 of seed and ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(i).cast("string") for i in ids]))
