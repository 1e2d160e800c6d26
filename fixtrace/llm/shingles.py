"""Word shingles of whole texts as 64-bit hashes, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Bytes of text whose per-byte arrays are held at once.
PIECE_BYTES = 1 << 19

_SEEDS = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _SEEDS.integers(1, 2 ** 64, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE_FACTORS = _SEEDS.integers(1, 2 ** 64, 64, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two rounds of multiply and shift)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def _hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = ~IS_SPACE[raw]
    before = np.empty(len(raw), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(before & ~inside)
    if len(ends) < len(starts):
        ends = np.append(ends, len(raw))
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), STEP, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[raw[at]] * powers[place])])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + lengths.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word: runs of bytes other than space and the controls 9 to 13, A-Z in lower case."""
    text = text.lower()  # of bytes: the 26 Latin letters only
    if len(text) <= PIECE_BYTES:
        return _hashes(text) if text else np.empty(0, dtype=np.uint64)
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE_BYTES)
        while end < len(text) and not IS_SPACE[text[end]]:
            end += 1
        found.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words together, if there are fewer."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(width, len(words))
    count = len(words) - size + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        total += words[k:k + count] * PLACE_FACTORS[k]
    return np.unique(mix(total + np.uint64(size)))
