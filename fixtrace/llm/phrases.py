"""Phrases that stand together, counted over a prefix-free parse (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace.llm.shingles import BYTE_VALUES, PLACE_FACTORS, STEP, mix
from fixtrace.operators.ordering import join_small, top_k
from fixtrace.session import run_folder, staged

#: Longest phrase, in words; neighbouring chunks share one word less.
LONGEST = 4
#: A word opens a new chunk if its hash divides by this, and a chunk without such a word ends after CHUNK_WORDS.
TRIGGER = 16
CHUNK_WORDS = 4096
#: Bytes of text that are cut into words at once, and bytes of chunks that are counted together.
PIECE_BYTES = 1 << 19
GROUP_BYTES = 1 << 21
#: Bits of the filter over frequent keys, by which passes leave out what cannot be frequent: 16 a key up to this many.
FILTER_BITS = 1 << 27

_GAP, _BREAK, _INSIDE = 1, 2, 0
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_SPACE, _LINE = 0x20, 0x0A


def _word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and whether a break stands before, of the words of a text."""
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kind == _INSIDE, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    breaks = np.flatnonzero(kind == _BREAK)
    number = np.searchsorted(breaks, starts)
    return starts, ends, np.diff(number, prepend=-1) > 0


def normalised(text: bytes) -> bytes:
    """A-Z lower-cased, words apart by one space, pieces by one line end, nothing at the ends."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    starts, ends, breaks = _word_places(raw)
    if not len(starts):
        return b""
    kept = _KIND[raw] == _INSIDE
    after = ends[:-1]
    marked = raw.copy()
    marked[after] = np.where(breaks[1:], _LINE, _SPACE)
    kept[after] = True
    return marked[kept].tobytes()


def _normalised_parts(text: bytes) -> bytes:
    """The same for a text of any length, cut at gaps."""
    if len(text) <= PIECE_BYTES:
        return normalised(text)
    parts, at, joint = [], 0, b""
    while at < len(text):
        end = min(len(text), at + PIECE_BYTES)
        while end < len(text) and _KIND[text[end]] == _INSIDE:
            end += 1
        while end < len(text) and _KIND[text[end]] != _INSIDE:  # a cut before a word: its breaks are all seen
            end += 1
        part = normalised(text[at:end])
        if part:
            parts += [joint, part] if parts else [part]
            joint = b""
        tail = text[at:end]
        cut = len(tail.rstrip(b" \t.,;:!?\n\v\f\r"))
        joint = b"\n" if joint == b"\n" or any(c in b".,;:!?\n\v\f\r" for c in tail[cut:]) else b" "
        at = end
    return b"".join(parts)


def _hashes(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One hash for each word, from its bytes; ``inside`` are the places of the bytes of all words."""
    place = inside - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), STEP, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[raw[inside]] * powers[place])])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + lengths.astype(np.uint64))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and breaks before, of the words of a normalised text."""
    apart = (raw == _SPACE) | (raw == _LINE)
    gaps = np.flatnonzero(apart)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    hashes = _hashes(raw, np.flatnonzero(~apart), starts, ends - starts)
    return starts, ends, hashes, np.concatenate([[True], raw[gaps] == _LINE])


class Words:
    """Words of a normalised text: places, hashes and whether a break stands before each.

    Bytes are hashed piece by piece, so arrays with an entry per byte stay small.
    """

    def __init__(self, text: bytes):
        self.raw = np.frombuffer(text, dtype=np.uint8)
        found, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE_BYTES)
            while end < len(text) and text[end] not in b" \n":
                end += 1
            starts, ends, hashes, breaks = _hashed(self.raw[at:end])
            breaks[0] = at == 0 or text[at - 1] == _LINE
            found.append((starts + at, ends + at, hashes, breaks))
            at = end + 1
        self.starts, self.ends, self.hashes, self.breaks = (np.concatenate(c) for c in zip(*found))


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Places at which chunks begin: 0, each word that triggers, and every CHUNK_WORDS words without one."""
    marks = np.flatnonzero(hashes % np.uint64(TRIGGER) == 0)
    marks = np.unique(np.concatenate([[0], marks]))
    gaps = np.diff(np.append(marks, len(hashes)))
    if gaps.max(initial=0) > CHUNK_WORDS:
        marks = np.concatenate([np.arange(m, m + g, CHUNK_WORDS) for m, g in zip(marks, gaps)])
    return marks


def _chunks(text: bytes) -> tuple[list[bytes], list[int]]:
    """The chunks of a text and how many of the words of each are its own; the others begin the next chunk."""
    whole = _normalised_parts(text)
    if not whole:
        return [], []
    words = Words(whole)
    marks = _cuts(words.hashes)
    last = np.append(marks[1:], len(words.hashes))
    begin = words.starts[marks].tolist()
    end = words.ends[np.minimum(last + LONGEST - 2, len(words.hashes) - 1)].tolist()
    return [whole[b:e] for b, e in zip(begin, end)], (last - marks).tolist()


def _chunks_of_many(texts: list[bytes]) -> tuple[list[int], list[bytes], list[int]]:
    """The same for several texts at once: the number of the text of each chunk, the chunks, their own words."""
    joined = b"\n".join(texts).lower()
    raw = np.frombuffer(joined, dtype=np.uint8)
    starts, ends, breaks = _word_places(raw)
    if not len(starts):
        return [], [], []
    kept = _KIND[raw] == _INSIDE
    lengths = ends - starts
    hashes = _hashes(raw, np.flatnonzero(kept), starts, lengths)
    marked = np.append(raw, np.uint8(_SPACE))
    marked[ends] = np.append(np.where(breaks[1:], _LINE, _SPACE), _SPACE)
    kept = np.append(kept, False)
    kept[ends] = True
    whole = marked[kept].tobytes()  # each word and what follows it
    starts = np.cumsum(lengths + 1) - lengths - 1
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text = np.searchsorted(np.cumsum(sizes), ends, "left")
    opens = np.concatenate([[True], text[1:] != text[:-1]])  # first words of texts
    marks = np.flatnonzero(opens | (hashes % np.uint64(TRIGGER) == 0))
    gaps = np.diff(np.append(marks, len(hashes)))
    if gaps.max() > CHUNK_WORDS:
        marks = np.concatenate([np.arange(m, m + g, CHUNK_WORDS) for m, g in zip(marks, gaps)])
    last = np.append(marks[1:], len(hashes))
    stops = np.append(np.flatnonzero(opens)[1:], len(hashes))[np.cumsum(opens) - 1]  # behind the last word of the text
    tail = np.minimum(last + LONGEST - 1, stops[marks]) - 1
    chunks = [whole[b:e] for b, e in zip(starts[marks].tolist(), (starts[tail] + lengths[tail]).tolist())]
    return text[marks].tolist(), chunks, (last - marks).tolist()


def _parser():
    """Task function: (lang, text) to (lang, chunk, own)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, held = [], [], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) > PIECE_BYTES:
                    chunks, owns = _chunks(raw)
                    for at in range(0, len(chunks), CHUNK_WORDS):
                        yield _chunk_batch([lang] * len(chunks[at:at + CHUNK_WORDS]), chunks[at:at + CHUNK_WORDS], owns[at:at + CHUNK_WORDS])
                    continue
                langs.append(lang)
                texts.append(raw)
                held += len(raw)
                if held > PIECE_BYTES:
                    yield _parsed(langs, texts)
                    langs, texts, held = [], [], 0
            yield _parsed(langs, texts)

    return run


def _parsed(langs: list[str], texts: list[bytes]) -> pa.RecordBatch:
    text, chunks, owns = _chunks_of_many(texts)
    return _chunk_batch([langs[k] for k in text], chunks, owns)


def _chunk_batch(langs, chunks, owns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(owns, pa.int32())],
                                      names=["lang", "chunk", "own"])


class Grams:
    """The word sequences that begin at the own words of a group of chunks."""

    def __init__(self, langs: list[str], raws: list[bytes], owns: np.ndarray, times: np.ndarray):
        self.words = words = Words(b"\n".join(raws))
        sizes = np.fromiter((len(r) for r in raws), np.int64, len(raws)) + 1
        first = np.searchsorted(words.starts, np.cumsum(sizes) - sizes)  # the first word of each chunk
        count = np.diff(np.append(first, len(words.starts)))
        within = np.arange(len(words.starts)) - np.repeat(first, count)
        self.own = within < np.repeat(owns, count)
        self.times = np.repeat(times, count)
        names = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        self.names = list(names)
        self.lang = np.repeat(np.fromiter((names[lang] for lang in langs), np.int64, len(langs)), count)
        marks = np.array([np.frombuffer(_digest(n), dtype=np.uint64)[0] for n in self.names], dtype=np.uint64)
        self.seed = marks[self.lang]
        self.piece = np.cumsum(words.breaks)
        self.numbers, self.distinct = None, 0

    def number_words(self) -> None:
        """Give equal words equal numbers, by their bytes."""
        ends = np.append(self.words.starts, len(self.words.raw) + 1)
        spaced = np.append(self.words.raw, np.uint8(_SPACE))
        spaced[spaced == _LINE] = _SPACE
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.words.starts), [None, pa.py_buffer(ends), pa.py_buffer(spaced)])
        coded = words.dictionary_encode()
        self.numbers, self.distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)

    def places(self, size: int) -> np.ndarray:
        """First words of the sequences of ``size`` words."""
        if len(self.own) < size:
            return np.empty(0, dtype=np.int64)
        stop = len(self.own) - size + 1
        return np.flatnonzero(self.own[:stop] & (self.piece[:stop] == self.piece[size - 1:]))

    def keys(self, size: int, places: np.ndarray) -> np.ndarray:
        """One 64-bit key for each sequence, with its language."""
        total = self.seed[places] + np.uint64(size)
        for k in range(size):
            total = total + self.words.hashes[places + k] * PLACE_FACTORS[k]
        return mix(total)


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """Groups of about GROUP_BYTES from batches (lang, chunk, own, times), larger by one chunk at most."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            end = min(batch.num_rows, int(np.searchsorted(sizes, done + GROUP_BYTES - size)) + 1)
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1]) - done
            at = end
            if size >= GROUP_BYTES:
                yield _grams(held)
                held, size = [], 0
    if held:
        yield _grams(held)


def _grams(parts: list[pa.RecordBatch]) -> Grams:
    table = pa.Table.from_batches(parts)
    return Grams(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_numpy(), table.column(3).to_numpy())


class KeyFilter:
    """A bit for each frequent key: never misses one, and lets others pass rarely while it is not full."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(self.bits - 1)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _key_filter(keys: DataFrame) -> KeyFilter:
    """Filter over a table of keys; at most FILTER_BITS bits, 16 MB, whatever the number of keys."""
    bits = 1 << 10
    rows = keys.count()
    while bits < FILTER_BITS and bits < 16 * rows:
        bits *= 2
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    packed = (keys.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((key & {bits - 1}) & 63 AS int))").alias("bit"))
              .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return KeyFilter(bits, words)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def _key_counter(sizes: tuple[int, ...], frequent=None):
    """Task function: chunks to (key, times) of their sequences; of those only whose pairs of words are ``frequent``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _groups(batches):
            pairs = _frequent_pairs(grams, frequent) if frequent is not None else None
            for size in sizes:
                places = grams.places(size)
                if pairs is not None:
                    places = _all_frequent(pairs, places, size)
                if len(places):
                    keys, times = _summed(grams.keys(size, places), grams.times[places])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "times"])

    return run


def _frequent_pairs(grams: Grams, frequent) -> np.ndarray:
    """Whether a word and the next one are a frequent pair; words that a chunk shares with the next count as well."""
    count = len(grams.own)
    found = np.zeros(count, dtype=bool)
    if count > 1:
        places = np.flatnonzero(grams.piece[:-1] == grams.piece[1:])
        found[places] = frequent.value.has(grams.keys(2, places))
    return found


def _all_frequent(pairs: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    kept = pairs[places]
    for k in range(1, size - 1):
        kept &= pairs[places + k]
    return places[kept]


def _merged(grams: Grams, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different sequence and the sum of its occurrences; words are told apart by their numbers."""
    total, bound = grams.lang[places], len(grams.names)
    for k in range(size):
        if bound * grams.distinct >= 1 << 62:  # number what there is so far anew
            total = np.unique(total, return_inverse=True)[1]
            bound = len(total)
        total = total * grams.distinct + grams.numbers[places + k]
        bound *= grams.distinct
    order = np.argsort(total)
    total = total[order]
    first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
    return places[order[first]], np.add.reduceat(grams.times[places[order]], first)


def _phrase_counter(pairs_known, frequent):
    """Task function: chunks to (lang, phrase, size, times) of the sequences whose keys are frequent, by their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _groups(batches):
            pairs = _frequent_pairs(grams, pairs_known)
            grams.number_words()
            for size in range(1, LONGEST + 1):
                places = grams.places(size)
                if size > 1:
                    places = _all_frequent(pairs, places, size)
                places = places[frequent.value.has(grams.keys(size, places))]
                if not len(places):
                    continue
                first, times = _merged(grams, places, size)
                starts, ends = grams.words.starts[first], grams.words.ends[first + size - 1]
                lengths = ends - starts
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                source = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first),
                                                         [None, pa.py_buffer(bounds), pa.py_buffer(grams.words.raw[source])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.names, pa.string()).take(pa.array(grams.lang[first])), texts.cast(pa.binary()),
                     pa.array(np.full(len(first), size, dtype=np.int32)), pa.array(times)], names=["lang", "phrase", "size", "times"])

    return run


def phrase_counts(docs: DataFrame, folder: str, least: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sequences of up to four words that occur ``least`` times: (lang, phrase, size, f), and words per language (lang, n).

    Prefix-free parsing: a word whose hash divides by 16 opens a chunk, which reaches three words into the next one. So cuts
    follow the content, and passages that texts share fall into the same chunks. Distinct chunks with the number
    of their occurrences are the dictionary; its sequences are counted with that weight, each by the chunk in which
    its first word is not shared, so none is lost or counted twice.

    The dictionary is counted in three passes. Keys of words and pairs are summed first, then keys of sequences whose pairs are
    all frequent; sums over keys can only be too high, so what they rule out is not frequent. What is left is counted by
    its text. Filters of frequent keys take up to 16 MB; fuller ones only rule out less.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parsed = given.mapInArrow(_parser(), "lang string, chunk binary, own int")
    parse = staged(parsed.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times")), folder, "dictionary")
    words = parse.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))

    def frequent(rows: DataFrame, name: str) -> DataFrame:
        return staged(rows.groupBy("key").agg(F.sum("times").alias("f")).filter(F.col("f") >= least).select("key"), folder, name)

    keyed = "key bigint, times bigint"
    few = frequent(parse.mapInArrow(_key_counter((1, 2)), keyed), "keys_1_2")
    pairs = spark.sparkContext.broadcast(_key_filter(few))
    more = frequent(parse.mapInArrow(_key_counter((3, 4), pairs), keyed), "keys_3_4")
    known = spark.sparkContext.broadcast(_key_filter(few.union(more)))
    found = parse.mapInArrow(_phrase_counter(pairs, known), "lang string, phrase binary, size int, times bigint")
    counts = (found.groupBy("lang", "phrase", "size").agg(F.sum("times").alias("f")).filter(F.col("f") >= least)
              .withColumn("phrase", F.col("phrase").cast("string")))
    return staged(counts, folder, "counts"), words


def _exact(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, covered: int = 80, first: int = 2000) -> DataFrame:
    """The strongest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at spaces and tabs.
    Phrases are sequences of 2 to 4 words within a piece with a = ``least`` occurrences or more. A cut after the first
    k words has l and r occurrences of its parts and scores floor(2000000 * a / (l + r)); the lowest score counts, of equal
    ones the smallest k. A phrase inside a longer one that has ``covered`` percent of its occurrences is dropped,
    whether or not the longer one is. The ``first`` of each language are ranked by score, occurrences and text.

    Counts cover all texts, and are exact in 64 bits; products have 38 digits. A null text counts as empty, a null
    language as ``und``; rows that repeat count each; an empty table gives an empty result. Other columns are not
    read. Hot words and languages are salted in joins and cut before the last sort. No table is broadcast, as all grow with the
    texts; tasks get the filters only.
    """
    folder = run_folder(docs.sparkSession, "phrases")
    counts, words = phrase_counts(docs, folder, least, lang, text)
    phrases = counts.filter("size > 1").withColumn("parts", F.split("phrase", " "))

    def run_of(start, length):
        return F.array_join(F.slice("parts", start, length), " ")

    cuts = phrases.select("lang", "phrase", "f", "size", "parts", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", run_of(F.lit(1), F.col("k")).alias("head"), run_of(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    # Spark sizes tables by their files and sees neither the repeats of a join nor the rows of an explode, so these joins are told to merge.
    sizes = counts.select("lang", "phrase", "f").hint("merge")
    cuts = join_small(cuts, sizes.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"], spread_by=["phrase", "k"])
    cuts = join_small(cuts, sizes.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"], spread_by=["phrase", "k"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("f").alias("a"))).alias("cut"))
              .select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"))

    longer = phrases.filter("size > 2").select(
        "lang", "f", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda at: F.array_join(F.slice("parts", at, s), " "))))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = (scored.join(inside.hint("merge"), ["lang", "phrase"], "left")
            .filter(F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * covered)).drop("most"))
    best = top_k(left, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], first)
    return best.join(staged(words, folder, "words").hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
