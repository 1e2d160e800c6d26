"""Mixing sources to target weights by a low-discrepancy schedule (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtrace.functions.hashing import shuffle_key
from fixtrace.session import run_folder, staged

#: Words in a block of one source, at most: a source is cut into blocks whose sizes differ by one word at most.
BLOCK_WORDS = 128
#: Blocks that make up the target of a source, at least, if it has so many words: those of small sources are shorter.
FEWEST_SLOTS = 50
#: Slots that are ranked together in one task, and documents of a source that are placed together in one.
STRETCH = 1 << 12
#: Sources up to which their parts of the ring, five rows each at most, are broadcast.
SMALL_SOURCES = 10_000
#: 2 to the 32 over the golden ratio, made odd: the step of the schedule. Fixed value.
GOLDEN_STEP = 2654435769
_RING = 1 << 32
_PLACES = 1 << 20


def word_count(text: Column | str) -> Column:
    """Runs of characters other than space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Words that the mix should take from each source: (source, source_size, target), one row per source.

    ``sizes`` has source and source_size, once each. Sources in order of code points, null last, get the
    weights in turn and share ``share`` times all words; none gets more than ``most`` times its own words, and what
    it would get beyond is shared again by weight. Sources fill up in the order of words per weight, so the
    level at which sharing ends follows from running sums over the table of sources, which holds one row each.
    """
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1  # strings compare by code points
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    given = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = given.select(
        "source", "source_size", "weight", "cap",
        (F.lit(float(share)) * F.sum("source_size").over(everything)
         - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"))
    # Before a source fills up, the level is what is left over the weights that are open; the first source whose cap
    # is above it, and all after it, take their weight times that level.
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("left") / F.col("open"), F.col("left") / F.col("open")))
    return (filled.withColumn("level", level.over(everything))
            .select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), "cap")).alias("target")))


def _blocks(block_words: int) -> Column:
    """Number of blocks of a source, from source_size and target."""
    fine = F.ceil(F.lit(float(FEWEST_SLOTS)) * F.col("source_size") / F.col("target")).cast("bigint")
    return F.greatest(F.ceil(F.col("source_size") / block_words).cast("bigint"), F.least("source_size", F.when(F.col("target") > 0, fine)))


def _times(a: Column, b: Column) -> Column:
    """Product of two numbers that may pass 64 bits."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def shuffled_blocks(docs: DataFrame, sizes: DataFrame, folder: str, block_words: int, seed: int) -> DataFrame:
    """Pieces of documents in equal blocks: (doc_id, source, size, block, words).

    ``docs`` has doc_id, source, size; ``sizes`` has source, source_size and target. The documents of a source stand in
    the order of the md5 of seed and id, one behind the other, and the line is cut into equal blocks; those that have
    a word more are spread evenly, so any run of blocks holds its share of words to a word. Starts
    come from sums per stretch of md5 values and then within a stretch, so no task sees a whole source. Empty
    documents have no piece.
    """
    order = shuffle_key(seed, "doc_id")
    counts = docs.filter("size > 0").groupBy("source").agg(F.count("*").alias("rows"))
    many = counts.select(F.col("source").alias("of"), F.ceil(F.col("rows") / STRETCH).alias("stretches"))
    placed = (docs.filter("size > 0").withColumn("order", order)
              .join(many, F.col("source").eqNullSafe(F.col("of"))).drop("of")
              .withColumn("stretch", F.floor(F.conv(F.substring("order", 1, 5), 16, 10).cast("bigint") * F.col("stretches") / _PLACES))
              .drop("stretches"))
    placed = staged(placed, folder, "placed")
    sums = placed.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    offsets = sums.select(F.col("source").alias("of"), F.col("stretch").alias("at"), (F.sum("words").over(
        W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("offset"))
    inner = W.partitionBy("source", "stretch").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    total = sizes.filter("source_size > 0").select(F.col("source").alias("for"), "source_size", _blocks(block_words).alias("blocks"))
    lines = (placed.withColumn("end", F.sum("size").over(inner))
             .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
             .join(total, F.col("source").eqNullSafe(F.col("for")))
             .select("doc_id", "source", "size", "source_size", "blocks", (F.col("end") - F.col("size") + F.col("offset")).alias("start"),
                     (F.col("end") + F.col("offset")).alias("end")))

    def block_of(word):
        """The last block that begins at the word or before it."""
        return F.call_function("div", _times(word + 1, F.col("blocks")) - 1, F.col("source_size").cast("decimal(19,0)"))

    def begin(block):
        return F.call_function("div", _times(block, F.col("source_size")), F.col("blocks").cast("decimal(19,0)"))

    return (lines.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("end") - 1))))
            .select("doc_id", "source", "size", "block",
                    (F.least(F.col("end"), begin(F.col("block") + 1))
                     - F.greatest(F.col("start"), begin(F.col("block")))).alias("words")))


def schedule(wanted: DataFrame, folder: str, block_words: int) -> DataFrame:
    """The slots of the mix in order: (slot, source, block), one block of a source each.

    ``wanted`` has source, source_size and target; a source needs as many slots as blocks make up its target, to
    the nearest. Slot i looks at the fraction of i over the golden ratio, whose values spread evenly whatever
    stretch of slots is taken, and gets the source in whose part of the cumulative needs it falls. The k-th slot of a
    source takes its k-th block, and after the last one the first again; slots beyond the need are left out. Sources
    whose part is hit too seldom by then get what they still need behind all other slots, in the order of the ring. Slots
    are ranked within stretches and moved by the sums of the stretches before, so no task sees all slots of a source.
    """
    spark = wanted.sparkSession
    number = _blocks(block_words)
    needs = (wanted.filter("source_size > 0").select("source", number.alias("blocks"), F.round(
        F.col("target") * number / F.col("source_size")).cast("bigint").alias("need")).filter("need > 0"))
    upto = F.sum("need").over(W.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0))
    parts = needs.select("source", "blocks", "need", upto.alias("upto"), F.sum("need").over(W.partitionBy()).alias("all"))

    def at(sum_):
        return F.floor(sum_ / F.col("all") * F.lit(float(_RING))).cast("bigint")

    parts = staged(parts.select("source", "blocks", "need", "all", at(F.col("upto") - F.col("need")).alias("low"),
                                at(F.col("upto")).alias("high")), folder, "parts")
    found = parts.agg(F.max("all").alias("all"), F.count("*").alias("sources")).first()
    # A few slots more than needed, as a source may lag behind its share; what is missing then is appended.
    count = found["all"] + found["all"] // 50 + 8 * found["sources"] if found["all"] else 0
    # A point finds its source by its range of the ring; each range is cut by few sources.
    ranges = max(1, 4 * found["sources"])
    width = -(-_RING // ranges)
    cut = parts.filter("high > low").select("source", "low", "high", F.explode(F.sequence(
        F.call_function("div", "low", F.lit(width)), F.call_function("div", F.col("high") - 1, F.lit(width)))).alias("range"))
    turn = F.pmod(F.col("id"), F.lit(_RING))
    point = F.pmod(turn * F.lit(GOLDEN_STEP % 65536)
                   + F.pmod(turn * F.lit(GOLDEN_STEP // 65536), F.lit(65536)) * F.lit(65536), F.lit(_RING))
    slots = spark.range(count).select(F.col("id").alias("slot"), point.alias("point"))
    small = found["sources"] <= SMALL_SOURCES
    dealt = (slots.withColumn("range", F.call_function("div", "point", F.lit(width)))
             .join(F.broadcast(cut) if small else cut, "range")
             .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source"))
    dealt = staged(dealt.withColumn("stretch", F.call_function("div", "slot", F.lit(STRETCH))), folder, "slots")
    sums = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    offsets = sums.select(F.col("source").alias("of"), F.col("stretch").alias("at"), (F.sum("n").over(
        W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    own = W.partitionBy("source", "stretch").orderBy("slot")
    ranked = (dealt.withColumn("k", F.row_number().over(own) - 1)
              .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
              .select("slot", "source", (F.col("k") + F.col("offset")).alias("k")))
    limits = parts.select(F.col("source").alias("of"), "blocks", "need")
    timely = (ranked.join(limits, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("k") < F.col("need"))
              .select("slot", "source", F.pmod("k", "blocks").alias("block")))
    got = sums.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("n"))
    late = (parts.join(got, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("missing", F.col("need") - F.col("n")).filter("missing > 0"))
    before = F.sum("missing").over(W.orderBy("low", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0))
    late = late.withColumn("first", before - F.col("missing") + count)
    late = late.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("missing") - 1)))
    return timely.unionByName(late.select((F.col("first") + F.col("j")).alias("slot"), "source",
                                          F.pmod(F.col("n") + F.col("j"), F.col("blocks")).alias("block")))


def mix_sources(docs: DataFrame, size: Column | str, doc_id: str = "doc_id", source: str = "source",
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A mix of sources: per document what it gives, the schedule, and the blocks the schedule takes.

    Returns (documents, slots, pieces). ``documents`` has one row per input row: doc_id, source, size, source_size, target
    and taken, the words that the mix takes from it, repeats counted. ``slots`` is the order of the mix, ``pieces``
    the words of documents in each block; joined on (source, block) they spell the mix out.

    A document occurs at most as often as its source is gone through, never more than ``most`` times its size.
    The words taken from a source differ from its target by half a block and a word, where a block is at most a fiftieth of
    the target or a word: by 1 % and two words. A source that is null is a source of its own, behind all others. Documents without words
    take part in nothing and give 0. Rows that repeat a doc_id are taken as one document of their joint size, and
    each gets the part that its size has in it, rounded down. The result depends on ids, sources and sizes alone. An
    empty table gives empty results. Other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "mix")
    own = staged(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"),
                             (size if isinstance(size, Column) else F.col(size)).cast("bigint").alias("size")), folder, "sizes")
    wanted = staged(targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), folder, "targets")
    joint = own.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    pieces = staged(shuffled_blocks(joint, wanted, folder, block_words, seed), folder, "pieces")
    slots = staged(schedule(wanted, folder, block_words), folder, "schedule")
    times = slots.groupBy(F.col("source").alias("of"), F.col("block").alias("nth")).agg(F.count("*").alias("times"))
    given = (pieces.join(times, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nth")))
             .groupBy(F.col("doc_id").alias("id"), F.col("source").alias("from"))
             .agg(F.sum(F.col("words") * F.col("times")).alias("all_taken"), F.first("size").alias("all_size")))
    total = wanted.select(F.col("source").alias("of"), "source_size", "target")
    found = (own.join(total, F.col("source").eqNullSafe(F.col("of")))
             .join(given, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")), "left"))
    taken = F.coalesce(F.floor(F.col("all_taken") * F.col("size") / F.col("all_size")), F.lit(0)).cast("bigint")
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")), slots, pieces
