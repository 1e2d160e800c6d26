"""Lexical and semantic scores of candidate commits, and their fusion."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtrace.functions.text import as_col, let
from fixtrace.operators.joins import assemble_top, merge_scores
from fixtrace.operators.ordering import join_small, rank_within, top_k
from fixtrace.operators.ranking import hit_at_k
from fixtrace.session import run_folder, staged

# Words of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
# Token vectors that meet as one matrix.
BLOCK_TOKENS = 256
# Candidates of one advisory that may share a term in one task.
GROUP_SHARE = 100_000
# Sets of terms into which those of an advisory are dealt at least, and candidates for each further set.
TERM_SETS = 8
SET_CANDIDATES = 1024


def term_counts(text: Column | str) -> Column:
    """Array of structs (term, tf) of the distinct lower-case words.

    Sorting the words inside the row puts equal ones next to each other: no shuffle is needed to count.
    """
    words = F.sort_array(F.regexp_extract_all(
        F.lower(F.coalesce(as_col(text), F.lit(""))), F.lit(WORD), F.lit(0)))

    def starts(words):
        marked = F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i))
        return F.struct(words.alias("words"), F.array_compact(marked).alias("starts"))

    def count(s):
        return F.transform(s["starts"], lambda start, j: F.struct(
            F.get(s["words"], start).alias("term"),
            (F.coalesce(F.get(s["starts"], j + 1), F.size(s["words"])) - start).alias("tf")))

    return let(let(words, starts), count)


def tfidf_similarity(mapping: DataFrame, advisory: DataFrame, commits: DataFrame,
                     text: str = "text", desc: str = "desc") -> DataFrame:
    """``mapping`` with the column similarity: TF-IDF cosine of description and commit text.

    Each advisory is a corpus of its own, made of its candidates: with N candidates, df of them holding a
    term, the term weighs tf * (ln((1 + N) / (1 + df)) + 1). The description is weighed with the
    candidates' vocabulary. No common term gives 0.

    ``mapping`` has (cve, commit_id, ...) once per pair, ``advisory`` (cve, desc), ``commits``
    (commit_id, text). Texts move once, to their pairs, which have numbers from then on. Work is spread by advisory and sets
    of terms: a whole advisory never meets in one task, and an advisory with more than ``GROUP_SHARE`` candidates has each of
    its terms spread further. Pairs and their sums are written down.
    """
    folder = run_folder(mapping.sparkSession, "tfidf")
    sizes = mapping.groupBy("cve").agg(F.count(F.lit(1)).alias("n"))
    once = mapping.groupBy("cve", "commit_id").agg(F.count(F.lit(1)).cast("int").alias("times"))
    pairs = staged(join_small(once, sizes, ["cve"]).withColumn("pair", F.monotonically_increasing_id()), folder, "pairs")
    # Words are counted behind the shuffle, as counts take several times the room of the text, once for each commit.
    # The pairs of a task are hashed, so that no counts are sorted.
    vectors = commits.select("commit_id", as_col(text).alias("text")).repartition("commit_id").select(
        "commit_id", term_counts("text").alias("terms"))
    copies = pairs.select("cve", "commit_id", "n", F.explode(F.array_repeat("pair", F.col("times"))).alias("pair"))
    # The outer form: the plain one would compute the array once more to test that it holds anything.
    postings = (vectors.join(copies.hint("shuffle_hash"), "commit_id").select("cve", "n", "pair", F.inline_outer("terms"))
                .filter("term is not null"))
    asked = advisory.select("cve", F.inline_outer(term_counts(desc))).filter("term is not null").withColumnRenamed("tf", "asked_tf")
    asked = join_small(asked, sizes, ["cve"])
    hot = F.col("n") > GROUP_SHARE
    weights = _weights(postings.filter(~hot), asked.filter(~hot))
    if not pairs.filter(hot).isEmpty():
        weights = weights.unionByName(_weights_of_hot(postings.filter(hot), asked.filter(hot)))
    weights = staged(weights, folder, "weights")
    cosine = F.try_divide(F.col("dot"), F.sqrt("norm2") * F.sqrt("asked_norm2"))
    scored = weights.filter("pair is not null").drop("asked_norm2")
    similar = join_small(scored, weights.filter("pair is null").select("cve", "asked_norm2"), ["cve"]).select(
        "pair", cosine.alias("similarity"))
    named = pairs.select("cve", "commit_id", "pair").join(similar, "pair").drop("pair")
    return mapping.join(named, ["cve", "commit_id"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0)))


def _weights(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """(cve, pair, norm2, dot, asked_norm2): sums over terms of each pair, and of each description, whose pair is null.

    ``postings`` has (cve, n, pair, term, tf), ``asked`` (cve, n, term, asked_tf). Both move once, by advisory and set of
    terms; there the rows of a term are counted by a window, and a pair has one sum for each set.
    """
    sets = F.pmod(F.xxhash64("term"), F.lit(TERM_SETS) + F.floor(F.col("n") / SET_CANDIDATES)).cast("int").alias("terms")
    met = (postings.select("cve", sets, "n", "pair", "term", "tf", F.lit(None).cast("int").alias("asked_tf"))
           .unionByName(asked.select("cve", sets, "n", F.lit(None).cast("bigint").alias("pair"), "term",
                                     F.lit(None).cast("int").alias("tf"), "asked_tf"))
           .repartition("cve", "terms"))
    # The hash makes rows quick to sort.
    same = Window.partitionBy("key", "cve", "terms", "term")
    counted = met.withColumn("key", F.xxhash64("cve", "term")).select(
        "cve", "pair", "n", "tf", "asked_tf", F.count("pair").over(same).alias("df"),
        F.count("asked_tf").over(same).alias("copies"), F.sum("asked_tf").over(same).alias("asked"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    of_pair, of_asked = F.col("tf") * F.col("idf"), F.col("asked_tf") * F.col("idf")
    return counted.filter("df > 0").withColumn("idf", idf).groupBy("cve", "pair").agg(
        F.sum(of_pair * of_pair * F.greatest("copies", F.lit(1))).alias("norm2"),
        F.sum(of_pair * F.coalesce("asked", F.lit(0)) * F.col("idf")).alias("dot"),
        F.sum(of_asked * of_asked).alias("asked_norm2"))


def _weights_of_hot(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for advisories with more than ``GROUP_SHARE`` candidates, the rows of a term spread over several tasks."""
    shares = F.ceil(F.col("n") / GROUP_SHARE)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    vocabulary = (postings.groupBy("cve", "n", "term").agg(F.count(F.lit(1)).alias("df"))
                  .join(asked.drop("n"), ["cve", "term"], "left")
                  .select("cve", "term", idf.alias("idf"), (F.coalesce("asked_tf", F.lit(0)) * idf).alias("asked_weight"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share")))
    weight = F.col("tf") * F.col("idf")
    scored = (postings.select("cve", "pair", "term", "tf", F.pmod(F.xxhash64("pair"), shares).alias("share"))
              .join(vocabulary, ["cve", "term", "share"]).groupBy("cve", "pair")
              .agg(F.sum(weight * weight).alias("norm2"), F.sum(weight * F.col("asked_weight")).alias("dot")))
    norms = vocabulary.filter("share = 0").groupBy("cve").agg(
        F.sum(F.col("asked_weight") * F.col("asked_weight")).alias("asked_norm2"))
    return scored.withColumn("asked_norm2", F.lit(None).cast("double")).unionByName(
        norms.select("cve", F.lit(None).cast("bigint").alias("pair"), F.lit(None).cast("double").alias("norm2"),
                     F.lit(None).cast("double").alias("dot"), "asked_norm2"))


def greedy_match(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Precision, recall and F1 of greedy token matching between two token-vector sequences per row.

    Precision is the mean over candidate tokens of the best cosine with any reference token, recall the
    mirror image. A sequence is one array of vectors, as long as the encoder's window. An empty one
    scores 0.
    """
    @F.pandas_udf("precision double, recall double, f1 double")
    def match(candidates: pd.Series, references: pd.Series) -> pd.DataFrame:
        def unit(vectors):
            matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

        scores = np.zeros((len(candidates), 3))
        for i, (one, other) in enumerate(zip(candidates, references)):
            if one is None or other is None or not len(one) or not len(other):
                continue
            cosines = unit(one) @ unit(other).T
            precision, recall = cosines.max(1).mean(), cosines.max(0).mean()
            total = precision + recall
            scores[i] = precision, recall, 2 * precision * recall / total if total else 0.0
        return pd.DataFrame(scores, columns=["precision", "recall", "f1"])

    kept = [c for c in df.columns if c not in (candidate, reference)]
    return df.select(*kept, match(candidate, reference).alias("_scores")).select(*kept, "_scores.*")


def token_sequences(tokens: DataFrame, key: str, position: str, vector: str) -> DataFrame:
    """(key, vectors): the token vectors of each text in order. A text holds one encoder window."""
    return tokens.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(position, vector))).getField(vector).alias("vectors"))


def token_blocks(tokens: DataFrame, key: str, position: str, vector: str) -> DataFrame:
    """(key, block, n, used, vectors): at most ``BLOCK_TOKENS`` tokens of a text, the vectors of the used ones in one array.

    Positions number the tokens of a text; one that repeats so often that a block is too full is an error. Tokens whose
    vector is null or holds a null, NaN or infinity count (``n``) but are not used. Tokens without key or position are left out.
    """
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = tokens.filter(F.col(key).isNotNull() & F.col(position).isNotNull()).select(
        F.col(key).alias("key"), F.floor(F.col(position) / BLOCK_TOKENS).alias("block"),
        F.when(usable, F.struct(F.col(position).alias("at"), F.col(vector).cast("array<double>").alias("vector"))).alias("token"))
    blocks = rows.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("token")).alias("t"))
    fits = F.when(F.col("n") > BLOCK_TOKENS, F.raise_error(F.lit("positions repeat in a text"))).otherwise(F.col("n"))
    return blocks.select("key", "block", fits.cast("bigint").alias("n"), F.size("t").alias("used"), F.flatten("t.vector").alias("vectors"))


def greedy_match_tokens(pairs: DataFrame, candidates: DataFrame, references: DataFrame, candidate: str = "candidate",
                        reference: str = "reference", position: str = "position", vector: str = "vector") -> DataFrame:
    """The scores of ``greedy_match`` for texts of any length: ``pairs`` with precision, recall and f1.

    ``candidates`` and ``references`` hold one token per row (the key as named, position, vector); ``pairs`` names two texts per
    row. Blocks of tokens meet as matrix products, dealt by block to all tasks, and leave the best cosine of each token there; the
    maxima of a token are merged, so no text is one row or one task. Work grows with the product of the two lengths.

    A text without tokens scores 0, as do null keys. A zero vector has cosine 0 with all; a token without usable vector
    matches nothing and counts as 0. Pairs that repeat are scored once and all kept.
    """
    @F.pandas_udf("ones array<double>, others array<double>")
    def best(ones: pd.Series, n_ones: pd.Series, others: pd.Series, n_others: pd.Series) -> pd.DataFrame:
        def unit(flat, n):
            matrix = np.asarray(flat, dtype=np.float64).reshape(n, -1)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

        found = []
        for one, n, other, m in zip(ones, n_ones, others, n_others):
            cosines = unit(one, n) @ unit(other, m).T
            found.append((cosines.max(1), cosines.max(0)))
        return pd.DataFrame(found, columns=["ones", "others"])

    folder = run_folder(pairs.sparkSession, "match")
    sides = [staged(token_blocks(tokens, key, position, vector), folder, side)
             for side, tokens, key in (("candidates", candidates, candidate), ("references", references, reference))]
    ones, others = (blocks.filter("used > 0").select(F.col("key").alias(side), F.col("block").alias(f"{side}_block"),
                                                     F.col("used").alias(f"{side}_used"), F.col("vectors").alias(f"{side}_vectors"))
                    for side, blocks in zip("cr", sides))
    totals = [blocks.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias(f"{side}_n"))
              for side, blocks, key in zip("cr", sides, (candidate, reference))]

    keys = pairs.select(F.col(candidate).alias("c"), F.col(reference).alias("r")).distinct()
    meetings = keys.join(ones.select("c", "c_block"), "c").join(others.select("r", "r_block"), "r")
    met = meetings.join(ones, ["c", "c_block"]).join(others, ["r", "r_block"]).select(
        "c", "r", "c_block", "r_block", best("c_vectors", "c_used", "r_vectors", "r_used").alias("m"))
    each = met.select("c", "r", F.explode(F.array(
        F.struct(F.lit("c").alias("side"), F.col("c_block").alias("block"), F.col("m.ones").alias("best")),
        F.struct(F.lit("r").alias("side"), F.col("r_block").alias("block"), F.col("m.others").alias("best")))).alias("e"))
    tokens = each.select("c", "r", "e.side", "e.block", F.posexplode("e.best").alias("at", "best"))
    sums = tokens.groupBy("c", "r", "side", "block", "at").agg(F.max("best").alias("best")).groupBy("c", "r").agg(
        *[F.sum(F.when(F.col("side") == side, F.col("best"))).alias(f"{side}_sum") for side in "cr"])

    scored = (pairs.join(sums.withColumnsRenamed({"c": candidate, "r": reference}), [candidate, reference], "left")
              .join(totals[0], candidate, "left").join(totals[1], reference, "left"))
    precision, recall = (F.coalesce(F.col(f"{side}_sum") / F.col(f"{side}_n"), F.lit(0.0)) for side in "cr")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.select(*pairs.columns, precision.alias("precision"), recall.alias("recall")).withColumn("f1", f1)


def fuse(df: DataFrame, weight: float = 1.0) -> DataFrame:
    """Lexical plus weighted semantic score, not normalised."""
    return df.withColumn("fused_f1", F.col("similarity") + F.lit(float(weight)) * F.col("f1"))


def best_first(score: str, tie: str = "commit_id") -> list[Column]:
    return [F.col(score).desc(), F.col(tie)]


def rank_candidates(df: DataFrame, score: str = "fused_f1", sizes: DataFrame | None = None) -> DataFrame:
    """Rank per advisory, best = 1, ties by commit id. Give ``sizes`` where scores are costly to compute."""
    return rank_within(df, ["cve"], best_first(score), sizes=sizes)


def top_candidates(df: DataFrame, score: str = "fused_f1", k: int = 100) -> DataFrame:
    """The k best candidates per advisory with their rank."""
    return top_k(df, ["cve"], best_first(score), k)


def hybrid_retrieve(lexical: DataFrame, semantic: DataFrame, weight: float = 1.0,
                    k: int = 100) -> DataFrame:
    """The k best candidates per advisory by fused score."""
    return top_candidates(fuse(merge_scores(lexical, semantic), weight), k=k)


def hybrid_retrieve_texts(lexical: DataFrame, semantic: DataFrame, advisory: DataFrame,
                          patches: DataFrame, nonpatches: DataFrame, weight: float = 1.0,
                          k: int = 100) -> DataFrame:
    """As ``hybrid_retrieve``, with texts attached to the survivors."""
    top = hybrid_retrieve(lexical, semantic, weight, k)
    return assemble_top(top, advisory, patches.drop("repo"), nonpatches.drop("repo"), k)


def hybrid_hit_rate(lexical: DataFrame, semantic: DataFrame, weight: float = 1.0, k: int = 100) -> DataFrame:
    """Share of advisories with a fix among the k best."""
    return hit_at_k(hybrid_retrieve(lexical, semantic, weight, k), k)
