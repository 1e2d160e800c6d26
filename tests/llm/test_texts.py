"""Toxicity, language, quality, pieces and token counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtrace.llm.language import UNKNOWN, fit_language, identify_language
from fixtrace.llm.learning import Logistic, labelled_sample, remainder
from fixtrace.llm.pieces import PieceTransducer, decode_pieces, encode_pieces
from fixtrace.llm.quality import fit_quality, score_quality
from fixtrace.llm.queries import tokenizer_path
from fixtrace.llm.token_counts import MergeTable, WordCounter, count_tokens
from fixtrace.llm.toxicity import ToxicityModel, fit_toxicity, fold, score_toxicity

LETTERS = "aaabbcdehinote  \n\t\x1c\x85'  ▁sre.!?<|>0123٣Ⅷ½ΣςİßÀéñ한글日本語😀👍🏽‍的在人\u0000﻿"
ODD = ["", " ", "  ", "\n", "a" * 3000, "<s>hi</s> <unk> <0x0A>", "x\ny\n\nz", " " * 37 + "a" + " " * 19, "lllllll" * 9, "日本語" * 20,
       "<|startoftext|>hi<|endoftext|>", "x<|endoftext|", "<|ENDOFTEXT|>", "don't we'll I'M", "aaaa" * 77 + " " + "ab" * 500,
       "é", "ΑΣ ΑΣ'ς", "Å", "힣ᆨ", "²². m² 1.5.", "a▁b"]


@pytest.fixture(scope="module")
def texts(data, duck):
    pick = random.Random(5)
    made = ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, 50))) for _ in range(1500)]
    return ODD + made + [t for (t,) in duck.sql("SELECT text FROM documents").fetchall()]


def test_pieces_as_the_library(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceTransducer(path)
    for text, ids in zip(texts, library.encode(texts, num_threads=1)):
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == library.decode(ids)
        if "▁" not in text:
            assert own.decode(ids) == text


def test_pieces_without_cuts_are_the_same(texts):
    """Words are an economy: whole texts have the same lightest path."""
    own = PieceTransducer(tokenizer_path("piece_bpe_32k.model")).compile()
    own.shortest_of = lambda whole: uncut(own, whole)
    for text in texts[:300]:
        if text:
            assert own.shortest_of(own.normalise(text)) == own.encode(text)


def uncut(own, whole):
    characters = np.array([ord(c) for c in whole], dtype=np.int64)
    return [i for arc in own.shortest(characters, np.array([0]))[0].tolist() for i in ([arc] if arc < len(own.texts) else own._written(arc))]


def made_model(folder, unigram, with_bytes, user=(), unused=(), rule="identity", squeeze=False, prefix=True):
    """A model written by hand: syllables of a few letters with scores that are sums of quarters."""
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    pick, model = random.Random(9), sentencepiece_model_pb2.ModelProto()

    def add(piece, score, kind):
        model.pieces.add(piece=piece, score=score, type=kind)

    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for u in user:
        add(u, 0, 4)
    for byte in range(256 if with_bytes else 0):
        add(f"<0x{byte:02X}>", 0, 6)
    made = {"▁", *unused} | set("abcdeé.")
    while len(made) < 150:
        made.add(("▁" if pick.random() < 0.3 else "") + "".join(pick.choices("abcdeé.", k=pick.randint(1, 4))))
    for k, piece in enumerate(sorted(made, key=lambda t: (len(t), t))):
        add(piece, -k if not unigram else -2.0 * len(piece) + pick.randint(-8, 8) / 4 - 3, 5 if piece in unused else 1)
    model.trainer_spec.model_type = 1 if unigram else 2
    model.trainer_spec.byte_fallback = with_bytes
    model.trainer_spec.unk_piece = "<unk>"
    model.normalizer_spec.name = rule
    if rule != "identity":
        found = sentencepiece_model_pb2.ModelProto()
        found.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = found.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    path = folder / "made.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("options", [
    {}, {"with_bytes": False}, {"user": ("ab", "<x>", "éa.")}, {"unused": ("ab", "cd.")}, {"rule": "nfkc", "squeeze": True},
    {"rule": "nmt_nfkc_cf", "squeeze": True, "with_bytes": False}, {"squeeze": True, "prefix": False}, {"prefix": False}, {"user": ("<x>",), "rule": "nfkc"}])
@pytest.mark.parametrize("unigram", [True, False])
def test_made_models_as_the_library(tmp_path, options, unigram):
    sentencepiece = pytest.importorskip("sentencepiece")
    options = {"with_bytes": True} | options
    path = made_model(tmp_path, unigram, **options)
    own = PieceTransducer(path)
    if not unigram and options.get("unused"):
        with pytest.raises(ValueError):
            own.compile()
        return
    library, pick = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    texts = ["", " ", "  a", "a  ", "ab<x>cd", "éa.é", "ＡＢｃ ﬁ ① x\u00a0y", "zz\u0301 e\u0301a", "日本zz a", "\t\n a\n\nb", "a▁b ▁"]
    texts += ["".join(pick.choice(["a", "b", "c", "d", "e", "é", ".", " ", "a", "ab", "<x>", "z", "  ", "Ａ", "e\u0301"]) for _ in range(pick.randint(1, 40)))
              for _ in range(400)]
    flat, sizes = own.encode_many(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        ids = ids.tolist()
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids), text


def test_words_are_remembered_within_bounds(monkeypatch):
    from fixtrace.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(pieces, "REMEMBERED_LENGTH", 60)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 64)
    path, pick = tokenizer_path("piece_bpe_32k.model"), random.Random(2)
    own, whole = PieceTransducer(path), PieceTransducer(path)
    texts = [" ".join("".join(pick.choices("abcdeth", k=pick.randint(1, 90))) for _ in range(20)) for _ in range(40)]
    flat, sizes = whole.encode_many(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert own.encode(text) == ids.tolist()
        assert len(own.young.numbers) + len(own.old.numbers) <= 140 and max(map(len, own.young.numbers), default=0) <= 60
    assert pieces.compiled(path) is pieces.compiled(path)


def test_ids_that_a_model_has_not():
    own = PieceTransducer(tokenizer_path("piece_bpe_32k.model"))
    assert own.decode([-5, 10 ** 6, None]) == own.decode([own.unknown] * 3) != ""


def test_pieces_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit("old"))
    path = tokenizer_path("piece_bpe_32k.model")
    found = decode_pieces(encode_pieces(docs, path), path).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 5 and by_id[1].piece_ids is None and by_id[1].decoded is None
    assert by_id[2].piece_ids == [] and by_id[2].decoded == "" and by_id[3].decoded == "a b"
    assert by_id[None].decoded == "x" * 200_000
    assert encode_pieces(docs.limit(0), path).count() == 0
    once = encode_pieces(docs.withColumn("back", F.lit(1)), path, decoded="back").collect()
    assert sorted((repr(r.piece_ids), repr(r.back)) for r in once) == sorted((repr(r.piece_ids), repr(r.decoded)) for r in found)


def test_token_counts_as_the_library(texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert WordCounter(path).counts(texts) == wanted


def test_merges_of_one_and_of_many_words_are_the_same():
    table = MergeTable(tokenizer_path("word_bpe_49k.json"))
    words = [w.encode() for w in ("a", "the", "aaaaaaa", "abababab", "straße", "zzz" * 40, "hello", "world")]
    assert table.counts(words).tolist() == [int(table.counts([w])[0]) for w in words]


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "hi"), (3, "hi"), (None, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    path = tokenizer_path("word_bpe_49k.json")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(docs, path).collect()) == [(0, 60_000), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("text", ["Moron", "m0r0n", "MОRОN", "ｍｏｒｏｎ", "morön", "mooooron", "m​oron", "mоrоn"])
def test_folding_finds_disguises(text):
    model = ToxicityModel({fold("moron").strip(): 5.0})
    assert model.features(f"you {text}, you")[0] > 0
    assert fold("clown") == fold("c1own") == fold("c|own") and fold("stupid") == fold("5tup1d!") == fold("$tupid.")


def test_lexicon_needs_words_and_minds_exceptions():
    model = ToxicityModel({"trash": 4.0, "ciown": 4.0, "iowe*": 3.0}, exceptions=("trash can",))
    assert model.features("a trash can, the trashy")[0] == 0
    assert model.features("trash can and trash")[1] == pytest.approx(model.features("and trash")[1])
    assert model.features("loweischaft flowe")[0] > 0 and model.features("flowei")[0] == 0
    short, long = model.features("clown"), model.features("clown " + "word " * 500)
    assert short[0] > long[0] and short[1] == long[1]


def test_models_without_labels_give_the_prior(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert {0 <= r.score < 0.3 for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {True}
    model = fit_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in identify_language(docs, model).collect()} == {UNKNOWN}


def test_scores_of_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "12 .. !!"), (4, "word " * 100_000)], "doc_id long, text string").withColumns(
        {c: F.lit("old") for c in ("score", "lang_pred", "lang_score", "x")})
    for fitted, scorer in ((fit_quality(docs, labels), score_quality), (fit_toxicity(docs, labels), score_toxicity)):
        found = scorer(odd, fitted).collect()
        assert len(found) == 5 and all(0 <= r.score <= 1 for r in found) and found[0]["x"] == "old"
        assert scorer(odd.limit(0), fitted).count() == 0
    found = identify_language(odd, fit_language(docs)).collect()
    assert [r.lang_pred for r in found][:4] == [UNKNOWN] * 4 and found[4].lang_pred != UNKNOWN
    assert all(0 <= r.lang_score <= 1 for r in found) and found[0].lang_rejected


def test_narrow_margins_are_rejected(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = fit_language(docs)
    strict, lax = (identify_language(docs, model, margin=m).filter("lang_rejected").count() for m in (0.5, 0.0))
    assert lax == 0 and strict > 0


@pytest.mark.parametrize("label, parts, held, query", [("toxic", 4, 2, "op3_toxicity"), ("quality", 5, 0, "op10_quality")])
def test_held_out_accuracy(spark, label, parts, held, query):
    """On rows that were not learned from, over a larger table."""
    from fixtrace.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.1"
    found = QUERIES[query](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    found = found.filter("held_out").select("predicted", F.col(label).alias("truth")).toPandas()
    assert len(found) > 500
    assert (found.predicted == found.truth).mean() > 0.96
    for value in (0, 1):
        own = found[found.truth == value]
        assert (own.predicted == value).mean() > 0.85


def test_held_out_languages(spark):
    from fixtrace.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    first = [labelled_sample(rows, "label", {0: 18_000, 1: 2_000}, 500, 3).groupBy("label").count().collect() for _ in range(2)]
    assert first[0] == first[1] and all(350 < r["count"] < 650 for r in first[0])


def test_remainder_is_crc32(spark):
    import zlib

    found = spark.createDataFrame([(7,), (-12,), (None,)], "doc_id long").select(remainder("doc_id", 5)).collect()
    assert [r[0] for r in found] == [zlib.crc32(b"7") % 5, zlib.crc32(b"-12") % 5, None]


def test_logistic_fits_shares():
    import numpy as np

    x = np.array([[0.0]] * 100 + [[1.0]] * 100)
    y = np.array([1.0] * 20 + [0.0] * 80 + [1.0] * 70 + [0.0] * 30)
    assert Logistic(x, y).chances(np.array([[0.0], [1.0]])) == pytest.approx([0.2, 0.7], abs=0.01)
