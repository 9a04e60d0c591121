import random

import pytest

from hexflow.llm.sentencepiece_dropout import MODEL, Pieces, decode, encode, round_trip

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", None, " ", "hello world", "  two  spaces\n\nnew\tline ", "é漢字テスト 🎉 x", "a" * 300 + " " + "ab" * 200, "▁literal▁ sign x▁y", "\x00\x01", "the cat sat on the mat and the dog lay on the rug " * 400, "日本語" * 100]


def docs_of(spark):
    r = random.Random(1)
    more = ["".join(r.choices("ab  éx▁\n漢.,Th", k=r.randint(0, 90))) for _ in range(60)]
    return TEXTS + more, spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS + more)], "doc_id long, text string, ids string")


def test_without_dropout_equals_the_library(spark):
    texts, docs = docs_of(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.id: r.ids for r in encode(docs, Pieces.load()).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
        elif "▁" not in t:
            assert got[i] == sp.encode(t), t


def test_dropout_varies_and_decodes_exactly(spark):
    texts, docs = docs_of(spark)
    plain = {r.id: r.ids for r in encode(docs, Pieces.load()).collect()}
    runs = []
    for seed in (1, 1, 2):
        pieces = Pieces.load(seed=seed, dropout=0.2)
        out = encode(docs.repartition(1 + seed), pieces)
        assert {r.id: r.text for r in decode(out, pieces).collect()} == dict(enumerate(texts))
        runs.append({r.id: r.ids for r in out.collect()})
    assert runs[0] == runs[1] != runs[2] and runs[0] != plain and len(runs[0][9]) > len(plain[9])
    assert all(len(r) == 0 for i, r in runs[0].items() if texts[i] == "")
    assert round_trip(docs, Pieces.load(seed=1, dropout=0.2)).where("not lossless").count() == 0
    assert encode(docs.limit(0), Pieces.load()).count() == 0


def test_every_occurrence_draws_its_own(spark):
    word, pieces = "internationalization", Pieces.load(seed=1, dropout=0.2)
    many = spark.createDataFrame([(i, word) for i in range(400)], "doc_id long, text string").repartition(4)
    assert len({tuple(r.ids) for r in encode(many, pieces).collect()}) > 20
    one = spark.createDataFrame([(7, " ".join([word] * 400))], "doc_id long, text string")
    words, run = set(), []
    for i in encode(one, pieces).first().ids:
        piece = pieces.raw[pieces.raw_at[i] : pieces.raw_at[i + 1]].tobytes()
        if piece.startswith(b" ") and run:
            words.add(tuple(run))
            run = []
        run.append(piece)
    assert len(words) > 20
