import math
import re

import pytest
import test_decontaminate
import test_jaccard_join
import test_line_dedup

from hexflow.llm import sentencepiece_dropout, toxicity
from hexflow.llm import text as T

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF).checkpoint()
        assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < left.count() <= n
        n = left.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() == n


def test_query_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{i}_") for x in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def plain_score(grammar, text):
    """The grammar's score, one clause and one word at a time."""
    lexicon = dict(zip(grammar.words.tolist(), map(chr, grammar.symbols.tolist()), strict=True))
    stems = {n: set(x.tolist()) for n, x in grammar.stems.items()}
    counts = dict.fromkeys(toxicity.PATTERNS, 0)
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for clause in re.split(r"[.!?;:\n]", lower):
        state = 0
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause):
            raw, symbol = word.encode(), lexicon.get(int(T.hash_words([word])[0]), toxicity.OTHER)
            for n, known in stems.items():
                if len(raw) >= n and int(T.Words(*stem(raw[:n])).hashes()[0]) in known:
                    symbol = toxicity.INSULT
            out = toxicity.OUT[state][symbol]
            state = toxicity.GO[state][symbol]
            if out in counts:
                counts[out] += 1
    return 1 / (1 + math.exp(-(grammar.weights[0] + sum(w * math.log1p(n) for w, n in zip(grammar.weights[1:], counts.values(), strict=True)))))


def stem(raw):
    import numpy as np

    return np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), np.array([0, 1]), np.array([0, len(raw)])


def test_stages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in table.collect()}
    assert len(left) == table.count()
    grammar = toxicity.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: t for i, t in left.items() if plain_score(grammar, t) < 0.3}
    docs = corpus_pipeline.toxicity_stage(spark, table, SF).checkpoint()
    assert {r.doc_id: r.text for r in docs.collect()} == left and len(left) < table.count()

    left = test_line_dedup.brute(sorted(left.items()))
    docs = corpus_pipeline.line_stage(spark, docs, SF).checkpoint()
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)

    found = test_jaccard_join.brute(sorted(left.items()))
    left = {i: left[i] for i, (n, first) in found.items() if not n or i == first}
    docs = corpus_pipeline.jaccard_stage(spark, docs, SF).checkpoint()
    assert {r.doc_id: r.text for r in docs.collect()} == left

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: test_decontaminate.brute(t, items, 13)[:2] for i, t in left.items()}
    left = {i: left[i] for i, (n, k) in hits.items() if not (k > 0 and 20 * k >= n)}
    docs = corpus_pipeline.benchmark_stage(spark, docs, SF).checkpoint()
    assert {r.doc_id: r.text for r in docs.collect()} == left

    pieces = sentencepiece_dropout.Pieces.load(seed=1, dropout=0.1)
    got = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
    assert {r.doc_id: pieces.raw_text(r["ids"]) for r in got} == left and all(r.n_pieces == len(r["ids"]) for r in got)


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, "a line of six words here", None, "s", None), (1, "a line of six words here", None, "s", None), (None, "text of a row without id", "en", None, 3), (2, None, None, None, None), (3, "", "de", "s", 0), (4, "word " * 30_000, "en", "s", 150_000), (4, "other text with the same number as above", "en", "s", 1), (5, " \n\t\n", "en", "s", 4)]
    odd = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, sig string, lines string")
    for table, left in ((odd, [(None, 6), (1, 6), (2, 0), (3, 0), (4, 8), (4, 30_000), (5, 0)]), (odd.limit(0), [])):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).checkpoint()
            assert docs.columns == odd.columns
        out = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
        assert len(out) == len(left)
        assert sorted(((r.doc_id, len((r.text or "").split())) for r in docs.collect()), key=str) == sorted(left, key=str)
