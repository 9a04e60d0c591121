import random

from pyspark.sql import functions as F

from hexflow.llm import toxicity as tox


def read(symbols):
    state, out = 0, ""
    for s in symbols:
        out += tox.OUT[state][s]
        state = tox.GO[state][s]
    return out


def test_the_grammar_tells_patterns_apart():
    assert read("PooI") == "PooA" and read("oooI") == "oooI" and read("NoI") == "Noi" and read("N...I") == "N...I"
    assert read("RoooI") == "RoooJ" and read("Ro.oI") == "Ro.oI" and read("FT") == "FK" and read("oT") == "oT" and read("PoooooooI") == "PoooooooI"


def scores(spark, texts, grammar):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    return {r.id: r.score for r in tox.score(docs, grammar).collect()}, docs


def test_hand_set_weights(spark):
    texts = ["you are an idiot", "you are not an idiot", "she said you are an idiot", "I will kill you", "a fine day", "", None, "IDIOT###", "fine. " * 20_000 + "you moron"]
    got, docs = scores(spark, texts, tox.Grammar.of([], []))
    assert got[0] > 0.3 > got[1] and got[2] < got[0] and got[3] > 0.3 and got[4] == got[5] == got[6] < 0.1 and got[7] > got[4] and got[8] > 0.3
    kept = tox.drop_toxic(docs, tox.Grammar.of([], []))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}


def test_learns_words_and_stems_and_generalises(spark):
    r = random.Random(2)
    vocab = ["".join(r.choices("aeioustrn", k=4)) for _ in range(300)]
    rows = []
    for i in range(600):
        words, toxic = r.choices(vocab, k=30), i % 6 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(["blixfoo", "blixbar", "blixque", f"blix{r.choice(vocab)}"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    got = {x.id: x.score >= 0.3 for x in tox.score(docs, tox.learn(docs, labels)).collect()}
    assert all(got[i] == bool(y) for i, _, y in rows[400:])


def test_copies_do_not_enter_the_lexicon():
    covers = {"bad": set(range(20)), "rare": {3, 4, 5, 6}, "alone": {30, 31}}
    assert tox.explain(covers, dict.fromkeys(covers, 0)) == (["bad"], [])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    assert tox.score(docs, tox.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))).where(F.col("score") > 0.3).count() == 1
    assert tox.score(docs.limit(0), tox.Grammar.of([], [])).count() == 0


def test_repeated_rows_teach_once(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE", 40)
    rows = [(i, f"word{i} blorgh{i % 3}" if i % 2 else f"word{i} fine") for i in range(60)] + [(1, "other text")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    fit = tox.Grammar.fit
    monkeypatch.setattr(tox.Grammar, "fit", lambda self, counts, toxic, **k: seen.append(len(counts)) or fit(self, counts, toxic, **k))
    tox.learn(docs, labels)
    assert seen == [40]


def test_precision_and_recall_on_held_out_labels(spark):
    """On the rows that the contract holds out, as the README gives them."""
    sf = "/root/testdata/sf0.1"
    got = tox.op6_pattern_grammar(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    tp, fp, fn = n[1, 1], n.get((0, 1), 0), n.get((1, 0), 0)
    print("precision", tp / (tp + fp), "recall", tp / (tp + fn), n)
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.7  # 0.99 and 0.75: of 120 toxic rows, words that fewer than SUPPORT toxic rows show are not learned
