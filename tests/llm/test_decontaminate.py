import pickle
import random
import re

import pyarrow as pa
import pytest

from hexflow.llm import decontaminate
from hexflow.llm.decontaminate import find_contamination, is_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        m = min(size, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m and item is not None else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "A b c d e f g"), (2, "x"), (3, "É ü-ñ 12 q"), (4, None), (5, "..."), (None, "zz"), (7, "c d e f g h i j"), (7, "zz yy")]
TEXTS = ["a B,c d\ne f", "x x y x", "", None, "é ü ñ 12 q", "b c d e f g h i", "zz yy zz", "a b c d " * 50, "b c d e " + "long " * 3000 + "c d e f"]


@pytest.mark.parametrize("block", [8_000_000, 20])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, sorted(r["items"])) for r in find_contamination(docs, bench, size=4).collect()}
    assert got == {i: brute(t, ITEMS, 4) for i, t in enumerate(TEXTS)}
    kept = decontaminate.decontaminate(docs, bench, size=4)
    bad = {r.id for r in find_contamination(docs, bench, size=4).where(is_contaminated()).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - bad


def test_tables_stay_small_and_words_are_compared():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(r.choices(vocab, k=2000)) for _ in range(200)]
    block = decontaminate.Block.build([str(i) for i in range(200)], texts, 13)
    chars = sum(map(len, texts))
    assert len(pickle.dumps(block)) < 25 * chars
    doc = " ".join([*r.choices(vocab, k=50), *texts[7].split(" ")[100:140], "zz", *texts[9].split(" ")[5:17]])
    (hit, items), = decontaminate._scan(pa.array([doc]), block)
    assert hit.sum() == 40 and hit[50:90].all() and items.tolist() == [7]
    block.data = block.data.copy()
    word = texts[7].split(" ")[110]
    block.data[block.starts[7 * 2000 + 110]] += 1  # as if another word had this one's hash
    (hit, items), = decontaminate._scan(pa.array([doc]), block)
    assert word and hit.sum() == 29 and not hit[60]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in find_contamination(docs, bench).collect()] == [(2, 0)]
    assert find_contamination(docs.limit(0), bench).count() == 0
