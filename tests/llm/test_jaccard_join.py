import random
import re

import pytest

from pyspark.sql import functions as F

from hexflow.llm import jaccard_join, sets
from hexflow.llm.jaccard_join import drop_near_duplicates, near_duplicates
from hexflow.llm.shared import Tables, spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    found = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, s) in enumerate(found):
        for j, t in found[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in found}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Éa"]
    common = " ".join(r.choices(vocab, k=30))
    rows = []
    for g in range(40):
        base = r.choices(vocab, k=r.choice([1, 2, 4, 5, 7, 9, 10, 11, 12, 14, 15, 16, 18, 20, 22, 40, 90]))
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                r.choice([lambda: w.insert(at, r.choice(vocab)), lambda: w.append(r.choice(vocab)), lambda: w.__setitem__(0, r.choice(vocab)), lambda: w.pop() if len(w) > 1 else None])()
            rows.append((len(rows), " ".join(w) + (" " + common if g % 4 == 0 else "")))
    return [*rows, (500, ""), (501, None), (502, " \n\t"), (503, " ")]


@pytest.mark.parametrize(("seed", "largest"), [(1, 16), (2, 0), (3, 8)])
def test_equals_brute_force(spark, seed, largest, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary", lambda classes: largest)
    rows = corpus(seed)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows + rows[:3]], "doc_id long, text string, sig string, n int")
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in brute(rows).items() if i == c)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copies(seed, n=70):
    """A text, copies of it with one to eight words changed, and chains in which each text is a change of the last."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = [list(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = f"own{r.randrange(10**6)}"
        texts.append(w)
    for c in range(3):
        w = [f"c{c}x{i}" for i in range(60)]
        for _ in range(12):
            w = list(w)
            w[r.randrange(len(w))] = f"own{r.randrange(10**6)}"
            texts.append(w)
    r.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts + texts[:20])]


@pytest.mark.parametrize("enough", [4, 0])
def test_group_of_near_copies(spark, monkeypatch, enough):
    monkeypatch.setattr(jaccard_join, "ENOUGH", enough)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 20)
    rows = near_copies(7)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_both_halves_run_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id as id", "0L as th", "text")
    classes = Tables(spark).keep(sets.classes(sets.survivors(docs, jaccard_join.text_sets, copies=False)))
    largest = jaccard_join.boundary(classes)
    assert largest > 0 and jaccard_join.light_entries(classes, largest).count() > 0
    assert sets.postings(classes, (), least=largest + 1).count() > 0


def test_hot_keys_are_dealt_and_joined_alike(spark):
    big = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as key")
    small = big.groupBy("key").count().withColumnRenamed("count", "size").where("key <> 7")
    for how in ("inner", "left"):
        got = sorted((r.id, r.key, r["size"]) for r in spread_join(big, small, "key", "size", 3000, how).collect())
        assert got == sorted((r.id, r.key, r["size"]) for r in big.join(small, "key", how).collect())
    places = spread_join(big, small, "key", "size", 3000).where("key = 0").groupBy(F.spark_partition_id()).count()
    assert places.count() >= 1
