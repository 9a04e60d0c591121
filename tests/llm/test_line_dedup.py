import random
import re

import numpy as np

from hexflow.llm import line_dedup, sets
from hexflow.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(line):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """rows: (id, text), ids distinct; the text left of each."""
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            s = shingles(line)
            if s and any(100 * len(s & t) >= 75 * len(s | t) for t in seen):
                pass
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "été"]
    lines = [" ".join(r.choices(vocab, k=r.choice([1, 4, 5, 6, 9, 20, 45]))) for _ in range(50)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(lines).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            text.append(" ".join(w) if r.random() < 0.8 else " ".join(w).upper())
        rows.append((i, "\n".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(1), (None, "a b c d e f g"), (1000, None), (1001, ""), (1002, "\n\n"), (1003, "A b c d e f g\nrest of it")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, lines string, th long").repartition(3)
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert dedup_lines(docs).columns == ["doc_id", "text", "lines", "th"]


def test_group_of_copies_and_long_text(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"own{i}"] + base[31:])) for i in range(40)]
    rows.append((99, "\n".join(f"l{i} a{i} b{i} c{i} d{i} e{i}" for i in range(3000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert got[0] and not any(got[i] for i in range(1, 40))


def test_empty_table_and_repeated_rows(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (1, "z\na b c d e f")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(docs).collect()) == ["", "a b c d e f", "a b c d e f", "a b c d e f", "z"] or sorted(r.text for r in dedup_lines(docs).collect()) == ["", "", "", "", "z\na b c d e f"]


def test_text_of_more_lines_than_two_bytes_count(spark):
    lines = [f"l{i} a{i} b{i} c{i} d{i} e{i}" for i in range(70_000)]
    lines[66_000] = lines[69_999] = lines[3]
    lines[68_000] = lines[67_000]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([lines[67_500], lines[10], "own line of five words"]))], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in dedup_lines(docs).collect()}
    assert got[1] == [x for i, x in enumerate(lines) if i not in (66_000, 68_000, 69_999)]
    assert got[2] == ["own line of five words"]


def test_places_need_up_to_four_bytes():
    for top in (255, 256, 65_535, 65_536, 200_000):
        places = np.array([0, 0, 3, top, top + 70_000])
        assert sets._places(np.frombuffer(sets._steps(places), np.uint8), len(places)).tolist() == places.tolist()


def test_hot_near_copies_by_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ENOUGH", 0)
    monkeypatch.setattr(line_dedup, "TOGETHER", 20)
    r = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(40)] = f"own{r.randrange(10**6)}"
        rows.append((i, "\n".join([" ".join(w), f"line {i} of its own words", " ".join(w)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.text for x in dedup_lines(docs).collect()} == brute(rows)
