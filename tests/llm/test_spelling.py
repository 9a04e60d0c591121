import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from hexflow.llm import spelling
from hexflow.llm.spelling import Automaton

SCHEMA = "doc_id long, text string, word string, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "w", 0) for i, t in rows], SCHEMA).repartition(parts)


def edits(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def deletions(w):
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute(rows):
    n = counted(rows)
    by = {}
    for w in n:
        for x in deletions(w):
            by.setdefault(x, []).append(w)
    out = {}
    for w in n:
        near = {v for x in deletions(w) for v in by[x] if edits(w, v)}
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, None, n[w], len(near)]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: (form, root, k, near, n[form] if form else None) for w, (form, root, k, near) in out.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed=1, n=250):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ababababab", "ÀÉÎÕÜßÿ"]

    def word():
        w = r.choice(stems)
        if r.random() < 0.4:
            k = r.randrange(len(w))
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abcdeé") + w[k:], w[:k] + r.choice("abcdeé") + w[k + 1 :]))
        return w.upper() if r.random() < 0.1 else w

    return [(i, r.choice((" ", ", ", "-", "7")).join(word() for _ in range(60))) for i in range(n)]


def test_automaton_numbers_and_minimality():
    ordered = sorted({"tap", "taps", "top", "tops", "stop", "stops", "s"})
    a = Automaton(ordered)
    assert [a.number(w) for w in ordered] == list(range(len(ordered))) and a.number("to") is None and a.number("tapss") is None
    # states by the words that can follow them
    follow = {tuple(sorted(w[i:] for w in ordered if w.startswith(p))) for p in {w[:k] for w in ordered for k in range(len(w) + 1)} for i in [len(p)]}
    assert len(a.final) == len(follow)


@pytest.mark.parametrize("seed", range(3))
def test_automaton_finds_one_error_after_the_exact_part(seed):
    r = random.Random(seed)
    ordered = sorted({"".join(r.choice("ab") for _ in range(r.randint(3, 8))) for _ in range(120)})
    a = Automaton(ordered)
    for w in ordered[::3] + ["aaaa", "abababab", "bbbbbbb"]:
        for exact in range(len(w) + 1):
            assert a.near(w, exact) == {k for k, v in enumerate(ordered) if edits(w, v) and v.startswith(w[:exact]) and one_error_after(w, v, exact)}


def one_error_after(w, v, exact):
    return v[:exact] == w[:exact] and edits(w[exact:], v[exact:])


@pytest.mark.parametrize(("part", "key"), [(8192, 3), (25, 3), (3, 3), (40, 1)])
def test_equals_brute_force_in_groups_of_any_size(spark, monkeypatch, part, key):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "KEY", key)
    rows = corpus()
    want = brute(rows)
    assert got(spelling.variants(frame(spark, rows))) == want
    assert sum(1 for v in want.values() if v[0]) > 20


def test_chains_of_forms_lead_to_one_root(spark):
    rows = [(i, "colouration") for i in range(2000)] + [(5000 + i, "colouratin") for i in range(150)] + [(7000 + i, "colourtin") for i in range(12)]
    df = got(spelling.variants(frame(spark, rows)))
    assert df == brute(rows)
    assert df["colourtin"][:2] == ("colouratin", "colouration")


def test_odd_rows(spark):
    rows = [(1, None), (None, "nullified nullified"), (2, ""), (3, "short words only"), (4, "x" * 5000 + " " + "x" * 5000), (5, "x" * 4999 + " " + "x" * 4999), (6, "repeated"), (6, "repeated"), (7, "×÷×÷×÷× ×÷×÷×÷×"), (8, "ŁŁŁŁŁŁŁŁ ŁŁŁŁŁŁŁŁ")]
    assert got(spelling.variants(frame(spark, rows))) == brute(rows)
    assert got(spelling.variants(frame(spark, []))) == {}


def test_query_on_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(spelling.op13_two_automata(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = {tuple(None if x != x else x for x in r) for r in db.execute(spelling.OP13_SQL).df()[columns].astype(object).where(lambda d: d.notna(), None).itertuples(index=False)}
    assert {tuple(r) for r in spelling.op13_two_automata(spark, "/root/testdata/sf0.01").select(*columns).collect()} == want
