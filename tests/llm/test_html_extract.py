import html as entities
import math
import random
import re
import time
from collections import Counter

import pyarrow.parquet as pq

from hexflow.llm.html_extract import extract, main_text, parse, style_nodes

PAGES = [
    ("<nav>menu</nav><article><h1>T</h1><p>a <b>b\n c</b>d<br>e</p><aside>x</aside><div class='share-buttons'>s</div></article><footer>f</footer>", "T a b cd e"),
    ("<body><header>site</header><main><p>one<p>two &amp; &eacute;&#x41;</main><form>f</form>", "one two & éA"),
    ("<article><header><h1>Kept</h1></header><p>body</p><article class=comment>no</article></article>", "Kept body"),
    ("<div><p>no article</p><!-- c --><script>var t='</p>'</script><div id='cookie-notice'>c</div></div>", "no article"),
    ("<article>cut off <b>here</b> &am", "cut off here &am"),
    ("<article>cut tag</artic", "cut tag"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p>unclosed <!-- comment", "unclosed"),
    ("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>", "a b x y z"),
    ("", ""),
    (None, ""),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
    ("<p>x&nbsp;y</p>", "x y"),
]


def test_pages():
    for page, want in PAGES:
        assert main_text(parse(page or "")) == want, page


def test_repeated_branches_of_a_host_go(spark):
    rows = [(i, "http://s.example/p", f"<article><p>text {i}</p><div class='x7'>Read our daily digest</div></article>") for i in range(6)]
    rows += [(10 + i, f"http://t{i}.example/p", "<article><p>text</p><div class='x7'>stays here</div></article>") for i in range(2)]
    rows += [(20 + i, "http://u.example/p", f"<div class='k1'>Site line</div><div class='k2'><p>own words {i}</p></div>") for i in range(5)]
    rows += [(30, None, None), (31, "http://v.example", "<article><div class='q'>same copy</div></article>"), (32, "http://v.example", "<article><div class='q'>same copy</div></article>")] + [(33 + i, "http://v.example", "<article><div class='q'>same copy</div></article>") for i in range(4)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.id: r.text for r in extract(pages).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert got[10] == got[11] == "text stays here" and [got[20 + i] for i in range(5)] == [f"own words {i}" for i in range(5)]
    assert got[30] == "" and got[31] == got[36] == "same copy"  # copies of one page are one page
    assert extract(pages.limit(0)).count() == 0


def test_given_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        inner = page.partition("<article>")[2].partition("</article>")[0]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*(?:>|$)", " ", inner)).split())
        assert main_text(parse(page)) == want


def test_near_copies_keep_their_article(spark):
    body = " ".join(f"word{i}" for i in range(60))
    bare = [(i, "http://m.example", f"<nav>menu {i}</nav><article class='post'><div class='text'><p>{body}</p></div></article><div class='ad'>{i}</div>") for i in range(6)]
    with_line = [(10 + i, "http://n.example", f"<main><section class='text'><p>{body}</p></section><p>line {i}</p><div class='x7'>Read our digest</div></main>") for i in range(6)]
    only = [(30 + i, "http://p.example", f"<div class='k1'>same words</div><p>{i if i else ''}</p>") for i in range(6)]
    pages = spark.createDataFrame(bare + with_line + only, "page_id long, url string, html string")
    got = {r.id: r.text for r in extract(pages).collect()}
    assert all(got[i] == body for i in range(6))
    assert all(got[10 + i] == f"{body} line {i}" for i in range(6))  # the short repeated branch still goes
    assert all(got.values())
    assert got[30] == "same words" and got[31] == "1"


def test_deep_nesting_stays_linear():
    deep = "<article>" + "<div class='c'>" * 50_000 + "deep</x>" + "</div>" * 50_000 + "<p>end" + "</b>" * 50_000 + "</article>"
    began = time.time()
    root = parse(deep)
    assert main_text(root) == "deep end" and len(style_nodes(root)) == 50_003
    assert time.time() - began < 20


def random_page(r, host):
    part = lambda cls, words: f"<div class='{cls}'>{words}</div>"
    own = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    parts = [part("lead", f"<p>{own(12)}</p>" * r.randint(1, 3)), part("digest", "Read our daily digest"), part("rate", r.choice(["one", "two"]) + " stars"), part("mix", "<ul><li>a</li></ul>" + own(1)), f"<section>{part('inner', 'same in all')}<p>{own(4)}</p></section>"]
    r.shuffle(parts)
    return f"<{host}>" + "".join(parts[: r.randint(3, 5)]) + f"</{host}>"


def test_equals_brute_force_and_the_tree_decides(spark):
    r = random.Random(5)
    rows = [(i, f"http://h{i % 2}.example/x", random_page(r, "article" if i % 2 else "body")) for i in range(60)]
    entropies = {}
    for h in (0, 1):
        seen = {}
        for page in {p for i, _, p in rows if i % 2 == h}:
            root = parse(page)
            for path, (shown, content) in style_nodes(root).items():
                seen.setdefault(path, set()).add((shown, content, main_text(root)))
        entropies[h] = {}
        for path, found in seen.items():
            n = len(found)
            if n >= 4:
                sides = [Counter(f[k] for f in found) for k in (0, 1)]
                e = [-sum(c / n * math.log(c / n, n) for c in s.values()) for s in sides]
                entropies[h][path] = (e[0], len(sides[0]), e[1])
    want = {i: main_text(parse(page), entropies[i % 2]) for i, _, page in rows}
    got = {x.id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    without = {i: main_text(parse(page)) for i, _, page in rows}
    assert sum(got[i] != without[i] for i in got) > 50  # what the tree takes away
    assert not any("digest" in t or "stars" in t or "same in all" in t for t in got.values())
    assert all(set(re.findall(r"w\d+", without[i])) == set(re.findall(r"w\d+", got[i])) for i in got)
