"""HTML extraction by site style trees.

Every page becomes a small DOM.  Pages of one host are merged into its style tree: elements with the same path
of presentations (tag and class) are one style node, whose path is kept as a hash.  Over the host's pages that have it, a
node has two entropies, as shares of the largest possible: of its child presentations (which sequences of
children pages give it) and of its content.  From 0, the same everywhere, to 1, never twice the same.  On a page, the
importance of an element without element children is its content's; that of another mixes its presentation's
with the mean of its parts by their length, the presentation weighing less the fewer forms it takes:
``(1 - FADE^forms) * presentation + FADE^forms * parts``.  Branches of low importance are template and go.

A page's own marks are the prior: parts that never belong to the article (nav, header and footer,
aside, form, advert, notice, comment) go whatever they hold, since their texts may vary from page to
page; plain paragraphs, headings and lists are never taken alone, since pages may quote each
other; a page that marks an article (or else a main part) gives that alone.  With fewer than
``LEAST_PAGES`` distinct main parts, the marks alone decide.  Importance never takes the marked part itself, its
dominant branch, or all of a page's text.

Statistics are per (host, node), counted with Spark from digests; only the nodes with an entropy below
``CLEAR`` come back, as an array per host, all others being of importance 1.

Defined results: null or empty html gives an empty text; a null url has the host ''.
Unclosed and stray tags are tolerated; an unclosed comment or raw-text element, or a tag
that the page's end cuts off, ends with the page.  Every page row gives one result row,
repeated rows included.  Memory grows with the page, not with its nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.urls import host_of

#: A node is judged once pages of so many distinct main parts of its host have it, and is template below this importance.
LEAST_PAGES, LEAST_IMPORTANCE = 4, 0.3
#: What a form of presentation leaves to the parts, and the entropy from which a node counts as of importance 1.
FADE, CLEAR = 0.9, 0.9
#: A branch of the marked part is dominant with so many characters, if they are half of the part's.
LEAST_BODY = 200
#: Keys that a host's pages are dealt over when they meet its template.
SALTS = 64

# Tags by how they take part in a page.
RAW = frozenset("script style noscript template svg iframe object canvas textarea select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr br header footer nav aside form fieldset dialog menu center".split())
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
PLAIN = frozenset("html body main article p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption br b i em strong span a code u s sub sup small q cite mark".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset input label option".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words in class or id that name a part outside the article.
OUTSIDE = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent notice gdpr popup modal newsletter subscribe subscription share sharing social comment comments reply replies discussion disqus related recommended widget toolbar masthead login search pagination pager copyright skip alert disclaimer paywall".split())
#: Words that do so unless the element stands within an article.
HEADING = frozenset("header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|!(?P<doctype>[^>]*)>?|\?[^>]*>?|/(?P<close>[A-Za-z][^\s/>]*)[^>]*>?|(?P<open>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An element: presentation, hash of the path of presentations, parts in page order (texts and nodes)."""

    tag: str
    shown: str
    path: int
    within: bool
    outside: bool
    plain: bool
    parts: list = field(default_factory=list)


def _presentation(tag: str, attrs: str, within: bool) -> tuple[str, bool]:
    """Tag and class, and whether the element stands outside the article by what it says of itself."""
    if not attrs or attrs.isspace():
        return tag, tag in DROPPED or tag == "header" and not within
    own = {m[1].lower(): _CAMEL.sub(r"\1-\2", m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    if not own:
        return tag, tag in DROPPED or tag == "header" and not within
    words = set(_PARTS.findall(own.get("class", "") + " " + own.get("id", "")))
    outside = tag in DROPPED or own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or tag == "header" and not within
    outside = outside or tag not in ("html", "body", "main") and bool(words & OUTSIDE) or not within and bool(words & HEADING) and tag in ("div", "section", "p", "ul", "table")
    return f"{tag}.{'.'.join(sorted(own['class'].split()))}" if own.get("class") else tag, outside


def parse(html: str) -> Node:
    """The page's DOM, without raw-text elements and comments."""
    root = Node("", "", 0, False, False, True)
    stack, at, n = [root], 0, len(html)
    held: Counter[str] = Counter()  # tags on the stack

    def text(raw: str) -> None:
        if raw:
            stack[-1].parts.append(unescape(raw))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TAG.match(html, lt)
        if not m:  # a bare sign, or a tag that the page's end cuts off
            if lt + 1 < n and (html[lt + 1].isalpha() or html[lt + 1] == "/") and html.find(">", lt) < 0:
                text(html[at:lt])
                break
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if m["close"]:
            name = m["close"].lower()
            for i in range(len(stack) - 1, 0, -1) if held[name] else ():
                if stack[i].tag == name:
                    _cut(stack, i, held)
                    break
                if stack[i].tag in ("article", "main", "table") and name not in ("body", "html") and name in ("p", "li", "b", "i", "span", "a"):
                    break
        elif m["open"]:
            name = m["open"].lower()
            if name in CLOSES_P:
                _close(stack, held, {"p"}, {"table", "td", "th", "button", "object"})
            if name in CLOSED_BY:
                _close(stack, held, CLOSED_BY[name], SCOPE[name])
            if name == "body":
                _close(stack, held, {"head"}, set())
            if name in RAW:
                if name == "head":
                    end = re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
                    at = at if end is None else end.end() if html[end.start() + 1] == "/" else end.start()
                elif not m["attrs"].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    at = n if end is None else end.end()
                continue
            above = stack[-1]
            shown, outside = _presentation(name, m["attrs"], above.within)
            path = int.from_bytes(blake2b(above.path.to_bytes(8) + shown.encode("utf-8", "surrogatepass"), digest_size=8).digest())
            node = Node(name, shown, path, above.within or name in ("article", "main"), outside, shown in PLAIN)
            above.parts.append(node)
            if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append(node)
                held[name] += 1
    return root


def _cut(stack: list[Node], i: int, held: Counter[str]) -> None:
    held.subtract(n.tag for n in stack[i:])
    del stack[i:]


def _close(stack: list[Node], held: Counter[str], names: set[str], scope: set[str]) -> None:
    if not any(held[x] for x in names):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            _cut(stack, i, held)
            return
        if stack[i].tag in scope or stack[i].tag in ("article", "section", "div", "main", "body") and "p" in names:
            return


def _walk(root: Node) -> list[Node]:
    """The nodes in page order, without those outside the article by presentation and what they hold."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.outside]
    return found


def _digest(parts) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), signed=True)


def style_nodes(root: Node) -> dict[int, tuple[int, int]]:
    """The page's style nodes: digests of their child presentations and of all text that they hold."""
    held: dict[int, bytes] = {}
    found: dict[int, list[tuple[bytes, bytes]]] = {}
    for node in reversed(_walk(root)):  # children before parents
        parts = [" ".join(p.split()).encode("utf-8", "surrogatepass") if isinstance(p, str) else held.get(id(p), b"") for p in node.parts]
        parts = [x for x in parts if x]
        held[id(node)] = blake2b(b"\0".join(parts), digest_size=12).digest() if parts else b""
        shown = " ".join(p.shown for p in node.parts if not isinstance(p, str))
        found.setdefault(node.path, []).append((shown.encode("utf-8", "surrogatepass"), held[id(node)]))
    return {path: (_digest(x for x, _ in reversed(own)), _digest(y for _, y in reversed(own))) for path, own in found.items()}


#: For each path: entropy of its child presentations, how many forms they take, entropy of its content.
Importance = dict[int, tuple[float, int, float]]


def importance(nodes: list[Node], known: Importance) -> tuple[dict[int, int], dict[int, float]]:
    """Characters and composite importance of a page's nodes, by their object ids; ``nodes`` in page order."""
    size: dict[int, int] = {}
    worth: dict[int, float] = {}
    for node in reversed(nodes):  # children before parents
        presented, forms, content = known.get(node.path, (1.0, 1, 1.0))
        total, weighed, inner = 0, 0.0, False
        for p in node.parts:
            if isinstance(p, str):
                n, own = sum(map(len, p.split())), content
            else:
                n, own, inner = size.get(id(p), 0), worth.get(id(p), 1.0), True
            total, weighed = total + n, weighed + n * own
        mean = weighed / total if total else content
        size[id(node)] = total
        worth[id(node)] = (1 - FADE**forms) * presented + FADE**forms * mean if inner else content
    return size, worth


def main_text(root: Node, known: Importance | None = None) -> str:
    """The page's kept blocks, joined by one space; ``known`` has the entropies of its host's style nodes."""
    nodes = _walk(root)
    tags = {n.tag for n in nodes}
    marked = next((t for t in ("article", "main") if t in tags), None)
    blocks: list[str] = []
    run: list[str] = []
    size, worth = importance(nodes, known) if known else ({}, {})

    def end() -> None:
        block = _SPACE.sub(" ", "".join(run)).strip()
        if block:
            blocks.append(block)
        run.clear()

    todo: list = [(root, marked is None, 0)]
    while todo:
        item, kept, whole = todo.pop()  # whole: characters of the marked part
        if item is None:
            end()
        elif isinstance(item, str):
            if kept:
                run.append(item)
        elif not item.outside:
            if kept and not item.plain and worth.get(id(item), 1.0) < LEAST_IMPORTANCE:
                own = size[id(item)]
                if not whole or own < LEAST_BODY or 2 * own < whole:
                    continue
            if not kept and item.tag == marked:
                kept, whole = True, size.get(id(item), 0)
            if item.tag in BLOCK:
                end()
                todo.append((None, False, 0))
            todo += [(p, kept, whole) for p in reversed(item.parts)]
    end()
    return " ".join(blocks) if blocks or not known else main_text(root)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, nodes``: path, entropies and forms of each host's style nodes that are not clearly important."""
    given = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def nodes(batches):
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(html or "")
                page = _digest([main_text(root).encode("utf-8", "surrogatepass")])
                rows += [(host, path - (1 << 63), shown, content, page) for path, (shown, content) in style_nodes(root).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "path", "shown", "content", "page"])

    each = given.mapInArrow(nodes, "host string, path long, shown long, content long, page long").distinct()
    same = each.groupBy("host", "path", "shown", "content").agg(F.count("*").alias("n"))
    # each entropy needs its own sums: a node's pages by child presentations, and by content
    sides = same.select("host", "path", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("shown").alias("v")), F.struct(F.lit(1).alias("side"), F.col("content").alias("v")))).alias("x"))
    sums = sides.groupBy("host", "path", "x.side", "x.v").agg(F.sum("n").alias("n"))
    stats = sums.groupBy("host", "path", "side").agg(F.sum("n").alias("pages"), F.count("*").alias("forms"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = (F.log2("pages") - F.col("nlogn") / F.col("pages")) / F.log2("pages")
    both = stats.where(F.col("pages") >= LEAST_PAGES).withColumn("entropy", entropy).groupBy("host", "path").agg(
        F.max(F.when(F.col("side") == 0, F.col("entropy"))).alias("shown"), F.max(F.when(F.col("side") == 0, F.col("forms"))).alias("forms"), F.max(F.when(F.col("side") == 1, F.col("entropy"))).alias("content")
    )
    low = both.where(F.least("shown", "content") < CLEAR)
    return low.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "shown", "forms", "content"))).alias("nodes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page row."""
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # a hot host's pages are dealt over many keys; its few paths go to each
    salted = given.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)))
    low = templates(pages, url_col, html_col).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = salted.join(low, ["host", "salt"], "left").drop("host", "salt")

    def scan(batches):
        last, known = None, {}
        for batch in batches:
            texts = []
            for i, html in enumerate(batch.column("html").to_pylist()):
                low = batch.column("nodes")[i]
                if low != last:  # pages of one host follow each other
                    last, known = low, {x["path"] + (1 << 63): (x["shown"], x["forms"], x["content"]) for x in low.as_py() or ()}
                texts.append(main_text(parse(html or ""), known))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = given.schema
    return both.mapInArrow(scan, f"id {kind['id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string")


def op2_style_tree(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
