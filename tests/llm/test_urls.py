import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexflow.llm import urls

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net", "http://example.net/", "http://net/", "ftp://x.org/fr/", "http://x.org/fr", "http://notexample.net/en/", "http://m.example.com/de/1", "http://m.example.com/de", "http://?q", "http://h#f://g/", "a://b://c/d", "http://é.org/fr/ü"]


def host_path(u):
    rest = (u or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, text string")
    got = {r.id: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path = host_path(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert got[0].verdict == got[1].verdict == got[2].verdict == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


def test_the_ratio_separates_held_out_urls(spark):
    r = np.random.default_rng(0)
    good = [f"http://{r.choice(['news', 'blog', 'wiki'])}.org/fr/{r.integers(1e6)}" for _ in range(150)]
    bad = [f"http://{r.choice(['casino', 'pills', 'winbig'])}.net/zz{r.integers(1e6)}" for _ in range(150)]
    open_ = [(f"http://wiki{i}.edu/fr/{i}", "allow") for i in range(20)] + [(f"http://casino{i}.edu/zz{i}", "block") for i in range(20)]
    pages = spark.createDataFrame(list(enumerate([*good, *bad, *(u for u, _ in open_)])), "page_id long, url string")
    got = {x.id: x for x in urls.judge(pages).collect()}
    assert all(got[300 + i].rule is None and got[300 + i].verdict == v for i, (_, v) in enumerate(open_))


class Plain:
    """The recursion in plain Python over exact counts."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            data = bytes(urls.ORDER) + t.encode()
            for j in range(urls.ORDER, len(data)):
                for k in range(urls.ORDER + 1):
                    self.n.setdefault(data[j - k : j], Counter())[data[j]] += 1

    def chance(self, before, byte):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            own = self.n.get(before[len(before) - k :])
            if own is None:
                break
            p = (own[byte] + len(own) * p) / (sum(own.values()) + len(own))
        return p

    def log(self, text):
        data = bytes(urls.ORDER) + text.encode()
        return sum(math.log(self.chance(data[j - urls.ORDER : j], data[j])) for j in range(urls.ORDER, len(data)))


@pytest.mark.parametrize(("letters", "n"), [("abcé/.-1", 60), ("abcdefghijklmnopqrstuvwxyz0123456789é/.-", 9000)])
def test_likelihoods_equal_the_plain_recursion(spark, letters, n):
    r = random.Random(3)
    sides = [["".join(r.choices(letters, k=r.randint(0, 12))) for _ in range(n)] for _ in (0, 1)]
    rows = [(t, c, 1) for c in (0, 1) for t in sides[c]] * 2
    model = urls.learn(spark.createDataFrame(rows, "text string, rejected int, fold int").repartition(4))
    plain = [Plain(sides[c] * 2) for c in (0, 1)]
    assert n < 1000 or min(len(x.n) for x in plain) > 50_000  # every context is held
    probe = ["abc", "", "zz/é", "a" * 40, *sides[0][:5]]
    got = model.difference(pa.array(probe))
    for t, x in zip(probe, got, strict=True):
        assert math.isclose(x, (plain[1].log(t) - plain[0].log(t)) / max(1, len(t.encode())), abs_tol=1e-9)
    assert math.isclose(sum(plain[0].chance(b"\0abc", x) for x in range(256)), 1)


def test_the_sample_is_bounded_and_weighted(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 30)
    rows = [(f"u{i}", 0, 1) for i in range(100)] + [("hot", 0, 1)] * 500 + [("kept out", 0, 0), ("other", 1, 1)]
    df = spark.createDataFrame(rows, "text string, rejected int, fold int").repartition(4)
    got = {r.text: r.n for r in urls.sampled(df, 0).collect()}
    assert len(got) == 30 and "kept out" not in got and "other" not in got and got.get("hot", 500) == 500
    monkeypatch.setattr(urls, "SAMPLE_BYTES", 20)
    assert sum(len(t) for t in {r.text for r in urls.sampled(df, 0).collect()}) <= 20


def test_every_ruled_url_is_counted(spark, monkeypatch):
    """Whatever ``sampled`` is bounded to, and each repeat of a URL."""
    monkeypatch.setattr(urls, "SAMPLE", 3)
    monkeypatch.setattr(urls, "SAMPLE_BYTES", 20)
    sides = [[f"news.org/fr/{i}" for i in range(40)] + ["hot"] * 30, [f"casino.net/{i}" for i in range(40)]]
    model = urls.learn(spark.createDataFrame([(t, c, 1) for c in (0, 1) for t in sides[c]], "text string, rejected int, fold int").repartition(4))
    plain = [Plain(x) for x in sides]
    probe = ["hot", "news.org/fr/39", "casino.net/17"]
    for t, x in zip(probe, model.difference(pa.array(probe)), strict=True):
        assert math.isclose(x, (plain[1].log(t) - plain[0].log(t)) / len(t), abs_tol=1e-9)


def test_held_out_rules_are_told_apart(spark):
    """Of the URLs that a rule judges, a third trains no model: the ratio must tell them apart."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    ruled = pages.select(host.alias("host"), path.alias("path"), F.expr("lower(substring_index(url, '://', -1))").alias("text")).withColumn("v", urls.rule_of(F.col("host"), F.col("path"))[1]).where("v is not null")
    ruled = ruled.select("text", (F.col("v") == "block").cast("int").alias("rejected"), F.pmod(F.crc32("text"), F.lit(15)).alias("k")).withColumn("fold", F.col("k") % 5)
    model = urls.learn(ruled.where("k < 10"))
    out = urls.differences(ruled.where("k >= 10"), model, "rejected").withColumn("said", (F.col("difference") > model.threshold).cast("int")).groupBy("rejected", "said").count().collect()
    n = {(x.rejected, x.said): x["count"] for x in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.9, n
