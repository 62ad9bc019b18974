"""Hosts, paths and rules against plain Python; templates on a fixture."""

import re

import pytest

from tessella.llm import urls
from pyspark.sql import functions as F


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for kind, rule in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


URLS = [
    None, "", "example.com/en/", "http://", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/1", "http://a.example.com/en/",
    "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/fr", "http://xnet/es/1", "a://b://c.com/d", "http://com/x", "http://é.COM/É", "http://x.net?/es/", "http://x.net#/es/", "http://x.org/en/1\n2",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    labels = spark.createDataFrame([], "key long, label int")
    for r in urls.judge_urls(df, labels).collect():
        host, path, best = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == (best[0] if best else "allow")


@pytest.mark.parametrize(("segment", "shape"), [("123", "{n}"), ("18815.html", "{n}.html"), ("deadbeef01", "{h}"), ("some-title", "{w}"), ("", "")])
def test_shape(spark, segment, shape):
    assert spark.range(1).select(urls.shape_of(F.lit(segment))).first()[0] == shape


def test_bad_templates_go_and_like_branches_merge(spark):
    rows, labels = [], []
    for i in range(400):
        kind = ("good", "fine", "bad")[i % 3]
        rows.append((i, f"http://site.org/{kind}/{i}"))
        labels.append((i, int(kind == "bad")))
    rows.append((999, "http://site.org/bad/999"))
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "key long, label int")).collect()}
    assert all(out[i]["verdict"] == ("block" if i % 3 == 2 else "allow") for i in range(400))
    assert out[999]["verdict"] == "block" and out[2]["template"] == "/bad/{n}"
    assert all(0 <= r["purity"] <= 1 for r in out.values())


def test_query_rows(spark, sf):
    got = urls.op1_urls(spark, sf).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path, best = brute(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]) and (best is None or r["verdict"] == best[0])
