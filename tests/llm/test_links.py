"""Relative links of pages, against urllib."""

from urllib.parse import urljoin

from kinledger.llm import urlfilter
from pyspark.sql import functions as F

BASES = ["http://a.org", "http://a.org/", "http://a.org/x/y.html?q=1/2", "http://a.org/x/y/", "http://a.org/x?u=/z/"]
LINKS = ["next.html", "../a", "../../../a/b", "./", "..", ".", "?id=2", "a/./b/../c?x=../y", "/r/../s", "//b.org/t", "http://c.org/u", "d/e/"]


def test_relative_links_are_resolved(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(rows, "url string, to string").select("url", "to", urlfilter.resolved(F.col("url"), F.col("to")).alias("got")).collect()
    assert [(r.url, r.to, r.got) for r in got if r.got != urljoin(r.url, r.to)] == []


def test_blocks_reach_relative_aliases(spark):
    link = '<link rel=canonical href="{}">'
    rows = [(1, "http://b.net/es/x", link.format("../a")), (2, "http://b.net/a", ""), (3, "http://b.net/c", link.format("?id=2")), (4, "http://b.net/c?id=2", '<meta http-equiv="refresh" content="0; url=es/q">'), (5, "http://b.net/d", link.format("mailto:x"))]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
