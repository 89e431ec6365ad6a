from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from codegauge.llm import url_filter

LINKS = [
    ("http://a.org", "page.html"), ("http://a.org/x/y.html?q=1", "?id=3"), ("http://a.org/x/y.html?q=1", "#top"), ("http://a.org/x/y.html", "../z"), ("http://a.org/x/y.html", "./"), ("http://a.org/x/y/w", "../../../up/./b/.."),
    ("http://A.org:80/x", "https://B.org:443/é?a=1&amp;b=2#f"), ("https://a.org/x", "//c.org:443/d"), ("http://a.org/x", "/p&#x2F;q&#47;r"), ("http://a.org:8080/x/", "y?u=/../v"), ("http://a.org/x", "http://d.org"), ("http://a.org/a/../b/./c", "d"),
]


def plain(url):
    import html
    import posixpath

    u = urlsplit(html.unescape(url))
    port = {"http": ":80", "https": ":443"}[u.scheme]
    path = u.path
    if "/." in path:
        path = posixpath.normpath(path) + ("/" if path.endswith(("/", "/.", "/..")) else "")
    return u.netloc.lower().removesuffix(port) + path + (f"?{u.query}" if u.query else "")


@pytest.mark.parametrize("tag", ['<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0; url={}">'])
def test_links_resolve_as_a_browser_does(spark, tag):
    import html

    rows = [(i, url, tag.format(to)) for i, (url, to) in enumerate(LINKS)]
    got = sorted(map(tuple, url_filter.page_links(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()))
    assert got == sorted((plain(u), plain(urljoin(u, html.unescape(t)))) for u, t in LINKS)


def test_targets_that_are_no_pages(spark):
    rows = [(1, "http://a.org/x", '<link rel=canonical href="mailto:me@a.org">'), (2, "http://a.org/x", '<link rel=canonical href="javascript:go()">'), (3, None, '<link rel=canonical href="/y">'), (4, "a.org/x", '<link rel=canonical href="/y">'), (5, "http://a.org/x", '<link rel=canonical href="">')]
    assert url_filter.page_links(spark.createDataFrame(rows, "page_id int, url string, html string")).count() == 0


def test_code_for_links_compiles(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<link rel=canonical href=y>")], "page_id int, url string, html string")
    code = url_filter.page_links(pages)._jdf.queryExecution().debug().codegenToSeq()
    sizes = [code.apply(i)._2() for i in range(code.size())]
    assert all(len(s) < 200_000 for s in sizes) and url_filter.page_links(pages).select(F.count("*")).first()[0] == 1
