"""Url filters: cascades against sets, rules against brute force, odd input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideloom.llm import url_filters


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


@pytest.mark.parametrize(("listed", "others"), [(0, 50), (1, 3000), (40, 40), (900, 4000), (500, 0)])
def test_cascade_is_exact(spark, listed, others):
    inside, outside = [f"in{i}.example" for i in range(listed)], [f"out{i}.example" for i in range(others)]
    universe = keys(spark, [*inside, *outside, *inside[:5], None])
    cascade = url_filters.Cascade.of(keys(spark, [*inside, *inside[:3], "not in the universe", None]), universe)
    found = {r.key: r.hit for r in universe.withColumn("hit", cascade.contains(F.col("key"))).collect()}
    assert found == dict.fromkeys(inside, True) | dict.fromkeys(outside, False) | {None: False}
    if listed == 900:
        # A plain set of 64-bit hashes would take eight bytes a key.
        assert len(cascade.levels) > 3 and cascade.bytes < 2 * listed


def test_parts_of_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Ex.ORG", "http://a.b?q=/x", "https://A.b/P/Q?x#y", "x://h#f/g", "s://h/p#a?b", "a://b://c/d", "s://ÄX.de/Ä", "s://h:80/a\nb"]
    host, path = url_filters.parts()
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(host.alias("h"), path.alias("p")).collect()
    assert [(r.h, r.p) for r in rows] == [
        ("", ""), ("", ""), ("", ""), ("", ""), ("www.ex.org", ""), ("a.b", ""), ("a.b", "/P/Q"), ("h", ""), ("h", "/p"), ("b:", "//c/d"), ("Äx.de", "/Ä"), ("h:80", "/a\nb"),
    ]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/fr", "block"), ("x.io", "", "block"), ("x.io", "/ok", "allow"), (None, "/", "block"), ("q.io", "/", "allow"), ("q.io", "/", "block")]
LISTED = ["bad.io", "deep.bad.com", None, ""]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h.count("."), h + p, v) for h, p, v in RULES if h and under(h) and path.startswith(p)]
    if fits:
        best = max(fits)[:3]
        return host, path, best[2], "allow" if (*best, "allow") in fits else "block"
    return host, path, None, "block" if any(h and under(h) for h in LISTED) else "allow"


@pytest.mark.parametrize("most", [url_filters.MOST_BYTES, 0])
def test_judged_by_brute_force(spark, most):
    hosts = ["net", "example.net", "a.example.net", "badexample.net", "example.com", "w.example.com", "org", "a.b.org", "c.a.b.org", "x.io", "y.x.io", "bad.io", "w.bad.io", "notbad.io", "deep.bad.com", "bad.com", "q.io", "", "."]
    paths = ["", "/", "/en", "/en/", "/en/1?x", "/de/2#y", "/fr/", "/fr", "/ok/z", "?a/", "#/en/", "/" * 3000]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.net/en/", "HTTPS://Example.NET/EN/", "http://" + "a." * 5000 + "bad.io/x"]
    urls += ["http://example.net/en/"] * 200  # a hot key
    rows = list(enumerate(urls)) + [(0, urls[0]), (None, "http://bad.io")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("key", "host", "rule", "__n", "__rules", "__allow", "__at", "html"):
        pages = pages.withColumn(name, F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(h,) for h in LISTED], "host string")
    found = url_filters.judged(pages, rules, listed, most_bytes=most).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((i, *by_hand(u)) for i, u in rows), key=key)


def test_empty_tables_and_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("a.b",)], "host string")
    assert url_filters.judged(pages.where("false"), rules, listed).count() == 0
    assert [tuple(r) for r in url_filters.judged(pages, rules.where("false"), listed).collect()] == [(1, "a.b", "/c", None, "block")]
    assert [tuple(r) for r in url_filters.judged(pages, rules, listed.where("false")).collect()] == [(1, "a.b", "/c", None, "allow")]
