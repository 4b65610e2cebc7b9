"""Hosts, paths and identities of URLs that hold another URL, against an independent split."""

import pytest
from pyspark.sql import functions as F

from plinth.llm import urls


def split(url):
    rest = url.partition("://")[2].partition("#")[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path, query


def identity(url):
    host, path, query = split(url)
    kept = sorted(x for x in query.split("&") if x and not x.startswith(("ref=", "utm_source=")))
    return host.removeprefix("www.") + path.removesuffix("/") + ("?" + "&".join(kept) if kept else "")


URLS = ["http://a.com?u=http://b.org/fr/x", "http://a.com#http://b.org/fr/x", "http://a.com/p#x://y?z=1", "http://a.com#x://y?z=1", "http://www.a.com?u=1&ref=http://b.org/", "http://a.com/go/?u=http://b.org/fr/x#q://r/s?t", "x://y/http://z/w?v", "no scheme", "http://", "http://a.com/p/"]


def test_later_schemes_are_not_the_first(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    url = F.col("url")
    got = {r[0]: tuple(r)[1:] for r in df.select(url, urls.host_of(url), urls.path_of(url), urls.canonical(url)).collect()}
    assert got == {u: (*split(u)[:2], identity(u)) for u in URLS}


@pytest.mark.parametrize("url", URLS[:2])
def test_no_rule_fits_the_path_of_a_parameter(spark, url):
    listed = spark.createDataFrame([], "listed_url string")
    r = urls.judge(spark.createDataFrame([(url,)], "url string"), listed, [("block", "com", "/fr/")]).first()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.com", "", None, "allow")
