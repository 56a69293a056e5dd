"""URL rules: splitting, the index against trying every rule, and odd rows."""

import re

import pytest

from tabweave.llm.queries import PATTERNS, SITES
from tabweave.llm.url_rules import PatternRule, SiteRule, filter_urls, rarest_token_index, split_url


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("http://EXAMPLE.org", "example.org", ""),
        ("http://a.B/p/Q?x#y", "a.b", "/p/Q"), ("x://É.de#t/u", "É.de", ""), ("http://a?b/c", "a", ""), ("a://b://c/d", "b:", "//c/d"),
    ],
)
def test_split(url, host, path):
    assert split_url(url) == (host, path)


def test_tokens_are_whole():
    assert PatternRule("||blog.*^es/4").tokens() == ["blog", "es"]
    assert PatternRule("*abc*/de|").tokens() == ["de"]
    assert PatternRule("ab").tokens() == []
    assert PatternRule("|http://x").tokens() == ["http"]


def test_site_rules(spark):
    urls = ["http://a.example.org/es/1", "http://example.org/en/1x", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/",
            "http://x.net/de/", "http://org", "HTTP://A.ORG/", "http://example.org/en/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, [], SITES).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"),
        (None, "allow"), (None, "allow"), ("org/", "allow"), ("org/", "allow"),
    ]


def brute(url, rules):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hits = [r for r in map(PatternRule, rules) if re.search(r.regex, text, re.S)]
    best = [r for r in hits if r.allows] or hits
    return ("allow" if not best or best[0].allows else "block"), (best[0].text if best else None)


def test_index_finds_what_every_rule_finds(spark):
    rules = [*PATTERNS, "ref=", "^7*^", "||example^", "@@^7^|", "/en/*?page=2|", "é"]
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "http://x/é"), (-4, "http://a.example.com/" + "y/" * 5000 + "login/"), (-4, "http://b.c/7"), (None, "http://d/7/")]
    df = df.union(spark.createDataFrame(odd, "page_id bigint, url string"))
    want = sorted((repr(r.page_id), *brute(r.url, rules)) for r in df.collect())
    got = sorted((repr(r.page_id), r.verdict, r.pattern) for r in filter_urls(df, rules).collect())
    assert repr(got) == repr(want)
    assert {v for _, v, _ in want} == {"allow", "block"}


def test_rules_lie_under_their_rarest_token():
    rules = [PatternRule("^common^rare^"), PatternRule("*x*")]
    assert rarest_token_index(rules, {"common": 9, "rare": 1}) == ({"rare": [0]}, [1])


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "h", "v")], "page_id int, url string, host string, key string")
    assert filter_urls(df, ["^x^"], [SiteRule("org", "/", "allow")]).collect()[0].asDict()["host"] == "a.org"
    assert filter_urls(df.limit(0), ["^x^"]).count() == 0
    assert filter_urls(df, [], default="block").collect()[0].verdict == "block"
