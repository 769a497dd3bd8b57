import pytest

from lexmill.llm.boosting import BoostedTrees
from lexmill.llm.queries import QUERIES, URL_RULES
from lexmill.llm.url_filter import Rules, UrlModel, filter_urls, split_url


@pytest.mark.parametrize("url,want", [(None, ("", "")), ("no scheme", ("", "")), ("HTTP://A.Com/B?c#d", ("a.com", "/B")), ("x://h?q", ("h", "")), ("x://h#f/p", ("h", "")), ("://", ("", "")), ("a://b://c/d", ("b:", "//c/d"))])
def test_split(url, want):
    assert split_url(url) == want


@pytest.mark.parametrize("host,path,want", [("example.org", "/es/1", "example.org/es/"), ("x.org", "/es/", "org/"), ("m.example.org", "/en/12", "example.org/en/1"), ("borg", "/", None), ("a.com", "/fr/x", "com/fr/"), ("com", "/de/", "com/de/"), ("a.net", "/", None), ("", "", None), ("org", "", None)])
def test_rules(host, path, want):
    assert Rules(URL_RULES).match(host, path)[0] == want


def test_query_matches_rules_and_learns(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_url_filter"](spark, sf).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(urls)
    rules = Rules(URL_RULES)
    for r in got:
        assert (r.host, r.path) == split_url(urls[r.page_id])
        rule, verdict = rules.match(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    held = [r for r in got if r.rule]
    assert sum((r.score >= 0.5) == (r.verdict == "block") for r in held) >= 0.95 * len(held)


def test_held_out_labels():
    urls = [f"http://{'cheap-pills' if i % 3 == 0 else 'news'}{i % 7}.example.net/{'x/' * (i % 4)}{i}?a={i}" for i in range(400)]
    y = [int(i % 3 == 0) for i in range(400)]
    p = UrlModel(urls[:300], y[:300]).predict(urls[300:])
    assert sum((a >= 0.5) == b for a, b in zip(p, y[300:], strict=True)) >= 95


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "r"), (2, "", "r"), (2, "", "r"), (None, "http://a.org/", "r"), (3, "http://" + "a" * 50_000 + ".net/é", "r")], "page_id long, url string, RULE string")
    got = filter_urls(df, URL_RULES).collect()
    assert len(got) == 5 and {r.verdict for r in got} == {"allow"}
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
    marks = spark.createDataFrame([("http://b.net/1", 1), (None, 1), ("http://b.net/2", None)], "url string, blocked int")
    assert {r.verdict for r in filter_urls(df, [], marks).collect()} == {"block"}
    assert len(BoostedTrees().predict(UrlModel(["x://a.b/c"], [0]).predict([]).reshape(0, 1))) == 0
