import pytest

from berthline.llm import url_filter
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def check_rules(urls, got):
    for r in got:
        host, path = split(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_query_follows_the_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = LLM_QUERIES["op1_url_filter"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    check_rules(urls, got)


@pytest.fixture(scope="module")
def pages(spark):
    text = "<p>" + "cheap pills garden tools house flowers water summer winter " * 5 + "</p>"
    urls = [
        "http://cheappills.example.net/x", "http://gardentools.example.net/x", "HTTP://Sub.EXAMPLE.org/es/1?x=1#y",
        "http://example.org/en/12", "http://notexample.org/es/", "http://example.org", "http://a.com/fr/x", "http://a.com/frx",
        "http://a.com/de/", "no scheme", "", None, "x://", "http://a.com?q=/fr/", "http://a.com#/de/", "http://ä.com/de/z",
        "http://a.com/fr/x", "http://a.com/fr/x", "http://" + "z" * 5000 + ".net/" + "cheappills" * 300,
    ]
    return spark.createDataFrame([(i, u, text) for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def test_hosts_paths_and_longest_rules(pages):
    urls = {r.page_id: r.url for r in pages.collect()}
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(urls)
    check_rules(urls, got)


def test_concatenated_words_are_split_and_scored(pages):
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert got[0].verdict == "block" and got[1].verdict == "allow"
    assert got[18].verdict == "block"
    assert got[9].verdict == "allow" and got[11].verdict == "allow"


def test_segmentation(spark):
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("pill", 45), ("s", 5), ("ch", 2), ("eap", 2)], "word string, n bigint")
    pieces = spark.createDataFrame([("cheappills",), ("pillsqq",), ("x",)], "piece string")
    got = {r.piece: r.words for r in url_filter.segment(pieces, counts, 144).collect()}
    assert got["cheappills"] == ["cheap", "pills"] and got["pillsqq"][0] == "pills" and got["x"] == ["x"]


def test_words_and_stretches_of_any_length(spark):
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    counts = spark.createDataFrame([("garden", 50), ("casino", 40), (word, 3)], "word string, n bigint")
    whole = ["garden" * 10 + "casino", "garden" + word + "casino", "q" * 200 + "casino" + "z" * 90]
    got = {r.piece: r.words for r in url_filter.segment(spark.createDataFrame([(w,) for w in whole], "piece string"), counts, 93).collect()}
    assert got[whole[0]] == ["garden"] * 10 + ["casino"] and got[whole[1]] == ["garden", word, "casino"]
    assert got[whole[2]] == ["q" * 200, "casino", "z" * 90]


def test_a_blocked_word_late_in_a_long_stretch_counts(spark):
    text = "<p>" + "garden tools house flowers casino water " * 20 + "</p>"
    urls = ["http://a.net/" + "garden" * 10 + "casino", "http://a.net/" + "garden" * 10 + "/casino", "http://a.net/" + "garden" * 10]
    df = spark.createDataFrame([(i, u, text) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [got[i].verdict for i in range(3)] == ["block", "block", "allow"]
    assert got[0].log_odds == got[1].log_odds


def test_clashing_columns_and_empty_tables(pages):
    clash = pages.selectExpr("*", "url AS host", "url AS path", "url AS word", "url AS verdict", "page_id AS n", "url AS _url")
    assert url_filter.filter_urls(clash).count() == pages.count()
    assert url_filter.filter_urls(pages.filter("1 = 0")).count() == 0
    assert url_filter.filter_urls(pages.selectExpr("page_id", "url", "CAST(NULL AS string) AS html")).count() == pages.count()
