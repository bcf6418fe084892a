import re

import pytest

from siftwell.llm import url_filter as U

URLS = [
    None, "", "no scheme.org/", "http://x.ORG/", "https://x.org", "http://org/a", "http://notorg/a", "http://example.org/es/1?x=1",
    "http://m.example.org/en/12", "http://example.org/en/2", "http://Example.ORG/ES/1", "https://a.com/fr/", "https://a.com/de/#x",
    "https://a.com/de", "https://a.com?/de/", "https://a.com#/fr/", "x://y://z.org/p", "http://wide.é.com/fr/ü", "http:///fr/",
    "http://a.com/fr/\nline", "http://z.net/1/2/3.html?a=1&b=2#c",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


@pytest.fixture(scope="module")
def learned(spark, data):
    return U.train_url_filter(spark.read.parquet(f"{data}/pages.parquet"))


def test_rules_equal_brute_force(spark, learned):
    got = U.judge_urls(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), filter_=learned).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path, rule, verdict = plain(row.url)
        assert (row.host, row.path, row.rule) == (host, path, rule), row.url
        assert row.verdict == (verdict or (U.BLOCK if row.block_score > 0.5 else U.ALLOW))
        assert 0 <= row.block_score <= 1


def test_trees_learn_what_the_rules_label(spark, data, learned):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = [r for r in U.judge_urls(pages, filter_=learned).collect() if r.rule]
    right = sum((r.block_score > 0.5) == (r.verdict == U.BLOCK) for r in rows)
    assert len(rows) > 10 and right / len(rows) > 0.85


def test_features():
    row = dict(zip(U.FEATURES, U.lexical("https://a-b.c.com/x/12.html?p=1&q=&=#f", "a-b.c.com", "/x/12.html")))
    assert row["depth"] == 2 and row["labels"] == 3 and row["digits"] == 3 and row["parameters"] == 3
    assert row["has_fragment"] and row["extension"] and row["secure"] and row["hyphens"] == 1 and row["longest_part"] == 7
    assert U._entropy("aabb") == 1 and U._entropy("") == 0
    assert len(U.lexical(None, "", "")) == len(U.FEATURES)


def test_odd_rows(spark, learned):
    schema = "page_id long, url string, host int, rule string, url_features int, url_raw int, extra string"
    pages = spark.createDataFrame([(1, None, 1, "r", 2, 3, "e"), (1, None, 1, "r", 2, 3, "e"), (2, "http://a.org/" + "x" * 100_000, 1, None, 2, 3, None)], schema)
    got = U.judge_urls(pages, filter_=learned)
    assert got.columns == ["page_id", "url", "url_features", "url_raw", "extra", "host", "path", "block_score", "rule", "verdict"]
    rows = got.orderBy("page_id").collect()
    assert [r.rule for r in rows] == [None, None, "org/"] and rows[0].block_score == rows[1].block_score
    empty = pages.where("false")
    assert U.judge_urls(empty).collect() == []
    one_kind = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(one_kind).collect()} == {U.ALLOW}
