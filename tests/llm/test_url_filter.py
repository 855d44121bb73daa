import time

import pytest

from wayline.llm.url_filter import RULES, Rule, UrlTrie, filter_urls

CASES = [
    (1, "https://Blog.X.Example.COM/en/712?x=/de/", "blog.x.example.com", "/en/712", "example.com/en/7", "allow"),
    (2, "http://a.com/en/812", "a.com", "/en/812", "com/en/", "block"),
    (3, "http://com/en/", "com", "/en/", "com/en/", "block"),
    (4, "http://notcom/en/", "notcom", "/en/", None, "allow"),
    (5, "http://example.net/de/8#top", "example.net", "/de/8", "example.net/de/8", "block"),
    (6, "http://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"),
    (7, None, "", "", None, "allow"),
    (8, "", "", "", None, "allow"),
    (9, "no scheme", "", "", None, "allow"),
    (10, "x://org", "org", "", None, "allow"),
    (11, "x://a.org?/es/", "a.org", "", None, "allow"),
    (12, "x://\n.org/es/\n://y", "\n.org", "/es/\n:", "org/es/", "block"),
    (13, "http://b.org/es", "b.org", "/es", None, "allow"),
]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_cases_by_trie_and_by_join(spark, limit):
    # row 12: the path runs on to the end over a second "://"
    rows = [(i, u, "old", 5) for i, u, *_ in CASES]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, Rule string, extra int")
    got = sorted(map(tuple, filter_urls(pages, RULES, max_trie_chars=limit).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    want = [(i, h, p if i != 12 else "/es/\n://y", r, v) for i, _, h, p, r, v in CASES]
    assert got == sorted(want + want[:1], key=str)


def test_precedence_ties_and_empty(spark):
    rules = [Rule("allow", "a.b", "/x"), Rule("block", "a.b", "/x"), Rule("block", "b", "/x/y/z"), Rule("allow", "c", "")]
    pages = spark.createDataFrame([(1, "h://a.b/x/y/z"), (2, "h://q.b/x/y/zz"), (3, "h://c")], "page_id long, url string")
    for limit in (10**6, 0):
        out = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, rules, max_trie_chars=limit).collect()}
        assert out == {1: ("a.b/x", "block"), 2: ("b/x/y/z", "block"), 3: ("c", "allow")}
        assert filter_urls(pages.limit(0), rules, max_trie_chars=limit).count() == 0
        assert {r["verdict"] for r in filter_urls(pages, [], default="block", max_trie_chars=limit).collect()} == {"block"}


def test_very_long_segments_and_many_segments(spark):
    rules = [*RULES, Rule("block", "long.org", "/" + "a" * 5000), Rule("allow", "long.org", "/x/x/x/x")]
    paths = ["/en/" + "b" * 2_000_000, "/" + "a" * 2_000_000, "/" + "a" * 4999, "/x" * 20_000, "/x/x/x"]
    trie = UrlTrie(rules)
    begin = time.process_time()
    got = [trie.match("w.long.org", p) for p in paths] + [trie.match("b.com", paths[0])]
    assert time.process_time() - begin < 0.1
    assert [g and g[1] for g in got] == [None, "block", None, "allow", None, "block"]
    rows = [(k, f"h://w.long.org{p}") for k, p in enumerate(paths)] + [(5, f"h://b.com{paths[0]}"), (6, "h://" + "q." * 5000 + "long.org/x/x/x/x1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {k: (g[1] if g else "allow") for k, g in enumerate(got)} | {6: "allow"}
    for limit in (10**6, 0):
        out = {r["page_id"]: r["verdict"] for r in filter_urls(pages, rules, max_trie_chars=limit).select("page_id", "verdict").collect()}
        assert out == want
