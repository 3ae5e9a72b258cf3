import random
from collections import defaultdict

from sourcelake.llm.components import connected_components
from sourcelake.llm.queries import URL_RULES
from sourcelake.llm.url_filter import judge_urls

SCHEMA = "page_id bigint, url string, html string, key string, row string, host string, verdict string"


def rules(spark, more=()):
    return spark.createDataFrame([*URL_RULES, *more], "host string, path string, verdict string")


def canonical(url):
    return f'<head><link rel="canonical" href="{url}"></head>'


def refresh(url):
    return f"<meta http-equiv=refresh content='0; url={url}'>"


def judged(spark, pages, more=(), redirects=None):
    frame = spark.createDataFrame([(i, u, h, "k", "r", "h", "v") for i, u, h in pages], SCHEMA)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.reason) for r in judge_urls(frame, rules(spark, more), redirects).collect()), key=repr)


def test_rules(spark):
    got = judged(spark, [
        (1, "https://A.Example.com/en/x?q#f", ""), (2, "http://www.example.com/en/", None), (3, "http://x.net/es/1", ""), (4, "http://x.net/es", ""),
        (5, "http://b.com", ""), (6, "http://b.com/", ""), (7, None, None), (8, "mailto:x", ""), (9, "http://notexample.org/?a=://b.com/", ""), (9, "x://é.net#/fr/", ""),
    ])
    assert got == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block", "rule"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow", "rule"),
        (3, "x.net", "/es/1", "net/es/", "block", "rule"), (4, "x.net", "/es", None, "allow", "default"), (5, "b.com", "", None, "allow", "default"),
        (6, "b.com", "/", "com/", "allow", "rule"), (7, "", "", None, "allow", "default"), (8, "", "", None, "allow", "default"),
        (9, "notexample.org", "/", None, "allow", "default"), (9, "é.net", "", None, "allow", "default"),
    ], key=repr)


def test_aliases_carry_blocks_and_allows_come_first(spark):
    redirects = spark.createDataFrame([("http://r.org/1", "http://a.org/1"), (None, "http://a.org/1"), ("x", "http://a.org/1")], "from_url string, to_url string")
    got = {r[0]: r[4:] for r in judged(spark, [
        (1, "http://a.org/1", canonical("http://bad.net/es/1#top")), (2, "http://bad.net/es/1", ""), (3, "https://r.org/1", ""),
        (4, "http://c.org/1", refresh("https://d.org/x?y=1")), (5, "http://d.org/x?y=1", canonical("/z")), (6, "http://d.org/z", canonical("http://bad.net/fr/")),
        (7, "http://e.org/", canonical("//good.com/")), (8, "http://e.org", canonical("http://bad.net/es/2")), (12, "http://good.com/", ""),
        (9, "http://q.org/a/b", canonical("c")), (10, "http://q.org/a/c", ""), (11, "http://self.org/", canonical("http://self.org/")),
        (13, "http://bad.net/fr/", ""), (14, "http://bad.net/es/2", ""),
    ], redirects=redirects)}
    assert got == {
        1: ("block", "alias"), 2: ("block", "rule"), 3: ("block", "alias"), 4: ("block", "alias"), 5: ("block", "alias"), 6: ("block", "alias"),
        7: ("allow", "alias"), 8: ("allow", "alias"), 9: ("allow", "default"), 10: ("allow", "default"), 11: ("allow", "default"),
        12: ("allow", "rule"), 13: ("block", "rule"), 14: ("block", "rule"),
    }


def test_no_rows(spark):
    assert judged(spark, []) == []


def test_components_match_search(spark):
    random.seed(7)
    for shape in range(4):
        if shape == 0:
            edges = [(i, i + 1) for i in range(300)]
        elif shape == 1:
            edges = [(5, i) for i in range(200)] + [(1000, 1001), (1000, 1000), (7777, 7777)]
        elif shape == 2:
            edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)]
        else:
            edges = []
        near = defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        want = {}
        for node in sorted(near):
            if node not in want:
                todo = [node]
                while todo:
                    x = todo.pop()
                    if x not in want:
                        want[x] = node
                        todo += near[x]
        frame = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
        assert {r.node: r.component for r in connected_components(frame).collect()} == want

