import random

from cases import SF
from filelens.llm import components
from filelens.llm import url_alias as U

PAGES = "page_id long, url string, html string, verdict string"


def judged(spark, rows, **more):
    got = U.judge(spark.createDataFrame([(*r, "x") for r in rows], PAGES), **more).collect()
    return {r.page_id: (r.rule, r.verdict) for r in got}


def test_rules_longest_first_and_subdomains(spark):
    rows = [(1, "http://example.net/", ""), (2, "http://A.example.NET/en/x", ""), (3, "http://x.net", ""),
            (4, "http://notexample.com/de/", ""), (5, "http://q.example.com/de/?a", ""), (6, "http://b.org/fr/", None),
            (7, "no address", "x"), (8, None, None), (9, "http://net/x", ""), (10, "http://phishnet/x", "")]
    got = judged(spark, rows)
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: (None, "allow"),
                   5: ("example.com/de/", "block"), 6: ("org/fr/", "allow"), 7: (None, "allow"), 8: (None, "allow"),
                   9: ("net/", "block"), 10: (None, "allow")}


def test_aliases_inherit_with_allow_first(spark):
    rows = [(1, "http://shop.com/x#t", "<link rel='canonical' href='/y'>"), (2, "https://SHOP.com/y", ""),
            (3, "http://a.net/1", '<meta http-equiv="Refresh" content="0; url=http://shop.com/y">'),
            (4, "http://b.org/fr/x", '<link href="https://c.com/z?a=1&amp;b=2" rel=canonical>'),
            (5, "https://c.com/z?a=1&b=2", '<!-- <link rel="canonical" href="http://x.net/"> -->'),
            (6, "https://c.com/w", '<link rel=canonical href="http://x.net/q">'),
            (7, "https://c.com/v", '<link rel=canonical href="https://c.com/w"><link rel=canonical href="http://o.org/fr/">')]
    got = judged(spark, rows)
    assert [got[i][1] for i in range(1, 8)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[6][0] is None and got[3][0] == "net/"
    more = spark.createDataFrame([("http://shop.com/x", "http://ok.org/fr/")], "src string, dst string")
    assert [judged(spark, rows[:3], redirects=more)[i][1] for i in (1, 2, 3)] == ["allow", "allow", "block"]


def test_keep_allowed_and_empty(spark):
    df = spark.createDataFrame([(1, "http://x.net/", "", "a"), (2, "http://x.com/", "", "b"), (3, None, None, None)], PAGES)
    assert sorted(r.page_id for r in U.keep_allowed(df).collect()) == [2, 3]
    assert U.judge(df.limit(0)).count() == 0


def test_query(spark):
    from filelens.llm.registry import QUERIES

    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = QUERIES["op2_url_filter"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in got:
        fits = [(h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.rule, r.verdict) == (rule, verdict)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(150)] + [(300, i) for i in range(301, 400)] + [(7, 7), (None, 3), (1, 0)]
    edges += [(rng.randint(400, 499), rng.randint(400, 499)) for _ in range(60)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.classes(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({x for e in edges if None not in e for x in e})
    assert all(r.class_id == root(r.node) for r in got)
    assert components.classes(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
