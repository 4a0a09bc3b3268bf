from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tunefunnel.llm import url_rules

PAGES = "page_id long, url string, kept string, host string"


def judged(spark, urls, labels=(), **kw):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], PAGES)
    known = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in url_rules.judge(pages, known, **kw).collect()}


CASES = [
    ("https://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://anet/x", "anet", "/x", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://x.example.com/de/a#b", "x.example.com", "/de/a", "example.com/de/", "block"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/FR/", "x.org", "/FR/", None, "allow"),
    ("HTTP://É.NET?q", "É.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_explicit_rules(spark):
    got = judged(spark, [c[0] for c in CASES])
    for i, (_, *want) in enumerate(CASES):
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == want, CASES[i]


def brute_rules(rows, min_support, min_confidence):
    n = len(rows)
    sets = {c for tokens, _ in rows for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    rules = {}
    for s in sets:
        held = [bad for tokens, bad in rows if set(s) <= set(tokens)]
        if sum(held) >= min_support * n and sum(held) >= min_confidence * len(held):
            rules[s] = sum(held) / len(held)
    return {s for s in rules if not any(set(t) < set(s) for t in rules)}


@pytest.fixture(scope="module")
def labelled(spark):
    urls, labels = [], []
    for i in range(120):
        bad_pair = i % 4 == 0
        urls.append(f"http://{'ads' if i % 2 == 0 else 'www'}.site.com/{'win' if bad_pair or i % 4 == 1 else 'doc'}/{i}")
        labels.append((i, 0 if bad_pair else 1, 0))
    labels += [(500, 0, 1), (3, None, None)]
    return urls, labels


def test_mined_rules_match_brute_force(spark, labelled):
    urls, labels = labelled
    known = dict((i, q == 0) for i, q, _ in labels if q is not None)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    rows = spark.createDataFrame([(tokens[i], known[i]) for i in tokens], "tokens array<string>, bad boolean")
    rules = {tuple(r.tokens) for r in url_rules.mine_rules(rows, 0.05, 0.8).collect()}
    assert rules == brute_rules([(tokens[i], known[i]) for i in tokens], 0.05, 0.8)
    assert ("h:ads", "p:win") in rules
    got = judged(spark, urls + [None, "http://ads.x.com/win/9"], labels, min_support=0.05)
    for i, u in enumerate(urls):
        assert got[i].verdict == ("block" if any(set(r) <= set(tokens[i]) for r in rules) else "allow")
    assert got[len(urls)].verdict == "allow" and got[len(urls) + 1].verdict == "block"


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://x.net/a")] * 3 + [(None, "http://x.net/a")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in url_rules.judge(pages, none).collect()] == ["block"] * 4


def test_one_long_url_that_repeats(spark):
    """Forty path parts on 4 % of 1,000 labelled pages: one class, one rule."""
    long = "http://bad.site.com/" + "/".join(f"part{i}" for i in range(40))
    urls = [long if i % 25 == 0 else f"http://www.site.com/{i % 9}/{i}" for i in range(1000)]
    for bad in (lambda i: i % 25 == 0, lambda i: i % 50 == 0):  # all of its pages, half of them
        got = judged(spark, urls + [long + "/more", "http://x.com/part7"], [(i, int(not bad(i)), 0) for i in range(1000)])
        want = "block" if bad(25) else "allow"
        assert {got[i].verdict for i in range(1000) if i % 25 == 0} == {want}
        assert got[1000].verdict == got[1001].verdict == want
        assert {got[i].verdict for i in range(1000) if i % 25} == {"allow"}


def test_random_tables_match_brute_force(spark):
    """Classes of several tokens, nested ones, and rules over rules."""
    import random
    for seed in range(4):
        rnd = random.Random(seed)
        rows = []
        for _ in range(60):
            tokens = [t for t in "abcdef" if rnd.random() < 0.5]
            tokens += [t + "2" for t in tokens if t in "ab"] + ["all"]
            bad = ("a" in tokens and "c" in tokens) or ("b" in tokens and "d" in tokens and "e" in tokens) or rnd.random() < 0.1
            rows.append((tokens, bad))
        df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
        rules = [tuple(r.tokens) for r in url_rules.mine_rules(df, 0.05, 0.8).collect()]
        want = brute_rules(rows, 0.05, 0.8)
        assert len(rules) == len(set(rules)) and set(rules) == want and any(len(r) > 1 for r in want)
