import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tunefunnel.llm import lexical_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    vectors = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in vectors if c)
    total = sum(sum(c.values()) for _, c in vectors)
    df = Counter(x for _, c in vectors for x in c)
    out = Counter()
    for item, text in items:
        found = []
        for d, c in vectors:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                        * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * (10 + (90 * sum(c.values()) * n_docs) // total)))
                        for x in set(terms(text)) if c[x])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out.update((item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1))
    return out


def got(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return Counter(map(tuple, lexical_search.ranked(d, i, **more).collect()))


def made(rng, n):
    """Texts of a few frequent and many rare words, with copies."""
    texts = [" ".join(f"{'The' if rng.random() < .4 else 'w' + str(int(rng.paretovariate(.7)) % 300)}"
                      for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [(i, texts[i] if i % 5 else texts[0]) for i in range(n)]


def test_terms(edge_rows):
    for r in edge_rows:
        assert [t.decode() for t in lexical_search.terms_of((r[1] or "").encode())] == terms(r[1])


@pytest.mark.parametrize("small, cells", [(256, 4_000_000), (2, 500)])
def test_equals_brute_force(spark, monkeypatch, small, cells):
    monkeypatch.setattr(lexical_search, "SMALL", small)
    monkeypatch.setattr(lexical_search, "BLOCK_CELLS", cells)
    rng = random.Random(4)
    docs, items = made(rng, 600), made(rng, 25)
    assert got(spark, docs, items) == brute(docs, items)


def test_edge_cases(spark, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    items = [(1, docs[20][1]), (1, docs[20][1]), (None, "start passage"), (2, None), (3, ""), (4, "nowhere1 nowhere2"),
             (5, docs[9][1]), (6, "A b ΣΑΣ é 日本語 12"), (7, "null id")]
    assert got(spark, docs, items, k=3) == brute(docs, items, k=3)
    assert got(spark, [], items) == Counter() == got(spark, docs, [])
    assert got(spark, [(1, None), (2, " ")], items) == Counter()


def test_clashing_columns(spark, clashing, edge_rows):
    items = spark.createDataFrame([(1, edge_rows[20][1], "x", "y")], "item_id long, text string, doc_id string, item string")
    want = brute([(r[0], r[1]) for r in edge_rows], [(1, edge_rows[20][1])])
    assert Counter(map(tuple, lexical_search.ranked(clashing, items).collect())) == want


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 500)
    rng = random.Random(5)
    docs, items = made(rng, 80), made(rng, 12)
    assert got(spark, docs, items) == brute(docs, items)


def test_bounds_leave_out_subtrees():
    """A tree of many poor and some good documents is not scored as a whole."""
    rng = np.random.default_rng(2)
    tf = rng.integers(0, 2, size=(20_000, 8)) * (rng.random((20_000, 8)) < .3)
    tf[:40] = 9
    best = lexical_search.Best(10)
    m, ids, w = rng.integers(50, 200, size=20_000), rng.permutation(20_000), np.full(8, 1000)
    assert lexical_search.search_tree(tf, m, ids, w, best) < 5000
    scores = (w * lexical_search.parts_of_score(tf, m[:, None])).sum(axis=1)
    order = np.lexsort((ids, -scores))[:10]
    assert best.scores.tolist() == scores[order].tolist() and best.ids.tolist() == ids[order].tolist()
