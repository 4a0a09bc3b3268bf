import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tunefunnel.llm import components, simhash

UPPER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > n)


def brute_components(ids, values, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_documents_match_brute_force(edge_docs, edge_rows, no_docs):
    values = [brute_fingerprint(r[1]) for r in edge_rows]
    want = brute_components([r[0] for r in edge_rows], values, 2)
    got = simhash.near_duplicates(edge_docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(
        (r[0], v, c) for r, v, c in zip(edge_rows, values, want))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_spark_xxhash64_is_the_same_function(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_links_connect_all_near_fingerprints(spark, tile_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * 2 + rng.integers(0, 2, 40, dtype=np.uint64)
    values = set(base.tolist()) | {0, 2**64 - 1, 3}
    for v in base.tolist():
        for _ in range(4):
            v ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            values.add(v)
    values = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    roots = {r.node % 2**64: r.root for r in components.components(simhash.links(rows, tile_rows=tile_rows)).collect()}
    want = brute_components(values, values, 2)
    groups = {}
    for v, w in zip(values, want):
        groups.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(x) == 1 for x in groups.values())
    assert len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_forest_and_components_on_random_links(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    root = {x: x for x in range(300)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    got = {r.node: r.root for r in components.components(rows).collect()}
    assert got == {x: find(x) for x in set(a.tolist()) | set(b.tolist()) if any(
        x in p and p[0] != p[1] for p in zip(a.tolist(), b.tolist()))}
    nodes, roots = simhash.forest(a, b)
    again = spark.createDataFrame(list(zip(nodes.tolist(), roots.tolist())), "a long, b long")
    assert {r.node: r.root for r in components.components(again).collect()} == got
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in components.components(path).collect()} == {0}


def test_one_of_each(clashing, edge_rows):
    out = simhash.one_of_each(clashing)
    assert out.columns == clashing.columns
    want = brute_components([r[0] for r in edge_rows], [brute_fingerprint(r[1]) for r in edge_rows], 2)
    gone = {r[0] for r, c in zip(edge_rows, want) if r[0] is not None and c is not None and r[0] != c}
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in edge_rows if r[0] not in gone)


def test_an_id_on_several_texts_leaves_each_component_a_document(spark):
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(3))
    rows = [(5, a), (7, a), (5, b), (3, b), (9, c), (9, c.upper()), (11, c)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text.lower()) for r in out) == Counter([(5, a), (3, b), (9, c)])
