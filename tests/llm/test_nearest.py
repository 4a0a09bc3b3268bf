import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunefunnel.llm import hilbert, nearest

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, k):
    """The true neighbours of the rows whose id is divisible by 20."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = [len(v) for _, v in ok]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    ok = [(i, np.array(v, dtype=float)) for i, v in ok if len(v) == dim]
    out = set()
    for q in {i for i, _ in ok if i % 20 == 0}:
        best = {}
        for _, mine in [x for x in ok if x[0] == q]:
            for i, v in ok:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((mine * v).sum()))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, r, i, round(s, 9)) for r, (i, s) in enumerate(top, 1)}
    return out


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in
            nearest.nearest(frame, F.col("vec_id") % 20 == 0, **kw).collect()}


def test_edges_match_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies: ties go to smaller ids
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 1.0, 1.0, 1.0]),
             (204, [float("nan")] * 5), (205, [float("inf")] + [1.0] * 4), (220, [1.0, 2.0]), (None, [1.0] * 5),
             (40, rows[40][1]), (7, rng.standard_normal(5).tolist()), (300, (100 * rng.standard_normal(5)).tolist())]
    assert found(spark, rows) == brute(rows, 20)


def test_fewer_candidates_and_none(spark):
    assert found(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]) == {(0, 1, 1, 4.0)}
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]) == set()


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    want = {(q, i) for q, _, i, _ in brute(rows, 20)}
    got = {(q, i) for q, _, i, _ in found(spark, rows, block_rows=128)}
    assert len(got) == len(want) and len(want & got) >= 0.9 * len(want)


def test_copies_wider_than_the_window_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(4000)]
    copy = [0.0, *(3.0 * np.array(rows[2000][1]))[1:].tolist()]
    rows += [(i, copy if i % 2 else [-0.0, *copy[1:]]) for i in range(4001, 5501)]
    got = {(q, r, i) for q, r, i, _ in found(spark, rows, block_rows=32, target=0.3) if q in (5000, 5500)}
    assert got == {(q, r, 4000 + r) for q in (5000, 5500) for r in range(1, 21)}


def test_registered_query_recall(spark):
    from tunefunnel.llm import queries
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 20)}
    got = {(r.query_id, r.vec_id) for r in queries.op2_nearest(spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3), (4, 2), (5, 2)])
def test_hilbert_keys_walk_the_grid(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert.keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
