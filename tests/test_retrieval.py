"""Blocked top-N: block sizes do not matter; seen filtering; ties; id lookup (K15)."""
import numpy as np
from pyspark.sql import functions as F

from tunefunnel.operators import retrieval as RV
from tunefunnel.sources import tables as T
from data_dirs import SF001


def _rows(df):
    return sorted((r.user_id, r.item_id, r.rank) for r in df.collect())


def test_block_sizes_do_not_change_the_result(spark):
    items, users = T.embedding_factors(spark, SF001)
    seen = T.table(spark, SF001, "embeddings").select(
        F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("item_id"))
    a = RV.top_n(users, items, 25, seen=seen)
    b = RV.top_n(users, items, 25, seen=seen, item_block=64, user_block=3)
    assert _rows(a) == _rows(b)
    c = RV.top_n(users, items, 25)
    d = RV.top_n(users, items, 25, item_block=50, user_block=4)
    assert _rows(c) == _rows(d)


def test_more_seen_than_items_left(spark):
    users = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "user_id long, features array<float>")
    items = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "item_id long, features array<float>")
    seen = spark.createDataFrame([(1, i) for i in range(5)] * 2 + [(2, 99), (7, 1)], "user_id long, item_id long")
    got = RV.top_n(users, items, 3, seen=seen, item_block=2)
    assert _rows(got) == [(1, 5, 1), (2, 0, 1), (2, 1, 2), (2, 2, 3)]


def test_no_seen_item_returned(spark):
    items, users = T.embedding_factors(spark, SF001)
    seen = T.table(spark, SF001, "embeddings").select(
        F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("item_id"))
    got = RV.top_n(users, items, 30, seen=seen)
    assert got.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    per_user = got.groupBy("user_id").count().collect()
    assert all(r["count"] == 30 for r in per_user)


def test_ties_broken_by_id(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, features array<float>")
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7, 5)] + [(11, [2.0, 0.0])],
                                  "item_id long, features array<float>")
    got = RV.top_n(users, items, 3).orderBy("rank").collect()
    assert [r.item_id for r in got] == [11, 3, 5]


def test_pool_prefix_equals_direct_topk(spark):
    items, users = T.embedding_factors(spark, SF001)
    big = RV.top_k_prefix(RV.top_n(users, items, 40), 10)
    small = RV.top_n(users, items, 10)
    assert _rows(big) == _rows(small)


def test_blocks_out_of_reach_are_skipped(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8)) * np.exp(-np.arange(400) / 40)[:, None]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, features array<float>")
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 8)))]
                                  + [(99, [0.0] * 8)], "user_id long, features array<float>")
    seen = spark.createDataFrame([(3, i) for i in range(60)], "user_id long, item_id long")
    got, report = RV.top_n_blocks(users, items, 10, seen=seen, item_block=40, user_block=7)
    assert _rows(got) == _rows(RV.top_n(users, items, 10, seen=seen))
    rows = report.orderBy("block").collect()
    assert [r.n_items for r in rows] == [40] * 10
    lengths = np.sort(np.linalg.norm(vectors, axis=1))[::-1]
    assert np.allclose([r.max_length for r in rows], lengths[::40], rtol=1e-6)
    # a zero vector ties everywhere, so it reaches every block
    assert rows[0].n_scored == 31 and rows[-1].n_scored == 1


def test_no_users_or_items(spark):
    none = spark.createDataFrame([], "user_id long, features array<float>")
    items = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "item_id long, features array<float>")
    assert RV.top_n(none, items, 3).count() == 0
    assert RV.top_n(none, items, 3, item_block=2).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "user_id long, features array<float>")
    assert RV.top_n(one, items.limit(0), 3).count() == 0


def test_lookup_closes_positions(spark):
    cands = spark.createDataFrame([(1, 101, 1), (1, 205, 2), (1, 310, 3)], "user_id long, item_id long, rank int")
    dim = spark.createDataFrame([(101, "a"), (310, "c")], "item_id long, track_id string")
    got = RV.lookup_ids(cands, dim).orderBy("position").collect()
    assert [(r.track_id, r.position) for r in got] == [("a", 1), ("c", 2)]


def test_items_are_read_and_not_dealt_to_the_groups(spark):
    """the search's plan deals users and seen items alone, whatever the
    number of groups; items of many files and pieces come longest first."""
    rng = np.random.default_rng(9)
    Y = (rng.normal(size=(3000, 5)) * rng.uniform(0.2, 3, size=(3000, 1))).astype(np.float32)
    Y[100:120] = Y[100]
    X = rng.normal(size=(40, 5)).astype(np.float32)
    items = spark.createDataFrame([(i, Y[i].tolist()) for i in range(3000)], "item_id long, features array<float>").repartition(7)
    users = spark.createDataFrame([(u, X[u].tolist()) for u in range(40)], "user_id long, features array<float>")
    out = RV.top_n(users, items, 30, user_block=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("FileScan") == 1
    got = {}
    for r in out.collect():
        got.setdefault(r.user_id, []).append((r.rank, r.item_id))
    scores = X.astype(float) @ Y.astype(float).T
    for u in range(40):
        order = np.lexsort((np.arange(3000), -np.round(scores[u], 12)))[:30]
        assert [i for _, i in sorted(got[u])] == order.tolist()


def test_selection_keeps_the_least_ids_of_equal_scores():
    """Lists that are selected from again and again hold the exact best rows."""
    rng = np.random.default_rng(2)
    users = np.array([5, 5, 9, 11])
    X = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.0]])
    V = rng.integers(-2, 3, size=(500, 2)).astype(np.float32)
    L = np.sqrt((V.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(500), -L))
    seen = (np.array([9, 9, 5, 77]), np.array([3, 4, 499, 1]))
    group = RV._Group(users, np.sqrt((X ** 2).sum(axis=1)), X, seen, 7)
    for a in range(0, 500, 32):
        piece = order[a:a + 32]
        rows = group.reached(L[piece[0]], group.least)
        group.add(rows, piece, V[piece], L[piece[0]])
        if a % 64:
            group.select()
    got = {}
    for part in group.best():
        for u, i, s, r in zip(part["user_id"], part["item_id"], part["score"], part["rank"]):
            got.setdefault(int(u), []).append((int(r), int(i), float(s)))
    for u in set(users.tolist()):
        every = sorted((-float(X[n] @ V[i]), i) for n in np.flatnonzero(users == u) for i in range(500)
                       if not ((u == 9 and i in (3, 4)) or (u == 5 and i == 499)))
        assert [(i, s) for _, i, s in sorted(got[u])] == [(i, -s) for s, i in every[:7]]
