"""Steps that move rows once, whatever the number of blocks, waves and arms."""
import numpy as np

from tunefunnel.operators import als as AL
from tunefunnel.operators import metrics as M
from tunefunnel.operators import ranker as RK
from tunefunnel.operators import retrieval as RV
from tunefunnel.operators import split as S


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_groups_are_split_with_one_exchange(spark):
    inter = spark.createDataFrame([(f"p{i % 7}", f"t{i % 11}") for i in range(200)] + [(None, "t1")], "playlist_id string, track_id string")
    out = S.holdout_split(inter)
    assert _exchanges(out) == 1
    rows = out.collect()
    assert len(rows) == 200 and all(r.held == int(r.pos <= r.n_hold) for r in rows)


def test_metrics_of_a_shared_list_move_pairs_and_sums_only(spark):
    held = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), (None, "x")], "playlist_id string, track_id string")
    top = spark.createDataFrame([(1, "x"), (2, "q"), (3, "y")], "rank int, track_id string")
    out = M.metrics_at_k(held, top, 3, shared=True)
    assert _exchanges(out) <= 3
    got = {r.playlist_id: (r.n_held, r.n_held_distinct, r.n_hits, r.hit) for r in out.collect()}
    assert got == {"a": (3, 2, 2, 1), "b": (1, 1, 0, 0), None: (1, 1, 0, 0)}


def test_retrieval_of_many_blocks_is_one_stream(spark):
    """Near ties in single precision, several users of one name, seen items: the
    best rows are those of the plain formula, without a copy of rows per block."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(6)
    Y = (base + 1e-6 * rng.standard_normal((500, 6))).astype(np.float32)
    Y[10], Y[20] = Y[30], Y[30]
    X = rng.standard_normal((9, 6))
    items = spark.createDataFrame([(i, Y[i].tolist()) for i in range(500)], "item_id long, features array<float>")
    users = spark.createDataFrame([(u, X[u].tolist()) for u in range(9)], "user_id long, features array<double>")
    seen = {(u, i) for u in range(9) for i in range(u, 500, 7)}
    out = RV.top_n(users, items, 12, spark.createDataFrame(list(seen), "user_id long, item_id long"), item_block=16, user_block=4)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, r.score))
    for u in range(9):
        scores = [(-float((X[u] * Y[i].astype(float)).sum()), i) for i in range(500) if (u, i) not in seen]
        best = sorted(scores)[:12]
        assert np.allclose([s for _, s in got[u]], [-s for s, _ in best], rtol=1e-12, atol=1e-12)
        assert sorted(i for i, _ in got[u]) == sorted(i for _, i in best)


def test_blocks_of_a_fit_follow_its_cells():
    assert [AL.als_blocks(n) for n in (0, 600_000, 3_600_000, 36_000_000, 216_000_000)] == [2, 2, 12, 12, 54]


def test_walk_over_missing_inputs_and_uneven_trees():
    nodes = [(0, 0, 1, 0.5, True, 1, 2, 0.0), (0, 1, -1, 0.0, False, 0, 0, 1.0), (0, 2, 0, 2.0, False, 4, 3, 0.0),
             (0, 3, -1, 0.0, False, 0, 0, 10.0), (0, 4, -1, 0.0, False, 0, 0, 100.0), (1, 0, -1, 0.0, False, 0, 0, 0.25)]
    arrays = RK.LambdaMARTModel(nodes, 0.1, inputs=["a", "b"])._arrays()
    x = np.array([[1.0, 0.5], [1.0, 0.6], [3.0, 0.6], [np.nan, 0.6], [1.0, np.nan], [np.inf, np.inf]])
    assert RK.walked(arrays, x).tolist() == [1.25, 100.25, 10.25, 10.25, 1.25, 10.25]


def test_candidates_move_once_by_track_and_once_by_request(spark):
    """tracks meet their features before the candidates do."""
    from tunefunnel.operators import profiles as PR

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = ("danceability", "tempo", "energy", "acousticness", "loudness", "valence")
        pool = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.0), (2, 5, 3.0), (2, 7, 3.0)], "request_id long, track_int_id int, als_score double")
        tmap = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "track_id string, track_int_id int")
        meta = spark.createDataFrame([("a", *[1.0] * 6), ("b", *[2.0] * 6)], "track_id string, " + ", ".join(f"{n} double" for n in names))
        prof = PR.profiles(spark.createDataFrame([(1, "a"), (1, "b")], "request_id long, track_id string"), meta, mode="distinct", keep_empty=True)
        out = PR.candidate_features(pool, tmap, meta, prof, keep_unprofiled=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("SortMergeJoin [track_int_id") < plan.index("SortMergeJoin [track_id")
        rows = {(r.request_id, r.track_id): (r.als_score, r.tempo_diff) for r in out.collect()}
        assert rows == {(1, "a"): (2.0, 0.5), (1, "b"): (1.0, 0.5), (2, "a"): (3.0, None)}
        assert out.columns[:4] == ["request_id", "track_id", "track_int_id", "als_score"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diagnostics_move_rows_by_request_alone(spark, monkeypatch):
    """F2, F11: pool and scored rows move once each, by their request; held-out rows
    by track before that."""
    from tunefunnel.operators import experiment as EX

    name = "spark.sql.requireAllClusterKeysForCoPartition"
    seen, copy = [], EX.shared_copy

    def shared_copy(df, *a):
        seen.append(_exchanges(df))
        return copy(df, *a)

    monkeypatch.setattr(EX, "shared_copy", shared_copy)
    before = spark.conf.get(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = spark.createDataFrame([(1, i, f"t{i}", 1.0 / i) for i in range(1, 9)] + [(2, 1, "t1", 1.0)],
                                     "request_id long, track_int_id long, track_id string, als_score double")
        scored = pool.filter("track_int_id % 2 = 0").selectExpr("*", "CAST(track_int_id AS double) AS rank_score")
        held = spark.createDataFrame([(1, "t1"), (1, "t1"), (1, "t8")], "request_id long, track_id string")
        rows = {r.request_id: r for r in EX.rerank_diagnostics(pool, scored, held, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and seen[0] <= 4 and spark.conf.get(name) == before
    one, two = rows[1], rows[2]
    assert (one.n_retrieved, one.n_scored, one.als_hits, one.engine_hits, one.als_hits_kept, one.n_held) == (8, 4, 1, 1, 0, 3)
    assert (one.als_top5, one.engine_top5) == ("t1,t2,t3,t4,t5", "t8,t6,t4,t2")
    assert (two.n_retrieved, two.n_scored, two.als_hits, two.n_held) == (1, 0, 0, 0)


def test_diagnostics_read_the_written_pool(spark, monkeypatch):
    """the query reads the pool of the recommendations and searches no other."""
    from data_dirs import SF001
    from tunefunnel.plans import cache as C
    from tunefunnel.plans import recommend as REC
    from tunefunnel.plans import registry as R

    def searched(*_a, **_k):
        raise AssertionError("the pool was searched again")

    tracks = [r.track_int_id for r in C.track_map(spark, SF001).limit(4).collect()]
    pool = spark.createDataFrame([(0, t, 1.0 - n / 9, n + 1) for n, t in enumerate(tracks)],
                                 "request_id long, track_int_id int, als_score double, als_rank int")
    scored = pool.limit(2).selectExpr("request_id", "track_int_id", "als_score", "1.0D AS rank_score")
    monkeypatch.setattr(R, "eval_recommend", lambda *_a: (None, scored, pool))
    monkeypatch.setattr(REC, "train_stage1", searched)
    monkeypatch.setattr(REC, "retrieve_for_seeds", searched)
    row = R.rerank_diagnostics(spark, SF001).collect()[0]
    assert (row.request_id, row.n_retrieved, row.n_scored, row.degenerate) == (0, 4, 2, 1)
