"""Means and residuals over vectors are added up as rows come, for any layout."""
import numpy as np
from pyspark.sql import functions as F

from tunefunnel.operators import als as AL
from tunefunnel.sources import tables as T


def test_element_mean_of_missing_and_ragged_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, None]), (2, [5.0]), (2, [1.0, 4.0, None]), (3, None), (4, []), (None, [7.0]), (5, [None])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    for parts in (1, 5):
        got = {r.k: list(r.v) for r in T.element_mean(df.repartition(parts), "k", "v").collect()}
        assert got == {1: [2.0, 2.0], 2: [3.0, 4.0, None], None: [7.0], 5: [None]}


def test_element_mean_moves_each_vector_once(spark):
    """A key of more rows than a batch holds; elements do not become rows."""
    df = spark.range(25_000).select((F.col("id") % 3 == 0).cast("string").alias("k"),
                                    F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    out = T.element_mean(df, "k", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    ids = np.arange(25_000)
    got = {r.k: r.v for r in out.collect()}
    assert got == {"true": [np.float32(ids[ids % 3 == 0].mean()), 1.0], "false": [np.float32(ids[ids % 3 != 0].mean()), 1.0]}


def test_residual_is_that_of_the_equations(spark):
    rng = np.random.default_rng(3)
    Y, X = rng.standard_normal((20, 4)).astype(np.float32), rng.standard_normal((6, 4)).astype(np.float32)
    items = spark.createDataFrame([(i, Y[i].tolist()) for i in range(20)], "item_id long, features array<float>")
    vectors = spark.createDataFrame([(r, X[r].tolist()) for r in range(5)], "request_id long, features array<float>")
    rows = [(r, i, float(1 + (r + i) % 4)) for r in range(6) for i in range(r, 22, 2)]     # 20 and 21 are unknown
    conf = spark.createDataFrame(rows, "request_id long, item_id long, c double")
    want = {}
    for r in range(5):
        seeds = [(i, c - 1 + AL.EPS) for q, i, c in rows if q == r]
        y = Y[[i for i, _ in seeds if i < 20]].astype(float)
        c1 = np.array([c for i, c in seeds if i < 20])
        A = Y.T.astype(float) @ Y + (y * c1[:, None]).T @ y + 0.1 * len(seeds) * np.eye(4)
        want[r] = (len(seeds), np.abs(A @ X[r] - ((1 + c1)[:, None] * y).sum(axis=0)).max())
    for parts in (1, 4):
        got = {r.request_id: (r.n_seeds, r.residual) for r in
               AL.normal_residual(conf.repartition(parts), items, vectors, 0.1).collect()}
        assert set(got) == set(want)
        assert all(got[r][0] == want[r][0] and np.isclose(got[r][1], want[r][1], rtol=1e-5) for r in want)


def test_requests_with_one_salt_are_solved_where_they_are_summed(spark):
    """Sums of normal equations move only for requests with several salts."""
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(50)], "item_id long, features array<float>")
    seeds = spark.createDataFrame([(r, i) for r in range(9) for i in range(r, 50, 5)] + [(99, i) for i in range(50)],
                                  "request_id long, item_id long")
    conf = AL.seed_confidence(seeds)
    one = {r.request_id: r.features for r in AL.fold_in(conf, items).collect()}
    two = {r.request_id: r.features for r in AL.fold_in(conf, items, salt_rows=20).collect()}
    assert set(one) == set(two) == {*range(9), 99}
    assert all(np.allclose(one[k], two[k], atol=1e-5) for k in one)
