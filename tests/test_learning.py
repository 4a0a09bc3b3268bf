"""Planted-cluster learning check (FIXTURES F5): the stages learn.

200 playlists, 80 tracks, cluster = id % 4; each playlist takes 15 of its
cluster's 20 tracks (md5 order), 3 of which are held out.  Ideal cluster
knowledge gives recall@5 ~ 0.625.
"""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunefunnel.operators import als as AL
from tunefunnel.operators import metrics as M
from tunefunnel.operators import popularity as P
from tunefunnel.operators import ranker as RK
from tunefunnel.operators import retrieval as RV

K = 5


@pytest.fixture(scope="module")
def planted(spark):
    p = spark.range(200).select(F.col("id").alias("user_id"))
    rows = p.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")) \
            .select("user_id", (F.col("user_id") % 4 + 4 * F.col("i")).alias("item_id"))
    key = lambda tag: F.md5(F.concat_ws(":", F.lit(tag), F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    w = Window.partitionBy("user_id")
    rows = rows.withColumn("_x", F.row_number().over(w.orderBy(key("x")))).filter("_x <= 15")
    rows = rows.withColumn("_y", F.row_number().over(w.orderBy(key("y"))))
    held = rows.filter("_y <= 3").select("user_id", "item_id").cache()
    seeds = rows.filter("_y > 3").select("user_id", "item_id").cache()
    return seeds, held


def _recall(held, recs):
    per = M.metrics_at_k(held, recs, K, key="user_id", item="item_id")
    return per.agg(F.avg("recall")).first()[0]


def test_popularity_and_stage1(spark, planted):
    seeds, held = planted
    top = P.popularity_topk(seeds.withColumnRenamed("item_id", "track_id"), K).withColumnRenamed("track_id", "item_id")
    pop = M.metrics_at_k(held, top, K, key="user_id", item="item_id", shared=True).agg(F.avg("recall")).first()[0]
    assert pop < 0.2
    cells = seeds.groupBy(F.col("user_id").alias("playlist_int_id"), F.col("item_id").alias("track_int_id")) \
                 .agg(F.count(F.lit(1)).cast("float").alias("confidence"))
    model = AL.fit_als(cells, rank=8, max_iter=5, reg=0.01)
    users, items = AL.factors(model)
    recs = RV.top_n(users, items, K, seen=seeds)
    assert _recall(held, recs) > 0.5


def test_ranker_learns_noisy_label_feature(spark, planted):
    seeds, held = planted
    cells = seeds.groupBy(F.col("user_id").alias("playlist_int_id"), F.col("item_id").alias("track_int_id")) \
                 .agg(F.count(F.lit(1)).cast("float").alias("confidence"))
    users, items = AL.factors(AL.fit_als(cells, rank=8, max_iter=5, reg=0.01))
    cands = RV.top_n(users, items, 20, seen=seeds)
    h = held.withColumn("_h", F.lit(1))
    lab = cands.join(h, ["user_id", "item_id"], "left").withColumn("label", F.col("_h").isNotNull().cast("int"))
    pk = F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string"))
    flip = F.crc32(F.concat(F.lit("n:"), pk)) % 5 == 0
    null = F.crc32(F.concat(F.lit("z:"), pk)) % 20 == 0
    noisy = F.when(null, F.lit(None).cast("double")).when(flip, 1.0 - F.col("label")).otherwise(F.col("label").cast("double"))
    frame = lab.withColumn("noisy", noisy).withColumnRenamed("user_id", "playlist_int_id") \
               .withColumnRenamed("score", "als_score")
    model = RK.fit_lambdamart(frame, n_trees=3, max_depth=3, inputs=["noisy", "als_score"])
    scored = model.score(frame).withColumnRenamed("playlist_int_id", "request_id") \
                  .withColumnRenamed("item_id", "track_int_id")
    top = RK.rerank_topk(scored, K).select(F.col("request_id").alias("user_id"), "rank",
                                           F.col("track_int_id").alias("item_id"))
    assert _recall(held, top) > 0.8


def test_ranker_scores_do_not_depend_on_the_layout(spark):
    """The same rows in three layouts give the same trees and scores."""
    rows = [(p, int(F_hash(p, i) % 4 == 0), f"t{i}", float(F_hash(i, p) % 50), float(F_hash(p, i + 99) % 7))
            for p in range(40) for i in range(12)]
    frame = spark.createDataFrame(
        rows, "playlist_int_id long, label int, track_id string, als_score double, noise double")
    got = []
    for parts in (1, 5, 16):
        model = RK.fit_lambdamart(frame.repartition(parts), n_trees=3, max_depth=3, inputs=["als_score", "noise"])
        got.append({(r.playlist_int_id, r.track_id): r.rank_score for r in model.score(frame).collect()})
    for other in got[1:]:
        assert max(abs(other[k] - got[0][k]) for k in got[0]) < 1e-9
    assert max(got[0].values()) > min(got[0].values())


def F_hash(a, b):
    return (a * 2654435761 + b * 40503 + a * b * 97) >> 3
