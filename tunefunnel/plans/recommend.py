"""The two-stage funnel as one batch DAG (M-11, M-12, S-13, J-08, L-06), and
the training of both stages (M-08 -> M-09) from the driver's tables.

Serving is batch over all requests: retrieval (fold-in + exact top-200) ->
features -> ranker scores -> tie-broken top-k.  The stage-1-only arm reuses
the same persisted candidate pool (its top-k is a prefix of the pool).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import als as AL
from ..operators import ingest as I
from ..operators import profiles as PR
from ..operators import ranker as RK
from ..operators import retrieval as RV
from ..operators import split as S
from ..operators import training as TR
from ..session import scratch_path
from . import cache as C


@dataclass
class Stage1:
    model_path: str
    mapped: DataFrame
    tmap: DataFrame


@dataclass
class Params:
    rank: int = 50
    iters: int = 15
    reg: float = 0.01
    n_candidates: int = 200
    k: int = 20
    holdout: float = 0.2
    salt: str = "42"
    n_train: int = 10000
    n_neg: int = 50
    n_trees: int = 100
    learning_rate: float = 0.1
    depth: int = 6
    confidence: str = "occurrence"


_MEMO: dict = {}


def _memo_key(spark, sf_dir, what, params):
    return (spark.sparkContext.applicationId, sf_dir, what, repr(params))


def train_stage1(spark, sf_dir, p: Params) -> Stage1:
    key = _memo_key(spark, sf_dir, "als", (p.rank, p.iters, p.reg))
    mapped = C.mapped(spark, sf_dir)
    if key not in _MEMO:
        model = AL.fit_als(I.confidence(mapped), p.rank, p.iters, p.reg)
        _MEMO[key] = AL.save_model(model, scratch_path(spark, "als-model"))
    return Stage1(_MEMO[key], mapped, C.track_map(spark, sf_dir))


def retrieve_for_seeds(s1: Stage1, seeds: DataFrame, p: Params, items=None) -> DataFrame:
    """M-04 + M-05 for seed requests ``[request_id long, item_id]``:
    ``[request_id, track_int_id, als_score, als_rank]``."""
    if items is None:
        _, items = AL.factors(AL.load_model(s1.model_path))
    popularity = None
    if p.confidence == "popularity":
        popularity = s1.mapped.groupBy(F.col("track_int_id").alias("item_id")).agg(
            F.count(F.lit(1)).alias("n_interactions"))
    conf = AL.seed_confidence(seeds, p.confidence, popularity)
    users = AL.fold_in(conf, items, p.reg).withColumnRenamed("request_id", "user_id")
    cand = RV.top_n(users, items, p.n_candidates,
                    seen=seeds.select(F.col("request_id").alias("user_id"), "item_id"))
    return cand.select(F.col("user_id").alias("request_id"), F.col("item_id").alias("track_int_id"),
                       F.col("score").alias("als_score"), F.col("rank").alias("als_rank"))


def train_stage2(spark, sf_dir, s1: Stage1, p: Params):
    """M-08 -> M-09: training frame from the first ``n_train`` playlists'
    seed splits and stage-1 candidates, then LambdaMART."""
    key = _memo_key(spark, sf_dir, "ranker", (p.rank, p.iters, p.reg, p.n_trees, p.depth,
                                             p.learning_rate, p.n_neg, p.n_train, p.confidence))
    if key in _MEMO:
        return RK.LambdaMARTModel.load(_MEMO[key])
    mapped = s1.mapped
    keep = S.train_playlists(mapped, p.n_train).select("playlist_int_id")
    rows = mapped.join(keep, "playlist_int_id", "left_semi").select("playlist_id", "track_id")
    sp = S.holdout_split(rows, p.holdout, p.salt)
    sp = C.shared_copy(sp.join(C.playlist_map(spark, sf_dir), "playlist_id").join(s1.tmap, "track_id"), "train-split")
    seeds = sp.filter("held = 0")
    targets = sp.filter("held = 1").select("playlist_int_id", "track_int_id")
    cands = retrieve_for_seeds(
        s1, seeds.select(F.col("playlist_int_id").alias("request_id"), F.col("track_int_id").alias("item_id")), p)
    cands = C.shared_copy(cands.withColumnRenamed("request_id", "playlist_int_id"), "train-candidates")   # read several times
    labelled = TR.label_candidates(cands, targets)
    if labelled.limit(1).count() == 0:
        raise ValueError("no usable training playlists: no held-out target was retrieved (K24)")
    sampled = TR.hard_negatives(labelled, p.n_neg)
    frame = TR.training_frame(sampled.drop("als_rank"), s1.tmap, C.track_metadata(spark, sf_dir),
                              seeds.select("playlist_int_id", "track_id"))
    frame = TR.both_label_groups(frame)
    model = RK.fit_lambdamart(frame, p.n_trees, p.learning_rate, p.depth)
    _MEMO[key] = model.save(scratch_path(spark, "ranker"))
    return model


def seed_pool(spark, sf_dir, seed_requests: DataFrame, p: Params) -> DataFrame:
    """The written candidates of seed requests ``[request_id long, track_id]``."""
    s1 = train_stage1(spark, sf_dir, p)
    seeds = seed_requests.join(s1.tmap, "track_id").select("request_id", F.col("track_int_id").alias("item_id"))
    return C.shared_copy(retrieve_for_seeds(s1, seeds, p), "pool")


def recommend(spark, sf_dir, seed_requests: DataFrame, p: Params, with_engine: bool = True, pool: DataFrame | None = None):
    """M-11 + M-12 for seed requests ``[request_id long, track_id]``.

    Returns (recs ``[request_id, arm, rank, track_int_id, track_id, rank_score,
    als_score]`` for arms ``engine`` and ``als_only``, the scored pool).
    Requests whose seeds are all unknown get no rows (K23).  ``pool`` is what
    ``seed_pool`` returned for the same requests, if it was called before.
    """
    s1 = train_stage1(spark, sf_dir, p)
    pool = seed_pool(spark, sf_dir, seed_requests, p) if pool is None else pool
    als_only = _als_only(pool, s1.tmap, p.k)
    if not with_engine:
        return als_only, pool
    prof = PR.profiles(seed_requests, C.track_metadata(spark, sf_dir), mode="distinct", keep_empty=True)
    return _rerank(spark, sf_dir, s1, p, pool, prof, keep_unprofiled=True, als_only=als_only)


def _rerank(spark, sf_dir, s1: Stage1, p: Params, pool: DataFrame, prof: DataFrame,
            keep_unprofiled: bool, als_only: DataFrame):
    ranker = train_stage2(spark, sf_dir, s1, p)
    meta = C.track_metadata(spark, sf_dir)
    feats = PR.candidate_features(pool.drop("als_rank"), s1.tmap, meta, prof, keep_unprofiled=keep_unprofiled)
    scored = C.shared_copy(ranker.score(feats), "scored")   # ranked here and read by reports
    top = RK.rerank_topk(scored, p.k)
    engine = top.select("request_id", F.lit("engine").alias("arm"), F.col("rank").cast("int").alias("rank"),
                        "track_int_id", "track_id", "rank_score", "als_score")
    return engine.unionByName(als_only), scored


def _als_only(pool: DataFrame, tmap: DataFrame, k: int) -> DataFrame:
    """M-06 + J-09: the stage-1 top-k prefix of the pool, mapped to track ids."""
    out = RV.lookup_ids(pool.filter(F.col("als_rank") <= k)
                            .withColumnRenamed("als_rank", "rank")
                            .withColumnRenamed("track_int_id", "item_id")
                            .withColumnRenamed("request_id", "user_id"),
                        tmap.withColumnRenamed("track_int_id", "item_id"))
    return out.select(F.col("user_id").alias("request_id"), F.lit("als_only").alias("arm"),
                      F.col("position").cast("int").alias("rank"), F.col("item_id").alias("track_int_id"),
                      "track_id", F.lit(None).cast("double").alias("rank_score"), "als_score")


def recommend_known(spark, sf_dir, playlists: DataFrame, p: Params):
    """M-03 + M-07 + M-10 for known playlists ``[playlist_int_id]`` (the
    reference's int target): the trained user factor, every track of the
    playlist removed as seen, the row-mode playlist profile joined inner (a
    playlist without catalog tracks gets no engine rows, K4)."""
    PR.check_request_frame(playlists.withColumn("request_id", F.col("playlist_int_id")), "playlist")
    s1 = train_stage1(spark, sf_dir, p)
    users, items = AL.factors(AL.load_model(s1.model_path))
    req = playlists.select(F.col("playlist_int_id").cast("long").alias("user_id")).distinct()
    users = users.join(req, "user_id", "left_semi")
    seen = s1.mapped.join(playlists.select("playlist_int_id"), "playlist_int_id", "left_semi").select(
        F.col("playlist_int_id").cast("long").alias("user_id"), F.col("track_int_id").alias("item_id"))
    cand = RV.top_n(users, items, p.n_candidates, seen=seen)
    pool = C.shared_copy(cand.select(F.col("user_id").alias("request_id"), F.col("item_id").alias("track_int_id"),
                                     F.col("score").alias("als_score"), F.col("rank").alias("als_rank")), "pool")
    rows = s1.mapped.join(playlists.select("playlist_int_id"), "playlist_int_id", "left_semi").select(
        F.col("playlist_int_id").cast("long").alias("request_id"), "track_id")
    prof = PR.profiles(rows, C.track_metadata(spark, sf_dir), mode="rows")
    return _rerank(spark, sf_dir, s1, p, pool, prof, keep_unprofiled=False,
                   als_only=_als_only(pool, s1.tmap, p.k))


def serve(spark, sf_dir, requests, kind: str, p: Params):
    """S-12, P-18, K23: recommendations for request rows of either kind, given
    as a frame or as in-memory rows.

    ``kind`` is ``playlist`` (request_id, playlist_int_id) or ``seeds``
    (request_id, track_id); other kinds and types raise ``TypeError``.
    Returns (recs, unserved): the rows of both arms and the request ids that
    nothing is known about.
    """
    if not isinstance(requests, DataFrame):
        item = {"playlist": "playlist_int_id long", "seeds": "track_id string"}.get(kind, "")
        if not item:
            raise TypeError(f"request kind must be 'playlist' or 'seeds', got {kind!r}")
        requests = spark.createDataFrame(list(requests), f"request_id long, {item}")
    PR.check_request_frame(requests, kind)
    if kind == "seeds":
        recs, _ = recommend(spark, sf_dir, requests.select("request_id", "track_id"), p)
    else:
        recs, _ = recommend_known(spark, sf_dir, requests.select("playlist_int_id").distinct(), p)
        asked = requests.select(F.col("request_id").alias("_asked"), F.col("playlist_int_id").alias("request_id"))
        recs = recs.join(asked, "request_id").withColumn("request_id", F.col("_asked")).drop("_asked")
    recs = C.shared_copy(recs, "served")
    return recs, AL.unserved(requests, recs.select("request_id").distinct())


def present(recs: DataFrame, metadata: DataFrame) -> DataFrame:
    """S-13 / J-08 / L-06: names attached (left join) and ordered by rank."""
    names = metadata.select("track_id", "artist_name", "track_name")
    return (recs.join(names, "track_id", "left")
                .select("request_id", "arm", "rank", "artist_name", "track_name", "track_id", "rank_score")
                .orderBy("request_id", "arm", "rank"))
