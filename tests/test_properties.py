"""Property tests: metrics on worked cases and their bounds,
contiguous bijective ids."""
import math
import random

from pyspark.sql import functions as F

from tunefunnel.operators import ingest as I
from tunefunnel.operators import metrics as M
from tunefunnel.sources import tables as T
from data_dirs import SF001


def test_metrics_on_cases_worked_by_hand(spark):
    """k = 3.  Held-out rows count duplicates for recall, not for NDCG."""
    log3 = math.log2(3)
    cases = {  # playlist: (held, recommended, recall, ndcg, hit)
        "one of two, second place": (["a", "b"], ["x", "a", "y"], 1 / 2, (1 / log3) / (1 + 1 / log3), 1),
        "all, in order": (["a", "b", "c"], ["a", "b", "c"], 1.0, 1.0, 1),
        "none": (["a"], ["x", "y", "z"], 0.0, 0.0, 0),
        "beyond k": (["a"], ["x", "y", "z", "a"], 0.0, 0.0, 0),
        "third place": (["a"], ["x", "y", "a"], 1.0, 1 / 2, 1),
        "repeated held-out row": (["a", "a"], ["a"], 1 / 2, 1.0, 1),
        "more held out than k": (["a", "b", "c", "d"], ["d"], 1 / 4, 1 / (1 + 1 / log3 + 1 / 2), 1),
        "nothing recommended": (["a"], [], 0.0, 0.0, 0),
    }
    held = [(p, t) for p, c in cases.items() for t in c[0]]
    recs = [(p, r, t) for p, c in cases.items() for r, t in enumerate(c[1], 1)]
    got = {r.playlist_id: r for r in M.metrics_at_k(
        spark.createDataFrame(held, "playlist_id string, track_id string"),
        spark.createDataFrame(recs, "playlist_id string, rank int, track_id string"), 3).collect()}
    assert set(got) == set(cases)
    for p, (_, _, recall, ndcg, hit) in cases.items():
        assert abs(got[p].recall - recall) < 1e-12 and abs(got[p].ndcg - ndcg) < 1e-12 and got[p].hit == hit, p


def test_metrics_stay_in_bounds_and_grow_with_k(spark):
    rng = random.Random(7)
    held = [(f"p{p}", f"t{rng.randint(0, 20)}") for p in range(100) for _ in range(rng.randint(1, 8))]
    recs = [(f"p{p}", r + 1, f"t{t}") for p in range(100) for r, t in enumerate(rng.sample(range(21), 9))]
    h = spark.createDataFrame(held, "playlist_id string, track_id string")
    r = spark.createDataFrame(recs, "playlist_id string, rank int, track_id string")
    small, large = ({x.playlist_id: x for x in M.metrics_at_k(h, r, k).collect()} for k in (2, 9))
    for p, x in small.items():
        assert 0 <= x.recall <= large[p].recall <= 1 and 0 <= x.ndcg <= 1 and 0 <= large[p].ndcg <= 1
        assert x.hit == (x.recall > 0) and x.hit <= large[p].hit


def test_ids_contiguous_and_bijective(spark):
    inter = T.interactions(spark, SF001)
    mapped, pmap, tmap = I.map_ids(inter)
    for m, c, i in ((pmap, "playlist_id", "playlist_int_id"), (tmap, "track_id", "track_int_id")):
        rows = m.collect()
        ids = sorted(r[i] for r in rows)
        assert ids == list(range(len(ids)))
        assert len({r[c] for r in rows}) == len(rows)
        # order-preserving: the id order equals the key order (dense_rank semantics)
        assert [r[c] for r in sorted(rows, key=lambda r: r[i])] == sorted(r[c] for r in rows)
    assert mapped.count() == inter.count()
