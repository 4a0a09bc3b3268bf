"""K13 with its option on: popularity lists without a playlist's own seeds."""
import random

from tunefunnel.operators.popularity import unseen_popularity


def test_places_equal_those_of_built_lists(spark):
    rnd = random.Random(5)
    inter = [(f"p{rnd.randrange(30)}", f"t{int(rnd.paretovariate(0.7)) % 60}") for _ in range(900)]
    inter += [("hot", f"t{i}") for i in range(40)]
    seen = [r for i, r in enumerate(inter) if i % 3]
    wanted = [r for i, r in enumerate(inter) if not i % 3] + [("new", "t1"), ("new", "none"), (None, "t1"), ("p1", None)]
    frame = lambda rows: spark.createDataFrame(rows, "playlist_id string, track_id string")
    for k in (1, 5, 20):
        got = {(r.playlist_id, r.track_id): r["rank"] for r in unseen_popularity(frame(inter), frame(seen), frame(wanted), k).collect()}
        counts = {}
        for _, t in inter:
            counts[t] = counts.get(t, 0) + 1
        ranked = sorted(counts, key=lambda t: (-counts[t], t))
        want = {}
        for p in {p for p, _ in wanted if p}:
            own = {t for q, t in seen if q == p}
            top = [t for t in ranked if t not in own][:k]
            want.update({(p, t): top.index(t) + 1 for q, t in wanted if q == p and t in top})
        assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "playlist_id string, track_id string")
    assert unseen_popularity(none, none, none, 5).count() == 0
