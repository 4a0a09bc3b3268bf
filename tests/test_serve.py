"""S-12, P-18, K23: request rows of either kind through both stages."""
import pytest

from data_dirs import SF001
from tunefunnel.plans import cache as C
from tunefunnel.plans import recommend as REC

SMALL = REC.Params(rank=4, iters=2, n_candidates=40, k=5, n_train=60, n_trees=2, depth=2)


def test_requests_of_both_kinds(spark):
    known = [r.track_id for r in C.track_metadata(spark, SF001).select("track_id").orderBy("track_id").limit(6).collect()]
    rows = [(7, t) for t in known] + [(8, known[0]), (8, "no such track"), (9, "no such track")]
    recs, unserved = REC.serve(spark, SF001, rows, "seeds", SMALL)
    got = recs.collect()
    assert {r.request_id for r in got} == {7, 8} and {r.request_id for r in unserved.collect()} == {9}
    for request, seeds in ((7, set(known)), (8, {known[0]})):
        for arm in ("engine", "als_only"):
            mine = sorted((r.rank, r.track_id) for r in got if (r.request_id, r.arm) == (request, arm))
            assert [r for r, _ in mine] == [1, 2, 3, 4, 5] and not seeds & {t for _, t in mine}

    recs, unserved = REC.serve(spark, SF001, [(70, 3), (71, 3), (72, 10 ** 9)], "playlist", SMALL)
    by = {}
    for r in recs.collect():
        by.setdefault(r.request_id, set()).add((r.arm, r.rank, r.track_id))
    assert by[70] == by[71] and set(by) == {70, 71} and len(by[70]) == 10
    assert {r.request_id for r in unserved.collect()} == {72}


def test_other_kinds_and_types_are_refused(spark):
    with pytest.raises(TypeError):
        REC.serve(spark, SF001, [(1, "x")], "artist", SMALL)
    with pytest.raises(TypeError):
        REC.serve(spark, SF001, spark.createDataFrame([(1, 2)], "request_id long, track_id long"), "seeds", SMALL)
