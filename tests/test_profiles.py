"""Edge fixtures for profiles and features (K3, K4, K6, K23, P-18)."""
import pytest
from pyspark.sql import functions as F

from tunefunnel.operators import als as AL
from tunefunnel.operators import profiles as PR

META = [("a", 1.0), ("b", 3.0)]


def _meta(spark):
    cols = "track_id string, danceability double, tempo double, energy double, acousticness double, " \
           "loudness double, valence double"
    return spark.createDataFrame([(t, v, v, v, v, v, v) for t, v in META], cols)


def test_rows_vs_distinct_modes(spark):
    req = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "request_id string, track_id string")
    rows = PR.profiles(req, _meta(spark), mode="rows").first()
    dist = PR.profiles(req, _meta(spark), mode="distinct").first()
    assert abs(rows["avg_tempo"] - 5.0 / 3.0) < 1e-12 and rows["playlist_length"] == 3
    assert abs(dist["avg_tempo"] - 2.0) < 1e-12 and dist["playlist_length"] == 2


def test_empty_profile_per_request_kind(spark):
    req = spark.createDataFrame([("orphans", "zz"), ("orphans", "yy")], "request_id string, track_id string")
    assert PR.profiles(req, _meta(spark), mode="rows").count() == 0
    seed = PR.profiles(req, _meta(spark), mode="distinct", keep_empty=True).collect()
    assert len(seed) == 1 and seed[0]["avg_tempo"] is None and seed[0]["playlist_length"] == 0
    # candidates of a seed request with an empty profile are kept with NULL diffs
    cands = spark.createDataFrame([("orphans", 0, 0.9)], "request_id string, track_int_id long, als_score double")
    tmap = spark.createDataFrame([(0, "a")], "track_int_id long, track_id string")
    f = PR.candidate_features(cands, tmap, _meta(spark), PR.profiles(req, _meta(spark), mode="distinct",
                                                                     keep_empty=True), keep_unprofiled=True).collect()
    assert len(f) == 1 and f[0]["tempo_diff"] is None and f[0]["track_tempo"] == 1.0


def test_candidate_without_metadata_dropped(spark):
    cands = spark.createDataFrame([("p", 0, 0.9), ("p", 1, 0.8)], "request_id string, track_int_id long, als_score double")
    tmap = spark.createDataFrame([(0, "a"), (1, "nometa")], "track_int_id long, track_id string")
    prof = spark.createDataFrame([("p",)], "request_id string").select(
        "request_id", *[F.lit(2.0).alias(f"avg_{c}") for c in
                        ["danceability", "tempo", "energy", "acousticness", "loudness", "valence"]])
    f = PR.candidate_features(cands, tmap, _meta(spark), prof).collect()
    assert [r["track_id"] for r in f] == ["a"] and f[0]["tempo_diff"] == 1.0


def test_unknown_seeds_get_no_vector(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, features array<float>")
    conf = AL.seed_confidence(spark.createDataFrame([(7, 99), (8, 1)], "request_id long, item_id long"))
    got = {r.request_id for r in AL.fold_in(conf, items).collect()}
    assert got == {8}


def test_request_frame_type_check(spark):
    ok = spark.createDataFrame([(1, 5)], "request_id long, playlist_int_id long")
    PR.check_request_frame(ok, "playlist")
    with pytest.raises(TypeError):
        PR.check_request_frame(ok, "seeds")
    with pytest.raises(TypeError):
        PR.check_request_frame(ok, "other")
