"""Q-01, Q-02, S-05: keys checked at write time; W-01, S-06: growing ids."""
from pyspark.sql import functions as F

from tunefunnel.operators import ingest as I
from tunefunnel.session import scratch_path
from tunefunnel.sources import constrained as CN
from tunefunnel.streaming import growing_ids as G

SCHEMA = "track_id string, track_name string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _table(spark, path, df):
    return _rows(CN.read_table(spark, path, df.schema)), _rows(CN.read_rejected(spark, path, df.schema))


def test_catalog_rejects_and_publishes(spark):
    path = scratch_path(spark, "catalog")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = frame([("a", "x"), ("a", "x"), ("a", "b"), ("b", None), ("b", "z"), (None, "n"), (None, "n"), ("c", "c")])
    CN.append_catalog(first, path, "1")
    kept = [("a", "b"), ("b", None), ("c", "c")]
    rejected = [("a", "x", "repeated key", 2), ("b", "z", "repeated key", 1), (None, "n", "null key", 2)]
    assert _table(spark, path, first) == (kept, sorted(rejected, key=str))
    CN.append_catalog(frame([("c", "new"), ("d", "d"), ("d", "d")]), path, "2")
    kept.append(("d", "d"))
    rejected += [("c", "new", "key exists", 1), ("d", "d", "repeated key", 1)]
    for again, batch in ((first, "1"), (first.limit(0), "3"), (first, "2")):  # replays and an empty batch
        CN.append_catalog(again, path, batch)
        assert _table(spark, path, first) == (kept, sorted(rejected, key=str))


def test_interactions_need_a_known_track(spark):
    path = scratch_path(spark, "interactions")
    catalog = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], SCHEMA)
    rows = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "q"), ("r", "q"), ("r", "q"), ("s", None)],
                                 "playlist_id string, track_id string")
    CN.publish(CN.check_foreign_key(rows, "track_id", catalog, "track_id")[1], path + ".rejected", "1")
    CN.append_interactions(rows, path, "1", catalog)   # the run before ended after its rejects
    assert _table(spark, path, rows) == ([("p", "a"), ("p", "a"), ("s", None)],
                                         [("p", "q", "unknown key", 1), ("r", "q", "unknown key", 2)])


def test_ids_grow_and_replays_change_nothing(spark):
    folder = scratch_path(spark, "growing")
    slices = [[("p2", "t5"), ("p2", "t5"), ("p1", "t9"), (None, "t1")], [("p0", "t9"), ("p2", "t0"), ("p3", None)]]
    frames = [spark.createDataFrame(s, "playlist_id string, track_id string") for s in slices]
    write = G.batch_writer(folder, "s")
    write(frames[0], 0)
    before = [_rows(t) for t in G.read_mapped(spark, folder)]
    write(frames[0], 0)
    assert [_rows(t) for t in G.read_mapped(spark, folder)] == before
    write(frames[1], 1)
    after = [_rows(t) for t in G.read_mapped(spark, folder)]
    write(frames[0], 0)
    write(frames[1], 1)
    assert [_rows(t) for t in G.read_mapped(spark, folder)] == after
    assert all(set(b) <= set(a) for b, a in zip(before, after))      # an id once given stays
    assert after[1] == [("p0", 2), ("p1", 0), ("p2", 1), ("p3", 3)]
    assert after[2] == [("t0", 3), ("t1", 0), ("t5", 1), ("t9", 2)]
    # the one-shot map has the same keys and the same set of ids
    whole = frames[0].unionByName(frames[1])
    for table, col, out in ((after[1], "playlist_id", "playlist_int_id"), (after[2], "track_id", "track_int_id")):
        once = _rows(I.id_map(whole, col, out).select(col, out))
        assert [k for k, _ in once] == [k for k, _ in table] and {i for _, i in once} == {i for _, i in table}
    assert len(after[0]) == whole.dropna().count()


def test_a_batch_cut_off_is_written_anew(spark):
    folder = scratch_path(spark, "growing")
    rows = spark.createDataFrame([("p1", "t1"), ("p2", "t2")], "playlist_id string, track_id string")
    G.append_ids(rows, "track_id", "track_int_id", f"{folder}/{G.TRACKS}", "s-0")  # ended before the mapped rows
    G.append_mapped(rows, folder, "s-0")
    mapped, playlists, tracks = G.read_mapped(spark, folder)
    assert _rows(mapped) == [("p1", 0, "t1", 0), ("p2", 1, "t2", 1)] and tracks.count() == playlists.count() == 2
    G.append_mapped(rows.limit(0), folder, "s-1")
    assert G.read_mapped(spark, folder)[0].agg(F.count("*")).first()[0] == 2
