"""Ingestion operators (P-01..P-03, A-01, J-01, W-01, M-01, A-12, A-13, A-19, Q-01, Q-02).

All of them are declarative DataFrame plans; the only non-trivial one is the
contiguous id assignment, which avoids the single-task global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_to
from ..sources.schemas import FEATURES
from ..sources.slices import URI_PREFIX
from .ordering import global_row_number


def flatten_slices(slices: DataFrame, keep_uri: bool = False) -> DataFrame:
    """P-01 + P-02: playlists -> tracks as (playlist_id, track_id); the track id
    is the last ``:`` segment of the URI."""
    pl = slices.select(F.explode("playlists").alias("p"))
    tr = pl.select(F.col("p.pid").alias("pid"), F.explode("p.tracks").alias("t"))
    cols = [F.col("pid").cast("string").alias("playlist_id"),
            last_uri_segment(F.col("t.track_uri")).alias("track_id")]
    if keep_uri:
        cols.append(F.col("t.track_uri").alias("track_uri"))
    return tr.select(*cols)


def last_uri_segment(uri):
    """P-02 / F-06: ``uri.split(':')[-1]``."""
    return F.element_at(F.split(uri, ":", -1), -1)


def strip_uri_prefix(uri, prefix: str = URI_PREFIX):
    """P-03 / F-06: remove the first occurrence of ``prefix`` only (``regexp_replace``
    would remove every occurrence)."""
    pos = F.instr(uri, prefix)
    return F.when(pos > 0, F.overlay(uri, F.lit(""), pos, F.lit(len(prefix)))).otherwise(uri)


def catalog(interactions: DataFrame, archive: DataFrame) -> DataFrame:
    """A-01 + J-01: distinct interaction tracks LEFT JOIN the feature archive
    (whose ``track_uri`` is cleaned to a ``track_id`` first).  Tracks with no
    archive row keep NULL features."""
    tracks = interactions.select("track_id").distinct()
    feats = archive.select(strip_uri_prefix(F.col("track_uri")).alias("track_id"),
                           "artist_name", "track_name", *FEATURES)
    return tracks.join(feats, "track_id", "left")


def id_map(df: DataFrame, col: str, out: str) -> DataFrame:
    """W-01: ``DENSE_RANK() OVER (ORDER BY col) - 1`` for the distinct values
    of ``col``, computed without a single-task window (see ``ordering``)."""
    keys = df.select(col).distinct().filter(F.col(col).isNotNull())
    return global_row_number(keys, [col], out).withColumn(out, F.col(out) - 1)


def map_ids(interactions: DataFrame, playlist: str = "playlist_id", track: str = "track_id"):
    """S-08 body: ``interaction_matrix_mapped`` and its two id maps.

    Returns (mapped, playlist_map, track_map).  Maps are joined back with a
    plain equi join; AQE turns it into a broadcast when the map is small at
    run time, otherwise it stays a sort-merge join.
    """
    pmap = id_map(interactions, playlist, "playlist_int_id")
    tmap = id_map(interactions, track, "track_int_id")
    return with_ids(interactions, pmap, tmap, playlist, track), pmap, tmap


def with_ids(interactions: DataFrame, pmap: DataFrame, tmap: DataFrame, playlist: str = "playlist_id",
             track: str = "track_id") -> DataFrame:
    """Interactions with both int ids from their two dimensions."""
    return (interactions.join(pmap, playlist).join(tmap, track)
            .select(playlist, "playlist_int_id", track, "track_int_id"))


def confidence(mapped: DataFrame) -> DataFrame:
    """M-01 / A-13 / P-07 / P-09: one cell per (playlist, track) whose
    confidence is the number of duplicate rows (a CSR sums duplicates, K2)."""
    return (mapped.groupBy(F.col("playlist_int_id").cast("long").alias("playlist_int_id"),
                           F.col("track_int_id").cast("long").alias("track_int_id"))
                  .agg(F.count(F.lit(1)).alias("confidence")))


def matrix_stats(mapped: DataFrame) -> DataFrame:
    """A-12 + A-19: shape (max id + 1), rows, non-zeros, duplicates, density."""
    cells = confidence(mapped)
    return cells.agg(
        (F.max("playlist_int_id") + 1).cast("long").alias("n_playlists"),
        (F.max("track_int_id") + 1).cast("long").alias("n_tracks"),
        F.sum("confidence").cast("long").alias("n_interactions"),
        F.count(F.lit(1)).cast("long").alias("n_nonzero"),
        F.count_if(F.col("confidence") > 1).cast("long").alias("n_duplicate_cells"),
    ).withColumn("density", round_to(F.col("n_nonzero") / (F.col("n_playlists") * F.col("n_tracks")), 9))


def fk_orphans(interactions: DataFrame, metadata: DataFrame, key: str = "track_id") -> DataFrame:
    """Q-01: interaction tracks missing from the catalog, with their row counts."""
    counts = interactions.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("n_interactions"))
    return counts.join(metadata.select(key), key, "left_anti")


def pk_duplicates(metadata: DataFrame, key: str = "track_id") -> DataFrame:
    """Q-02: keys that occur more than once in the catalog."""
    return (metadata.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
                    .filter(F.col("n_rows") > 1))
