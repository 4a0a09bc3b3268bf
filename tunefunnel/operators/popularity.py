"""Popularity operators (A-06, L-03, L-04, P-16, K13).

Counts are a partial + final hash aggregate, so a hot track is combined map
side.  The top-n result is a ``TakeOrderedAndProject`` (per-partition top-n,
then a merge) and has at most ``n`` rows: a proven size bound, so callers may
broadcast it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_row_number, running_total

TRACK = "track_id"


def track_counts(inter: DataFrame, item: str = TRACK) -> DataFrame:
    """A-06: interaction count per track."""
    return inter.groupBy(item).agg(F.count(F.lit(1)).alias("n_interactions"))


def popularity_topk(inter: DataFrame, n: int = 20, item: str = TRACK) -> DataFrame:
    """L-03 (K12): top ``n`` tracks by count, ties broken by track id.

    Returns ``[rank, track_id, n_interactions]``, ``rank`` 1-based.
    """
    top = track_counts(inter, item).orderBy(F.desc("n_interactions"), F.asc(item)).limit(int(n))
    # at most n rows here: the global window is over a bounded table
    w = Window.orderBy(F.desc("n_interactions"), F.asc(item))
    return top.select(F.row_number().over(w).cast("long").alias("rank"), item,
                      F.col("n_interactions").cast("long").alias("n_interactions"))


def popular_head(inter: DataFrame, n_popular: int = 50, item: str = TRACK) -> DataFrame:
    """L-04: the set of the ``n_popular`` most interacted tracks."""
    return popularity_topk(inter, n_popular, item).select(item)


def track_ranks(inter: DataFrame, item: str = TRACK) -> DataFrame:
    """The 1-based popularity rank of every track, ``[track_id, rank]``, ties by track id."""
    return global_row_number(track_counts(inter, item), [F.desc("n_interactions"), F.asc(item)], "rank").select(
        item, F.col("rank").cast("long").alias("rank"))


def unseen_popularity(inter: DataFrame, seen: DataFrame, wanted: DataFrame, k: int = 20,
                      key: str = "playlist_id", item: str = TRACK) -> DataFrame:
    """K13 with its option on: places ``[key, rank, track_id]`` of the ``wanted``
    tracks in each playlist's own list of the ``k`` most popular tracks that it has
    not ``seen``.

    No list is built.  A track's place in the list is its popularity rank less the
    playlist's seen tracks of a better rank, so only seen and wanted tracks take
    part, and of those only ranks up to ``k`` plus the playlist's seen tracks.  The
    seen tracks are counted by a running sum over one global order by (playlist,
    rank), so a playlist that holds a third of all rows spreads over many tasks.
    Tracks that are both seen and wanted have no place; playlists or tracks that
    are null, and tracks without interactions, have none either.
    """
    marked = (seen.select(key, item, F.lit(1).alias("_seen"))
              .unionByName(wanted.select(key, item, F.lit(0).alias("_seen")))
              .dropna(subset=[key, item]).groupBy(key, item).agg(F.max("_seen").alias("_seen")))
    n_seen = marked.groupBy(key).agg(F.sum("_seen").alias("_n_seen"))
    near = (marked.join(track_ranks(inter, item), item).join(n_seen, key)
            .filter(F.col("rank") <= F.col("_n_seen") + int(k)).select(key, item, "rank", "_seen"))
    counted = running_total(near, [key, "rank"], "_seen", "_run").withColumn("_run", F.col("_run") - F.col("_seen"))
    first = counted.groupBy(key).agg(F.min("_run").alias("_first"))
    return (counted.filter("_seen = 0").join(first, key)
            .select(key, (F.col("rank") - (F.col("_run") - F.col("_first"))).alias("rank"), item)
            .filter(F.col("rank") <= int(k)))
