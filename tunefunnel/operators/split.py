"""Playlist sampling and the seed / held-out split (W-05, L-01, L-02, P-11, A-07, A-10, F-01, F-05).

The reference shuffles each playlist with a NumPy generator seeded by
``crc32(f"{seed}:{pid}")`` and hides the first ``max(1, int(n * frac))``
tracks.  Here every occurrence gets a deterministic md5 key
``md5(salt:playlist:track:occ)``; the first ``n_hold`` occurrences in key order
are held out.  That gives the same distribution, is repeatable whatever the
partitioning, and is expressible in any SQL engine (the oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BUCKET_ROWS, expand_occurrences, rank_by_hash_key

PLAYLIST = "playlist_id"
TRACK = "track_id"


def n_hold_expr(n, frac: float):
    """F-05: ``max(1, int(n * frac))`` — truncation of a double product (K9)."""
    return F.greatest(F.lit(1), (n.cast("double") * F.lit(float(frac))).cast("int"))


def stable_seed(df: DataFrame, salt, col: str = PLAYLIST, out: str = "stable_seed") -> DataFrame:
    """F-01: ``crc32(f"{salt}:{pid}")`` as a column (equals zlib.crc32)."""
    return df.withColumn(out, F.crc32(F.concat_ws(":", F.lit(str(salt)), F.col(col).cast("string"))))


def holdout_split(inter: DataFrame, frac: float = 0.2, salt="42",
                  group: str = PLAYLIST, item: str = TRACK) -> DataFrame:
    """W-05 over all playlists at once.

    Returns one row per interaction occurrence:
    ``[group, item, occ, n, n_hold, pos, held]`` with ``held`` 1 for held-out.
    Duplicate occurrences are split independently (K8).
    """
    sizes = inter.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    key = F.md5(F.concat_ws(":", F.lit(str(salt)), F.col(group), F.col(item), F.col("occ").cast("string")))
    if sizes.filter(F.col("_rows") > BUCKET_ROWS).isEmpty():
        # no large group: its rows move once, and are counted, keyed and ranked in place
        pairs = inter.repartition(group).groupBy(group, item).agg(F.count(F.lit(1)).alias("_c"))
        rows = pairs.select(group, item, F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("occ"))
        within = Window.partitionBy(group)
        ranked = (rows.dropna(subset=[group]).withColumn("_key", key)
                  .withColumn("pos", F.row_number().over(within.orderBy("_key")))
                  .withColumn("n", F.count(F.lit(1)).over(within)))
    else:
        pairs = inter.groupBy(group, item).agg(F.count(F.lit(1)).alias("_c"))
        rows = expand_occurrences(pairs, "_c", "occ").withColumn("_key", key)
        ranked = rank_by_hash_key(rows, [group], "_key", "pos", size_out="n", sizes=sizes)
    return ranked.select(
        group, item, F.col("occ").cast("long").alias("occ"), F.col("n").cast("long").alias("n"),
        n_hold_expr(F.col("n"), frac).cast("long").alias("n_hold"),
        F.col("pos").cast("long").alias("pos"),
        (F.col("pos") <= n_hold_expr(F.col("n"), frac)).cast("int").alias("held"),
    )


def eligible_playlists(inter: DataFrame, min_tracks: int = 10, group: str = PLAYLIST) -> DataFrame:
    """Playlists with at least ``min_tracks`` interaction rows (HAVING COUNT(*) >= min)."""
    return (inter.groupBy(group).agg(F.count(F.lit(1)).alias("n_tracks"))
                 .filter(F.col("n_tracks") >= min_tracks))


def sample_playlists(inter: DataFrame, n: int | None = 2000, min_tracks: int = 10,
                     salt="42", group: str = PLAYLIST) -> DataFrame:
    """L-02 / A-07: seeded sample of eligible playlists, repeatable whatever the
    partitioning: order by ``md5(salt:playlist)`` and keep the first ``n``
    (``TakeOrderedAndProject``: a per-partition top-n, then a merge).
    ``n=None`` keeps every eligible playlist.  Tracks stay in long form."""
    elig = eligible_playlists(inter, min_tracks, group).withColumn(
        "sample_key", F.md5(F.concat_ws(":", F.lit(str(salt)), F.col(group))))
    if n is None:
        return elig
    return elig.orderBy("sample_key", group).limit(int(n))


def first_playlists(mapped: DataFrame, n: int, id_col: str = "playlist_int_id") -> DataFrame:
    """L-01 (K11): the first ``n`` distinct playlist ids in id order."""
    return mapped.select(id_col).distinct().orderBy(id_col).limit(int(n))


def train_playlists(mapped: DataFrame, n: int = 10000, id_col: str = "playlist_int_id") -> DataFrame:
    """L-01 + P-11 + A-10: the first ``n`` playlists, kept when they have at
    least two tracks (one seed and one target); interactions stay long form."""
    chosen = first_playlists(mapped, n, id_col)
    sizes = (mapped.join(chosen, id_col, "left_semi")
                   .groupBy(id_col).agg(F.count(F.lit(1)).alias("n_tracks"))
                   .filter(F.col("n_tracks") >= 2))
    return sizes
