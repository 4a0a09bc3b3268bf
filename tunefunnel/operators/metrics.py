"""Offline ranking metrics for all playlists at once (E-01..E-05, A-16, J-11, F-03, F-04).

Semantics follow the reference exactly (K7):

* recall@k = |set(rec[:k]) & set(held)| / len(held)   (denominator counts duplicates)
* NDCG@k   = sum over rec[:k] hits of 1/log2(rank+1) / IDCG,
  IDCG uses min(|set(held)|, k) ideal positions; 0 when IDCG is 0
* hit@k    = 1 if any of rec[:k] is held out

Every playlist with a held-out track is scored; zero-hit playlists stay in the
mean because hits are LEFT JOINed onto the held-out side (E-04).

Recommendations come in two shapes:
* per-playlist lists ``[key, rank, item]`` — equi-joined on (key, item);
* a list shared by every playlist (popularity) ``[rank, item]`` — at most k
  rows, broadcast and equi-joined on the item only, so the
  playlists x list product is never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "playlist_id"
ITEM = "track_id"


def discount(rank: Column) -> Column:
    """F-03: 1/log2(rank+1) for a 1-based rank (= 1/log2(i+2) for 0-based i)."""
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """F-04 + IDCG: sum of discounts over the first min(n, k) positions."""
    m = F.least(n_relevant.cast("int"), F.lit(int(k)))
    return F.when(m <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                    lambda acc, i: acc + F.lit(1.0) / F.log2(i.cast("double") + F.lit(1.0))))


def metrics_at_k(held: DataFrame, recs: DataFrame, k: int = 20, key: str = KEY,
                 item: str = ITEM, shared: bool = False) -> DataFrame:
    """E-01 recall, E-02 NDCG and E-03 hit per playlist:
    ``[key, n_held, n_held_distinct, n_hits, recall, ndcg, hit]``.

    ``held`` is the held-out bag ``[key, item]``; ``recs`` is ``[key, rank, item]``
    or, with ``shared=True``, one list ``[rank, item]`` for every playlist.
    """
    # one aggregation of the held-out bag: copies per distinct pair
    pairs = held.select(key, item).groupBy(key, item).agg(F.count(F.lit(1)).alias("_c"))
    top = recs.filter(F.col("rank") <= k)
    on = [item] if shared else [key, item]
    listed = top.groupBy(*on).agg(F.count(F.lit(1)).alias("_h"), F.sum(discount(F.col("rank"))).alias("_d"))
    marked = pairs.join(F.broadcast(listed) if shared else listed, on, "left")
    # one pass by playlist; rows of no playlist hit nothing
    known = F.col(key).isNotNull()
    out = marked.groupBy(key).agg(
        F.sum("_c").alias("n_held"), F.count(F.lit(1)).alias("n_held_distinct"),
        F.sum(F.when(known, F.col("_h"))).alias("n_hits"), F.sum(F.when(known, F.col("_d"))).alias("_dcg"))
    n_hits = F.coalesce(F.col("n_hits"), F.lit(0)).cast("long")
    idcg = ideal_dcg(F.col("n_held_distinct"), k)
    return out.select(
        key,
        F.col("n_held").cast("long").alias("n_held"),
        F.col("n_held_distinct").cast("long").alias("n_held_distinct"),
        n_hits.alias("n_hits"),
        F.when(F.col("n_held") > 0, n_hits / F.col("n_held")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(idcg > 0, F.coalesce(F.col("_dcg"), F.lit(0.0)) / idcg)
         .otherwise(F.lit(0.0)).alias("ndcg"),
        (n_hits > 0).cast("int").alias("hit"),
    )


def longtail_heldout(held: DataFrame, head: DataFrame, item: str = ITEM) -> DataFrame:
    """P-16 / U-04: held-out rows whose track is not in the popular head.
    ``head`` has at most ``n_popular`` rows (a parameter), so it is broadcast."""
    return held.join(F.broadcast(head.select(item)), item, "left_anti")


def heldout_composition(held: DataFrame, head: DataFrame, key: str = KEY,
                        item: str = ITEM) -> DataFrame:
    """A-16: popular / long-tail held-out counts, % long-tail, playlists with >= 1."""
    flagged = held.join(F.broadcast(head.select(item).withColumn("_pop", F.lit(1))), item, "left")
    is_pop = F.col("_pop").isNotNull()
    per_key = flagged.groupBy(key).agg(F.count_if(is_pop).alias("_pop_n"),
                                       F.count_if(~is_pop).alias("_lt"))
    out = per_key.agg(
        F.sum("_pop_n").cast("long").alias("n_popular_heldout"),
        F.sum("_lt").cast("long").alias("n_longtail_heldout"),
        F.count_if(F.col("_lt") > 0).cast("long").alias("n_playlists_with_longtail"),
        F.count(F.lit(1)).cast("long").alias("n_playlists"))
    all_n = F.col("n_popular_heldout") + F.col("n_longtail_heldout")
    return out.withColumn(
        "pct_longtail",
        F.round(F.when(all_n > 0, F.lit(100.0) * F.col("n_longtail_heldout") / all_n), 6))


def summarize_arms(per_playlist: DataFrame, group_cols=("arm",)) -> DataFrame:
    """A-15: mean of each metric by arm, with the number of playlists."""
    return per_playlist.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("long").alias("n_playlists"),
        F.avg("recall").alias("recall_at_k"),
        F.avg("ndcg").alias("ndcg_at_k"),
        F.avg("hit").alias("hit_rate"),
    )


__all__ = ["metrics_at_k", "longtail_heldout", "heldout_composition", "summarize_arms",
           "discount", "ideal_dcg"]
