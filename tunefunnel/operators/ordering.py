"""Skew-safe numbering primitives shared by several operators.

* ``global_row_number`` — a row number over one global order without moving
  every row to one task (the plain ``row_number().over(Window.orderBy(x))``
  does exactly that).  Range-partition, sort within partitions, tag rows with
  ``monotonically_increasing_id`` (partition index in the high bits, position
  in the low bits), pin the layout by writing the table, then add the
  running total of the per-partition counts (a table with one row per
  partition, so its size is bounded by the partition count).
* ``expand_occurrences`` — turn (key, count) back into ``count`` rows with an
  occurrence number 1..count; copies of one hot pair are generated in chunks
  spread over many tasks instead of in the task that holds the pair.
* ``rank_by_hash_key`` — position of each row within its group in the order
  of a digest: windows over ranges of the digest, more of them the larger the
  group, plus the histogram's rows before the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_copy

_LOW_BITS = (1 << 33) - 1
# Copies of one pair generated by a single task when expanding counts.
EXPAND_CHUNK = 100_000
# Rows that one window ranks, on average, in a group that is larger.
BUCKET_ROWS = 1 << 18
# Large groups up to which their table is broadcast.
BROADCAST_GROUPS = 100_000


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number over the global order of ``order_cols``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = shared_copy(tagged, "numbered")
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33)) \
                   .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a proven bound, safe to window globally and broadcast
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.select("_part", F.coalesce("_off", F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_part")
                  .withColumn(out, F.col("_off") + F.col("_pos") + 1)
                  .drop("_mid", "_part", "_pos", "_off"))


def running_total(df: DataFrame, order_cols: list[str], weight: str, out: str) -> DataFrame:
    """The sum of ``weight`` over all rows up to each row, in the global order of
    ``order_cols`` (distinct).  Rows are range-sorted and written; each task's
    total is added to the ones after it, and a window runs within each task's rows."""
    tagged = (df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order_cols)
              .sortWithinPartitions(*order_cols).withColumn("_part", F.spark_partition_id()))
    tagged = shared_copy(tagged, "running")
    sums = tagged.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    # one row per partition
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order_cols)
                                .rowsBetween(Window.unboundedPreceding, 0))
    return (tagged.withColumn(out, within).join(F.broadcast(before), "_part")
            .withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before"))


def expand_occurrences(pairs: DataFrame, count_col: str, occ_col: str = "occ",
                       chunk: int = EXPAND_CHUNK) -> DataFrame:
    """(keys..., count) -> one row per copy with ``occ`` in 1..count."""
    keys = [c for c in pairs.columns if c != count_col]
    cold = pairs.filter(F.col(count_col) <= chunk).select(
        *keys, F.explode(F.sequence(F.lit(1), F.col(count_col).cast("long"))).alias(occ_col))
    hot = pairs.filter(F.col(count_col) > chunk).select(
        *keys, F.col(count_col).cast("long").alias("_c"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(count_col).cast("long") - 1,
                             F.lit(chunk).cast("long"))).alias("_start"))
    # spread the chunk starts of a hot pair over tasks before generating copies
    hot = hot.repartition("_start", *keys).select(
        *keys, F.explode(F.sequence(F.col("_start") + 1,
                                    F.least(F.col("_start") + chunk, F.col("_c")))).alias(occ_col))
    return cold.unionByName(hot)


def rank_by_hash_key(df: DataFrame, group: list[str], key: str, out: str = "pos",
                     size_out: str | None = None, bucket_rows: int = BUCKET_ROWS,
                     sizes: DataFrame | None = None) -> DataFrame:
    """1-based position of each row inside ``group`` in the order of ``key``
    (and, with ``size_out``, the group's row count).  ``key`` is a hex digest of at
    least eight digits, distinct within its group.  ``sizes`` (group, ``_rows``) are the
    groups' row counts where the caller has them for less.  Rows of a null group are left out.

    Digests are spread evenly, so a group of more than ``bucket_rows`` rows is cut
    into that many even ranges of the digests' first 32 bits, each about
    ``bucket_rows`` rows, and a window ranks each range; a histogram of the ranges
    gives the rows before it.  All other groups are one range.  Rows move once, by
    (group, range); only the histograms of the large groups are joined.
    """
    df = df.dropna(subset=group)
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")) if sizes is None else sizes
    large = counted.filter(F.col("_rows") > bucket_rows).select(
        *group, "_rows", F.ceil(F.col("_rows") / F.lit(bucket_rows)).cast("long").alias("_ranges"))
    n_large = large.count()
    if n_large:
        large = shared_copy(large, "large-groups")
    if n_large == 0:
        ranged = df.withColumn("_range", F.lit(0).cast("long"))
        keys = group
    else:
        # at most one row for each ``bucket_rows`` rows; beyond the bound a plain join
        side = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
        first = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
        ranged = df.join(side, group, "left").withColumn(
            "_range", F.coalesce(F.shiftright(first * F.col("_ranges"), 32), F.lit(0).cast("long"))).drop("_rows", "_ranges")
        keys = [*group, "_range"]
    within = Window.partitionBy(*keys)
    ranked = ranged.withColumn(out, F.row_number().over(within.orderBy(key)).cast("long"))
    if size_out:
        ranked = ranked.withColumn(size_out, F.count(F.lit(1)).over(within))
    if n_large == 0:
        return ranked.drop("_range")
    side = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    counts = ranged.join(side.select(*group, "_rows"), group).groupBy(*group, "_rows", "_range").agg(
        F.count(F.lit(1)).alias("_n"))
    # one row per range of a large group
    before = counts.select(*group, "_range", "_rows", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    res = ranked.join(shared_copy(before, "ranges"), [*group, "_range"], "left").withColumn(
        out, F.col(out) + F.coalesce("_before", F.lit(0)))
    if size_out:
        res = res.withColumn(size_out, F.coalesce("_rows", size_out))
    return res.drop("_range", "_rows", "_before")
