"""Two-pass Bloom filtering: find the rows whose key may be repeated, and let
only those shuffle.

Pass 1 hashes each key to ``n_hashes`` bit positions and counts the rows of
each position, with partial aggregation before the shuffle (a key that a third
of all rows share leaves each task as one count).  Positions hit twice or more
form the bitmap.  Pass 2 tests every row against the bitmap: a row with a
position of its own is certainly unique and never shuffles; the rest, all
repeated keys and a few false positives, are grouped exactly.

The bitmap is the only broadcast.  Its size is bounded by ``MAX_FILTER_BITS``
(128 MiB) whatever the input; rows per bit beyond that only make more rows take
the exact path, they never change the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Filter bits for each row; with two hashes about 0.4 % of unique rows are
#: taken for repeated ones.
BITS_PER_ROW = 32
#: Bit positions of a key.
N_HASHES = 2
#: Upper bound of the broadcast filter, in bits (2^30 bits are 128 MiB).
MAX_FILTER_BITS = 1 << 30
#: A group is hot beyond this part of all rows, and this many rows; its rows
#: are then dealt over so many tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 64
#: Bits of one bitmap row: Spark's bitmaps hold 4,096 bytes.
BUCKET_BITS = 8 * 4096

_BITS, _BUCKET = "__rp_bits", "__rp_bucket"
BEST, SIZE = "__rp_best", "__rp_size"


def filter_bits(n_rows: int, bits_per_row: int = BITS_PER_ROW,
                max_bits: int = MAX_FILTER_BITS) -> int:
    """Power of two of at least ``bits_per_row`` bits a row, one bitmap row at
    least and ``max_bits`` at most."""
    need = max(BUCKET_BITS, n_rows * bits_per_row)
    return min(max_bits, 1 << (need - 1).bit_length())


def positions(key: str, n_bits: int, n_hashes: int = N_HASHES) -> list[Column]:
    """The bit positions of a key column."""
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)]


def bitmap(position_rows: DataFrame) -> DataFrame:
    """Bitmap rows (bucket, 4 KiB of bits) of a frame of distinct positions ``p``."""
    return (position_rows
            .groupBy(F.expr(f"p div {BUCKET_BITS}").alias(_BUCKET))
            .agg(F.bitmap_construct_agg(F.col("p") % BUCKET_BITS).alias(_BITS)))


def repeated_filter(rows: DataFrame, key: str, n_bits: int, n_hashes: int = N_HASHES) -> DataFrame:
    """Pass 1: the bitmap of all positions that two rows or more hit."""
    hits = rows.select(F.explode(F.array(*positions(key, n_bits, n_hashes))).alias("p"))
    return bitmap(hits.groupBy("p").count().filter("count > 1").select("p"))


def member_filter(rows: DataFrame, key: str, n_bits: int, n_hashes: int = N_HASHES) -> DataFrame:
    """The bitmap of all positions of the given keys (an ordinary Bloom filter)."""
    hits = rows.select(F.explode(F.array(*positions(key, n_bits, n_hashes))).alias("p"))
    return bitmap(hits.distinct())


def tested(rows: DataFrame, key: str, filter_rows: DataFrame, n_bits: int, flag: str,
           n_hashes: int = N_HASHES) -> DataFrame:
    """Pass 2: ``rows`` with the boolean ``flag``, false only for rows that
    certainly miss the filter.  The filter is broadcast; rows stay in place."""
    names = rows.columns
    hit = []
    for i, p in enumerate(positions(key, n_bits, n_hashes)):
        at, bits = f"__rp_p{i}", f"{_BITS}{i}"
        side = filter_rows.select(F.col(_BUCKET).alias(f"{_BUCKET}{i}"), F.col(_BITS).alias(bits))
        rows = rows.withColumn(at, p)
        rows = rows.join(F.broadcast(side),
                         F.expr(f"{at} div {BUCKET_BITS}") == side[f"{_BUCKET}{i}"], "left")
        byte = F.conv(F.hex(F.expr(f"substring({bits}, int({at} % {BUCKET_BITS} div 8) + 1, 1)")), 16, 10)
        hit.append(F.coalesce(F.getbit(byte.cast("long"), (F.col(at) % 8).cast("int")) == 1, F.lit(False)))
    return rows.select(*(F.col(f"`{c}`") for c in names), reduce(lambda a, b: a & b, hit).alias(flag))


def split_repeated(rows: DataFrame, key: str, own: str, narrow: DataFrame | None = None,
                   max_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` into those whose ``key`` is certainly unique and those
    that may be repeated, both with ``BEST`` (the least ``own`` of all rows of
    the key) and ``SIZE`` (their number).  ``key`` must not be null.

    ``narrow``, if given, holds the columns ``key`` and ``own`` of the same rows
    where they are cheaper to read.  The first frame never shuffles.  The second
    is an equi join with the partially aggregated groups of the rows that may be
    repeated; there a group of more than ``HOT_SHARE`` of the rows is dealt over
    ``SALTS`` tasks.
    """
    narrow = rows.select(key, own) if narrow is None else narrow.select(key, own)
    n = narrow.count()
    n_bits = filter_bits(n, max_bits=max_bits)
    keep = rows.columns
    bits = repeated_filter(narrow, key, n_bits)
    flagged = tested(rows, key, bits, n_bits, "__rp_maybe")
    unique = flagged.filter(~F.col("__rp_maybe")).select(
        *(F.col(f"`{c}`") for c in keep), F.col(own).alias(BEST), F.lit(1).cast("long").alias(SIZE))
    maybe = flagged.filter("__rp_maybe")
    groups = written(tested(narrow, key, bits, n_bits, "__rp_maybe").filter("__rp_maybe")
                     .groupBy(F.col(key).alias("__rp_key")).agg(F.min(own).alias(BEST), F.count(F.lit(1)).alias(SIZE))
                     .withColumn("__rp_hot", F.col(SIZE) > max(HOT_ROWS, n // HOT_SHARE)), "groups")
    # No more than HOT_SHARE groups can be hot.
    hot = groups.filter("__rp_hot").select(F.col("__rp_key").alias("__rp_hot_key"))
    salted = maybe.join(F.broadcast(hot), maybe[key] == hot["__rp_hot_key"], "left").withColumn(
        "__rp_salt", F.when(F.col("__rp_hot_key").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")))
    dealt = groups.withColumn("__rp_group_salt", F.explode(
        F.sequence(F.lit(0), F.when(F.col("__rp_hot"), SALTS - 1).otherwise(0))))
    joined = salted.join(dealt, (F.col(key) == F.col("__rp_key")) & (F.col("__rp_salt") == F.col("__rp_group_salt")))
    return unique, joined.select(*(F.col(f"`{c}`") for c in keep), BEST, SIZE)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not among the distinct keys of ``gone`` (a frame
    of one column).  A Bloom filter of ``gone`` lets the other rows pass in
    place; only its hits shuffle for the exact anti join.  Null keys stay."""
    gone = gone.select(F.col(gone.columns[0]).alias("__rp_gone"))
    n_bits = filter_bits(gone.count())
    packed = rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("__rp_row"),
                         rows[f"`{key}`"].alias("__rp_key"))
    flagged = tested(packed, "__rp_key", member_filter(gone, "__rp_gone", n_bits), n_bits, "__rp_maybe")
    kept = flagged.filter("__rp_maybe").join(gone, F.col("__rp_key") == F.col("__rp_gone"), "left_anti")
    both = flagged.filter(~F.col("__rp_maybe")).unionByName(kept)
    return both.select(*(F.col(f"__rp_row.`{c}`") for c in rows.columns))
