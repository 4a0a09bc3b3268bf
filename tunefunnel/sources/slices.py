"""Playlist slice documents (S-01, S-06) and table sinks (S-05, S-08).

A slice file holds one multi-line JSON document
``{"playlists": [{"pid": ..., "tracks": [{"track_uri": ...}, ...]}, ...]}``.
``read_slices`` scans a glob of them with an explicit schema (no inference
pass).  ``write_slices_from_tables`` produces such files from the driver's
tables so the source can be exercised at any scale: one playlist record per
order (a bounded group), at most ``orders_per_slice`` records per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SLICE
from .tables import table

# --- fixed value: the track URI scheme of the playlist slice documents ------
URI_PREFIX = "spotify:track:"
# --- end fixed value ---------------------------------------------------------


def track_uri_expr(partkey, linenumber):
    """Raw URI forms seen in slices: a plain id (line 1), a doubled prefix
    (line 3), otherwise the normal ``spotify:track:<id>`` URI (FIXTURES F3)."""
    pk = partkey.cast("string")
    return (F.when(linenumber == 1, pk)
             .when(linenumber == 3, F.concat(F.lit(URI_PREFIX + URI_PREFIX), pk))
             .otherwise(F.concat(F.lit(URI_PREFIX), pk)))


def interaction_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, pid, track_uri) rows: the content of the slice documents."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("o_custkey").alias("pid"),
        track_uri_expr(F.col("l_partkey"), F.col("l_linenumber")).alias("track_uri"))


def write_slices_from_tables(spark: SparkSession, sf_dir: str, out_dir: str,
                             orders_per_slice: int = 4000) -> str:
    """Write slice documents under ``out_dir/slice=<n>/part-*.json``; returns
    the glob to read them back."""
    rows = interaction_uris(spark, sf_dir)
    per_order = rows.groupBy("order_key", "pid").agg(
        F.collect_list(F.struct("track_uri")).alias("tracks"))
    per_slice = (per_order
                 .withColumn("slice", (F.col("order_key") / F.lit(orders_per_slice)).cast("long"))
                 .groupBy("slice")
                 .agg(F.collect_list(F.struct("pid", "tracks")).alias("playlists")))
    (per_slice.repartition("slice").write.mode("overwrite")
              .partitionBy("slice").json(out_dir))
    return f"{out_dir.rstrip('/')}/slice=*/*.json"


def read_slices(spark: SparkSession, path_glob: str) -> DataFrame:
    """S-01: multi-line JSON slice documents with an explicit schema."""
    return spark.read.schema(SLICE).option("multiLine", True).json(path_glob)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S-05 / S-08: drop-and-recreate semantics — always ``overwrite`` (K19)."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path
