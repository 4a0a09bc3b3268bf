"""W-01, S-06: id dimensions that grow with the slices.

The reference maps ids once, over all interactions.  Here every batch of new
interactions gives ids only to keys that no batch before it had: they are numbered
after the present maximum, in key order, so ids stay contiguous from 0 and an id
once given never changes.

Each batch writes one folder per table, named by the batch; the marker that Spark
leaves in a finished folder is the ledger.  A batch that finds its folder finished
writes nothing, one that was cut off before writes it anew over the same earlier
batches.  So a replayed or half-done batch changes nothing that was given.  One
writer at a time.  Null keys get no id and their rows no mapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import flatten_slices, with_ids
from ..operators.ordering import global_row_number
from ..sources.constrained import exists
from ..sources.schemas import SLICE

PLAYLISTS, TRACKS, ROWS = "playlist_map", "track_map", "mapped"


def finished(spark: SparkSession, folder: str, batch: str) -> bool:
    """The ledger: has this batch of the table been written whole?"""
    return exists(spark, f"{folder}/batch={batch}/_SUCCESS")


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all finished batches; none where nothing is written yet."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch string").parquet(folder).drop("batch")


def append_ids(df: DataFrame, col: str, out: str, folder: str, batch: str) -> DataFrame:
    """Give ids to the keys of ``df`` that have none; the dimension with them."""
    spark, schema = df.sparkSession, f"{col} string, {out} long"
    if not finished(spark, folder, batch):
        known = read_batches(spark, folder, schema)
        first = known.agg(F.max(out)).first()[0]
        new = df.select(F.col(col).cast("string").alias(col)).filter(F.col(col).isNotNull()).distinct().join(
            known, col, "left_anti")
        numbered = global_row_number(new, [col], out)
        numbered.select(col, (F.col(out) + (-1 if first is None else int(first))).cast("long").alias(out)) \
            .write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return read_batches(spark, folder, schema)


def append_mapped(interactions: DataFrame, folder: str, batch: str) -> None:
    """Both dimensions and the mapped rows of one batch of interactions."""
    spark = interactions.sparkSession
    if finished(spark, f"{folder}/{ROWS}", batch):
        return
    playlists = append_ids(interactions, "playlist_id", "playlist_int_id", f"{folder}/{PLAYLISTS}", batch)
    tracks = append_ids(interactions, "track_id", "track_int_id", f"{folder}/{TRACKS}", batch)
    with_ids(interactions, playlists, tracks).write.mode("overwrite").parquet(f"{folder}/{ROWS}/batch={batch}")


def read_mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapped, playlist_map, track_map) of all batches."""
    return (read_batches(spark, f"{folder}/{ROWS}",
                         "playlist_id string, playlist_int_id long, track_id string, track_int_id long"),
            read_batches(spark, f"{folder}/{PLAYLISTS}", "playlist_id string, playlist_int_id long"),
            read_batches(spark, f"{folder}/{TRACKS}", "track_id string, track_int_id long"))


def batch_writer(folder: str, stream: str) -> Callable[[DataFrame, int], None]:
    """The function for ``writeStream.foreachBatch`` over flattened slices.
    ``stream`` names the checkpoint: batch numbers start again with a new one."""
    def write(batch: DataFrame, number: int) -> None:
        append_mapped(batch, folder, f"{stream}-{number}")

    return write


def ingest_mapped_stream(spark: SparkSession, source_glob: str, folder: str, checkpoint: str, stream: str,
                         bytes_per_trigger: int = 1 << 30):
    """Drain the slices that are there into the growing tables below ``folder``."""
    slices = (spark.readStream.schema(SLICE).option("multiLine", True)
              .option("maxBytesPerTrigger", bytes_per_trigger).json(source_glob))
    query = (flatten_slices(slices).writeStream.foreachBatch(batch_writer(folder, stream))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
