"""Shared intermediate tables, written once per application.

Several plans read the same derived tables (the interaction bag, the
catalog, the id-mapped interactions, the evaluation split).  Recomputing
them inside every branch multiplies scans and shuffles; instead each is
written once to the shared checkpoint folder (``spark.checkpoint.dir``) and
every later plan reads the written copy.  This is also what cuts lineage:
a lost executor re-reads the written table instead of recomputing the joins
behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.schemas import INTERACTIONS, INTERACTIONS_MAPPED, TRACK_METADATA, conform
from ..session import shared_copy  # noqa: F401 - also for the plans

_TABLES: dict = {}


def shared_table(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Build, write (Parquet in the shared folder) and memoise a table for this
    application.  A table that is rewritten under the same path in one
    application is not noticed."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _TABLES:
        _TABLES[k] = shared_copy(build(), str(key[0]))
    return _TABLES[k]


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import tables as T
    return shared_table(spark, ("interactions", sf_dir), lambda: conform(T.interactions(spark, sf_dir), INTERACTIONS))


def track_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import tables as T
    return shared_table(spark, ("track_metadata", sf_dir), lambda: conform(T.track_metadata(spark, sf_dir), TRACK_METADATA))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interaction_matrix_mapped (written once)."""
    from ..operators import ingest as I
    return shared_table(spark, ("mapped", sf_dir), lambda: conform(I.with_ids(
        interactions(spark, sf_dir), playlist_map(spark, sf_dir), track_map(spark, sf_dir)), INTERACTIONS_MAPPED))


def playlist_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playlist id dimension (written once)."""
    from ..operators import ingest as I
    return shared_table(spark, ("playlist_map", sf_dir),
                        lambda: I.id_map(interactions(spark, sf_dir), "playlist_id", "playlist_int_id"))


def track_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track id dimension (written once)."""
    from ..operators import ingest as I
    return shared_table(spark, ("track_map", sf_dir),
                        lambda: I.id_map(interactions(spark, sf_dir), "track_id", "track_int_id"))
