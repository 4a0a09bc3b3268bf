"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder of ``spark.checkpoint.dir``
    and read it back.  The copy cuts the lineage: after the loss of an executor
    later plans read it again instead of recomputing what lies behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and the Python workers.  Texts are long:
#: at Spark's default of 64 MiB the buffers of both sides take hundreds of MB for
#: each task.
ARROW_BYTES = 4 << 20
_ARROW, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and bound the Arrow
    batches of the session at ``ARROW_BYTES`` unless they were set."""
    ship_package(spark)
    if spark.conf.get(_ARROW, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def text_or_empty(column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
