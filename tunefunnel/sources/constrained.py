"""Q-01, Q-02, S-05: keys checked when a table is written.

The reference's tables declare a primary key (the catalog's track id) and a
foreign key (an interaction's track must be in the catalog).  Here a write is
staged: the offered rows are checked by joins, offenders go to a reject table
beside the target with the reason and their number of copies, and only then is
the batch published in the target by one rename.

* Primary key: a null key is rejected (``null key``), so is a key that the
  published table has (``key exists``); of rows that share a key the least one,
  compared column by column, is kept and the others are rejected
  (``repeated key``), copies of the kept row included.
* Foreign key: a null reference passes, as in SQL; any other that the referenced
  table lacks is rejected (``unknown key``).

Rows are counted before anything is joined, so a key or row that repeats without
end is one row in the joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import shared_copy


def _copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def check_primary_key(rows: DataFrame, key: str, present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the columns of ``rows``, and for rejected ones also
    ``reason`` and ``copies``.  ``present`` is the table that the rows join."""
    columns = rows.columns
    counted = _copies(rows)
    if present is not None:
        counted = counted.join(present.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    else:
        counted = counted.withColumn("_there", F.lit(None).cast("boolean"))
    whole = F.struct(*(F.col(c) for c in columns))
    least = counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(whole).alias("_least"))
    checked = shared_copy(counted.join(least, key, "left").select(
        *columns, "copies", F.when(F.col(key).isNull(), "null key").when(F.col("_there"), "key exists")
        .when(~whole.eqNullSafe(F.col("_least")), "repeated key").alias("reason")), "checked-keys")
    copies_of_kept = checked.filter("reason IS NULL AND copies > 1").select(
        *columns, F.lit("repeated key").alias("reason"), (F.col("copies") - 1).alias("copies"))
    rejected = checked.filter("reason IS NOT NULL").select(*columns, "reason", "copies").unionByName(copies_of_kept)
    return checked.filter("reason IS NULL").select(*columns), rejected


def check_foreign_key(rows: DataFrame, column: str, referenced: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) as above; accepted rows keep their copies."""
    keys = referenced.select(F.col(key).alias(column)).distinct()
    unknown = _copies(rows.join(keys, column, "left_anti").filter(F.col(column).isNotNull()))
    known = rows.join(keys, column, "left_semi").select(*rows.columns)
    return (known.unionByName(rows.filter(F.col(column).isNull())),
            unknown.select(*rows.columns, F.lit("unknown key").alias("reason"), "copies"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, batch: str) -> None:
    """Write ``df`` beside ``path`` and make it the table's folder ``batch`` by one
    rename: readers see the whole batch or nothing, and no earlier row is written
    again.  A batch that is there already is left as it is."""
    spark, target = df.sparkSession, f"{path}/batch={batch}"
    if exists(spark, target):
        return
    staged = f"{path}.staged-{uuid.uuid4().hex[:12]}"
    df.write.parquet(staged)
    new, fs = _hadoop(spark, staged)
    fs.mkdirs(_hadoop(spark, path)[0])
    if not fs.rename(new, _hadoop(spark, target)[0]):
        raise OSError(f"cannot publish {target}")


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all published batches; none where nothing was published."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType(list(schema.fields) + [StructField("batch", StringType())])).parquet(path).drop("batch")


def read_rejected(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rejects of all batches, with ``reason`` and ``copies``."""
    return read_table(spark, f"{path}.rejected", StructType(list(schema.fields) + [
        StructField("reason", StringType()), StructField("copies", LongType())]))


def _append(path: str, batch: str, accepted: DataFrame, rejected: DataFrame) -> None:
    # rejects first: a batch whose rows are there is whole, and a repeated run adds only what is missing
    publish(rejected, f"{path}.rejected", batch)
    publish(accepted, path, batch)


def append_catalog(rows: DataFrame, path: str, batch: str, key: str = "track_id") -> None:
    """Q-02: append a batch under the primary key ``key``; rejects go to
    ``path.rejected``.  A batch that was published before changes nothing."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/batch={batch}"):
        _append(path, batch, *check_primary_key(rows, key, read_table(spark, path, rows.schema)))


def append_interactions(rows: DataFrame, path: str, batch: str, catalog: DataFrame, column: str = "track_id",
                        key: str = "track_id") -> None:
    """Q-01: likewise for rows whose ``column`` must be in the catalog."""
    if not exists(rows.sparkSession, f"{path}/batch={batch}"):
        _append(path, batch, *check_foreign_key(rows, column, catalog, key))
