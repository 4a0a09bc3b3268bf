"""Views over the driver's parquet tables (FIXTURES F1/F2).

playlist = customer (``orders.o_custkey``), track = part (``lineitem.l_partkey``),
one interaction per lineitem row.  Every view is a lazy DataFrame: Catalyst
prunes the scans to the columns used and pushes filters into parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector_table as VT
from ..session import ship_package
from .schemas import FEATURES

# Fixture rules (FIXTURES F1): catalog rows missing for p_partkey % 23 = 0
# (orphan interactions, K6) and NULL features for p_partkey % 17 = 0 (K4).
MISSING_CATALOG_MOD = 23
NULL_FEATURE_MOD = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``interaction_matrix``: a bag of (playlist_id, track_id), duplicates kept."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("playlist_id"),
        F.col("l_partkey").cast("string").alias("track_id"),
    )


def _exact_avg(c, scale: int):
    """Mean of a fixed-point column as an integer sum / count: independent of
    summation order, so every engine gets the same double bit for bit."""
    scaled = F.round(c * F.lit(scale)).cast("long")
    return F.sum(scaled) / F.count(c) / F.lit(float(scale))


def _part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey").agg(
        _exact_avg(F.col("l_discount"), 100).alias("_disc"),
        _exact_avg(F.col("l_tax"), 100).alias("_tax"),
        _exact_avg(F.col("l_quantity"), 1).alias("_qty"),
        _exact_avg(F.col("l_extendedprice"), 100).alias("_price"),
    )
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return part.join(per_part, part.p_partkey == per_part.l_partkey, "left")


def _feature_columns():
    """The six features of F1 as double columns, NULL on the fixture's NULL rows."""
    null_row = (F.col("p_partkey") % NULL_FEATURE_MOD) == 0
    values = {
        "danceability": F.col("_disc"),
        "tempo": F.col("p_retailprice"),
        "energy": F.col("_tax"),
        "acousticness": F.col("p_size"),
        "loudness": -F.col("_qty"),
        "valence": F.col("_price"),
    }
    return [F.when(null_row, F.lit(None).cast("double")).otherwise(values[f].cast("double")).alias(f)
            for f in FEATURES]


def feature_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external feature table (S-02): track_uri, names, six features."""
    return _part_features(spark, sf_dir).select(
        F.concat(F.lit("spotify:track:"), F.col("p_partkey").cast("string")).alias("track_uri"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_name").alias("track_name"),
        *_feature_columns(),
    )


def track_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_metadata`` (T3): unique track_id, names and six double features."""
    j = _part_features(spark, sf_dir).filter((F.col("p_partkey") % MISSING_CATALOG_MOD) != 0)
    return j.select(
        F.col("p_partkey").cast("string").alias("track_id"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_name").alias("track_name"),
        *_feature_columns(),
    )


def embedding_factors(spark: SparkSession, sf_dir: str):
    """item factors = ``embeddings.embedding``; one user per label whose
    factor is the element-wise mean of that label's vectors.

    Returns (items[item_id long, features array<float>],
             users[user_id long, features array<float>]).
    """
    emb = table(spark, sf_dir, "embeddings")
    items = emb.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("features"))
    users = element_mean(emb.select(F.col("label").cast("long").alias("user_id"),
                                    F.col("embedding").alias("features")),
                         "user_id", "features")
    return items, users


def _running_means(key: str, vec: str):
    """Means of rows sorted by key.  Only the sums of the current key are held."""
    def means(keys: list, sums: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        there = np.arange(sums.shape[1])[None, :] < sizes[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            values = (sums / np.maximum(counts, 1)).astype(np.float32)[there]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32(), mask=counts[there] == 0))
        return pa.record_batch([pa.concat_arrays(keys), lists], names=[key, vec])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                          # key, sums, counts and size that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(key).dictionary_encode(null_encoding="encode")
            code, names = coded.indices.to_numpy(), coded.dictionary
            column = batch.column(vec)
            sizes, flat = pc.list_value_length(column).to_numpy().astype(np.int64), column.flatten()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            size = np.maximum.reduceat(sizes, starts)
            width, n = int(max(size.max(), last[3] if last else 0)), len(names)
            at = np.repeat(code * width - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy().astype(np.float64)
            sums = np.bincount(at, weights=values, minlength=n * width).reshape(n, width)
            counts = np.bincount(at[there], minlength=n * width).reshape(n, width)
            if last is not None and last[0][0].equals(names[0]):
                sums[0, :last[3]] += last[1]
                counts[0, :last[3]] += last[2]
                size[0] = max(size[0], last[3])
            elif last is not None:
                yield means([last[0]], last[1][None, :], last[2][None, :], np.array([last[3]]))
            if n > 1:
                yield means([names.slice(0, n - 1)], sums[:-1], counts[:-1], size[:-1])
            end = int(size[-1])
            last = names.slice(n - 1), sums[-1, :end], counts[-1, :end], end
        if last is not None:
            yield means([last[0]], last[1][None, :], last[2][None, :], np.array([last[3]]))

    return run


def _means_of(key: str, vec: str, table: VT.VectorTable):
    """Means of the vectors of rows sorted by key.  Only a run of rows, with the sums
    of its keys, is held."""
    def means(keys: pa.Array, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        there = np.flatnonzero(counts)
        values = (sums[there] / counts[there, None]).astype(np.float32)
        offsets = pa.array(np.arange(len(there) + 1, dtype=np.int32) * values.shape[1])
        return pa.record_batch([keys.take(pa.array(there)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=[key, vec])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                          # key, sums and count that may go on
        for rows in VT.runs(batches):
            starts = VT.group_starts(rows, [key])
            keys = rows.column(key).take(pa.array(starts))
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
            found = table.found(rows.column("item_id").to_numpy())
            owner, at = found.rows(rows.column("item_id").to_numpy())
            group = group if owner is None else group[owner]
            group, at = group[at >= 0], at[at >= 0]
            sums, counts = np.zeros((len(keys), found.d)), np.bincount(group, minlength=len(keys))
            for i in range(0, len(at), VT.SUM_ROWS):
                g = group[i:i + VT.SUM_ROWS]
                first = np.r_[0, np.flatnonzero(np.diff(g)) + 1]
                sums[g[first]] += np.add.reduceat(found.vectors[at[i:i + VT.SUM_ROWS]].astype(np.float64), first, axis=0)
            if last is not None and last[0].equals(keys[:1]):
                if last[2][0]:
                    sums = sums if found.d else np.zeros((len(keys), last[1].shape[1]))
                    sums[0] += last[1][0]
                    counts[0] += last[2][0]
            elif last is not None and last[2][0]:
                yield means(*last)
            if counts[:-1].any():
                yield means(keys[:-1], sums[:-1], counts[:-1])
            last = keys[-1:], sums[-1:], counts[-1:]
        if last is not None and last[2][0]:
            yield means(*last)

    return run


def element_mean(df: DataFrame, key: str, vec: str, of: DataFrame | None = None) -> DataFrame:
    """Element-wise mean of vectors by key.  Whole vectors move to their key once
    and are added up as they come, so a task holds the sums of one key; missing
    elements are left out, as are missing and empty vectors.  With ``of[item_id,
    vec]`` the rows ``df[key, item_id]`` move alone, and meet the vectors of their
    items, whole and of one length, in the written table."""
    ship_package(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField(vec, T.ArrayType(T.FloatType()))])
    if of is not None:
        table = VT.stored(of.select("item_id", F.col(vec).alias("features")).filter(F.size("features") > 0))
        rows = df.select(key, F.col("item_id").cast("long").alias("item_id")).dropna(subset=["item_id"])
        return rows.repartition(key).sortWithinPartitions(key, "item_id").mapInArrow(_means_of(key, vec, table), schema)
    rows = df.select(key, vec).filter(F.size(vec) > 0)
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(_running_means(key, vec), schema)
