"""Explicit table schemas (S-09) and the fixed column lists of the model.

The names below are fixed values: they must equal the data model's column
names for frames to line up with what users of the original pipeline expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: audio feature names, in data-model order ---------------
FEATURES = ["danceability", "tempo", "energy", "acousticness", "loudness", "valence"]
# --- end fixed values -------------------------------------------------------

TRACK_FEATURES = [f"track_{f}" for f in FEATURES]
AVG_FEATURES = [f"avg_{f}" for f in FEATURES]
DIFF_FEATURES = [f"{f}_diff" for f in FEATURES]
# 13 ranker inputs: track features, |profile - track| differences, retrieval score (K5)
MODEL_INPUTS = TRACK_FEATURES + DIFF_FEATURES + ["als_score"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """S-09: the schema's columns in its order and types; a missing column
    raises.  Features are kept as doubles, of which the stored REAL values are a
    part."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


TRACK_METADATA = T.StructType(
    [T.StructField("track_id", T.StringType(), False),
     T.StructField("artist_name", T.StringType(), True),
     T.StructField("track_name", T.StringType(), True)]
    + [T.StructField(f, T.DoubleType(), True) for f in FEATURES]
)

INTERACTIONS = T.StructType([
    T.StructField("playlist_id", T.StringType(), True),
    T.StructField("track_id", T.StringType(), True),
])

INTERACTIONS_MAPPED = T.StructType([
    T.StructField("playlist_id", T.StringType(), True),
    T.StructField("playlist_int_id", T.LongType(), False),
    T.StructField("track_id", T.StringType(), True),
    T.StructField("track_int_id", T.LongType(), False),
])

# Nested playlist slice document: {playlists: [{pid, tracks: [{track_uri}]}]}
SLICE = T.StructType([
    T.StructField("playlists", T.ArrayType(T.StructType([
        T.StructField("pid", T.LongType(), True),
        T.StructField("tracks", T.ArrayType(T.StructType([
            T.StructField("track_uri", T.StringType(), True),
        ])), True),
    ])), True),
])

FEATURE_ARCHIVE = T.StructType(
    [T.StructField("track_uri", T.StringType(), True),
     T.StructField("artist_name", T.StringType(), True),
     T.StructField("track_name", T.StringType(), True)]
    + [T.StructField(f, T.DoubleType(), True) for f in FEATURES]
)
