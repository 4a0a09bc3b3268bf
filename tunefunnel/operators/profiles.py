"""Taste profiles and the candidate feature frame (A-02..A-05, J-02..J-07, P-04, P-08, P-17, P-18, M-07).

The reference builds one profile per request with three different
definitions (K3).  One operator covers them, batch over all requests:

* ``mode="rows"``     — average over interaction rows, duplicates count
                        (known playlist; training seed profile);
* ``mode="distinct"`` — average over the distinct matched catalog rows
                        (seed-track list: ``track_id = ANY(list)``).

Empty profiles (K4): a known-playlist request whose tracks have no metadata
gets no profile row (its candidates disappear in the inner join); a seed
request always gets one row, NULL averages and length 0, and its candidates
are kept with NULL differences.  All aggregates are partial + final, so a
huge playlist is combined map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import AVG_FEATURES, DIFF_FEATURES, FEATURES, MODEL_INPUTS, TRACK_FEATURES

REQUEST = "request_id"


def profiles(requests: DataFrame, metadata: DataFrame, key: str = REQUEST,
             item: str = "track_id", mode: str = "rows", keep_empty: bool = False,
             with_length: bool = True) -> DataFrame:
    """A-03 / A-04 / A-05: ``[key, avg_*, playlist_length]`` from long-form
    ``requests[key, item]``.

    ``mode="rows"`` counts ``COUNT(track_id)`` over matched rows (A-03);
    ``mode="distinct"`` counts distinct matched tracks (``COUNT(*)`` of A-04).
    ``keep_empty`` left-joins from the request keys (seed-list semantics, K4).
    """
    if mode not in ("rows", "distinct"):
        raise ValueError(f"mode must be 'rows' or 'distinct', got {mode!r}")
    rows = requests.select(key, item)
    if mode == "distinct":
        rows = rows.distinct()
    meta = metadata.select(item, *FEATURES)
    joined = rows.join(meta, item)  # J-03 / J-07: inner, orphans drop out (K6)
    aggs = [F.avg(f).alias(a) for f, a in zip(FEATURES, AVG_FEATURES)]
    if with_length:
        aggs.append(F.count(item).cast("long").alias("playlist_length"))
    prof = joined.groupBy(key).agg(*aggs)
    if keep_empty:
        keys = requests.select(key).distinct()
        prof = keys.join(prof, key, "left")
        if with_length:
            prof = prof.withColumn("playlist_length", F.coalesce("playlist_length", F.lit(0)).cast("long"))
    return prof


def track_features(metadata: DataFrame) -> DataFrame:
    """S-04 / P-04: catalog with ``track_`` aliases."""
    return metadata.select("track_id", *[F.col(f).alias(t) for f, t in zip(FEATURES, TRACK_FEATURES)])


def cross_features(df: DataFrame) -> DataFrame:
    """P-08 / F-02: ``|avg_x - track_x|`` for the six features (NULL stays NULL)."""
    return df.withColumns({d: F.abs(F.col(a) - F.col(t))
                           for a, t, d in zip(AVG_FEATURES, TRACK_FEATURES, DIFF_FEATURES)})


def candidate_features(candidates: DataFrame, track_map: DataFrame, metadata: DataFrame,
                       request_profiles: DataFrame, key: str = REQUEST,
                       keep_unprofiled: bool = False) -> DataFrame:
    """M-07 for every request at once.

    ``candidates[key, track_int_id, als_score]`` (J-04: the score rides on the
    candidate row) -> map to track ids (J-02 via the A-02 dimension) -> catalog
    features (inner, K6) -> request profile (J-05 as an equi join on the
    request: inner for playlist requests, left for seed requests, K4) -> diffs.
    """
    c = candidates.select(key, F.col("track_int_id").cast("long").alias("track_int_id"),
                          F.col("als_score").cast("double").alias("als_score"))
    # the tracks meet their features first, so the candidates move once by track
    tracks = track_map.select(F.col("track_int_id").cast("long").alias("track_int_id"), "track_id").join(
        track_features(metadata), "track_id")
    items = c.join(tracks, "track_int_id").select(
        "track_id", "track_int_id", *[n for n in c.columns if n != "track_int_id"], *TRACK_FEATURES)
    how = "left" if keep_unprofiled else "inner"
    return cross_features(items.join(request_profiles, key, how))


def check_request_frame(df: DataFrame, kind: str) -> None:
    """P-18: the reference dispatches on ``int`` (known playlist) vs ``list``
    (seed tracks) and raises ``TypeError`` otherwise; batch requests are
    typed frames, checked here."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if kind == "playlist":
        ok = isinstance(fields.get("playlist_int_id"), (T.IntegerType, T.LongType))
    elif kind == "seeds":
        ok = isinstance(fields.get("track_id"), T.StringType)
    else:
        raise TypeError(f"request kind must be 'playlist' or 'seeds', got {kind!r}")
    if not ok or REQUEST not in fields:
        raise TypeError(f"{kind} requests need [{REQUEST}, "
                        f"{'playlist_int_id int' if kind == 'playlist' else 'track_id string'}]")


def with_sentinel(df: DataFrame, sentinel: float = -1e6) -> DataFrame:
    """Missing model inputs -> a sentinel below any real value, so trees
    route them consistently (MLlib trees have no learned missing branch)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(sentinel)) for c in MODEL_INPUTS})


def assemble(df: DataFrame, out: str = "features", sentinel: float = -1e6) -> DataFrame:
    """P-17: the 13 model inputs in fixed order as one vector column."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=MODEL_INPUTS, outputCol=out, handleInvalid="keep")
    return va.transform(with_sentinel(df, sentinel))
