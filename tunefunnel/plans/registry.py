"""Registered queries: one per operator group of the blueprint, each a
``(spark, sf_dir) -> DataFrame`` that reads the driver's tables, plus the
equivalent DuckDB SQL where the operator is SQL-expressible.

Floating outputs are rounded to 6 decimals in both engines; computed columns
carry the same alias on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_to, stable_round, stable_round_sql
from ..operators import metrics as M
from ..session import ship_package
from ..operators import popularity as P
from ..operators import split as S
from ..sources import tables as T
from . import cache as C
from . import sql_fragments as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Parameters of the reference's documented evaluation command and code defaults.
K = 20
HOLDOUT = 0.2
SALT = "42"
MIN_TRACKS = 10
N_POPULAR = 50


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def r6(c):
    return round_to(c, 6)


def eval_heldout(spark: SparkSession, sf_dir: str, frac: float = HOLDOUT, salt: str = SALT,
                 min_tracks: int = MIN_TRACKS) -> DataFrame:
    """The split of every eligible playlist (>= min_tracks rows), all of them."""
    return whole_split(spark, sf_dir, frac, salt).filter(F.col("n") >= min_tracks)


def whole_split(spark: SparkSession, sf_dir: str, frac: float = HOLDOUT, salt: str = SALT) -> DataFrame:
    """The split of every playlist, written once per application and shared by
    every evaluation query; it carries each playlist's row count ``n``."""
    return C.shared_table(spark, ("split", sf_dir, frac, str(salt)),
                          lambda: S.holdout_split(C.interactions(spark, sf_dir), frac, salt))


# --------------------------------------------------------------------------
# Phase 0: popularity baseline end to end
# --------------------------------------------------------------------------

@query("popularity_topk", Q.with_(Q.INTERACTIONS, Q.popularity(K)) + "SELECT * FROM top")
def popularity_topk(spark, sf_dir):
    """L-03, A-06: the 20 most interacted tracks, ties by track id (K12)."""
    return P.popularity_topk(C.interactions(spark, sf_dir), K)


@query("popular_head", Q.with_(Q.INTERACTIONS, Q.popularity(N_POPULAR)) + "SELECT * FROM top")
def popular_head(spark, sf_dir):
    """L-04: the popular head (top 50) used by the long-tail view."""
    return P.popularity_topk(C.interactions(spark, sf_dir), N_POPULAR)


@query("holdout_split",
       Q.with_(Q.INTERACTIONS, Q.split("interactions", HOLDOUT, SALT))
       + "SELECT *, CAST(CASE WHEN pos <= n_hold THEN 1 ELSE 0 END AS INTEGER) AS held FROM split")
def holdout_split(spark, sf_dir):
    """W-05, F-05: seed / held-out split of every playlist (frac 0.2, K8, K9)."""
    return S.holdout_split(C.interactions(spark, sf_dir), HOLDOUT, SALT)


_EVAL_POP_SQL = Q.with_(
    Q.INTERACTIONS, Q.eligible(MIN_TRACKS), Q.split("eligible_interactions", HOLDOUT, SALT),
    "held AS (SELECT playlist_id, track_id FROM split WHERE pos <= n_hold)",
    Q.popularity(K), Q.metrics("held", "top", K, shared=True),
) + f"""
SELECT 'popularity' AS arm, {K} AS k, COUNT(*) AS n_playlists,
       ROUND(AVG(recall), 6) AS recall_at_k, ROUND(AVG(ndcg), 6) AS ndcg_at_k,
       ROUND(AVG(hit), 6) AS hit_rate
FROM per"""


@query("eval_popularity", _EVAL_POP_SQL)
def eval_popularity(spark, sf_dir):
    """Phase-0 slice (E-01..E-04, J-11, F-03, F-04): how good is the
    popularity baseline at k = 20, over every eligible playlist?"""
    inter = C.interactions(spark, sf_dir)
    held = eval_heldout(spark, sf_dir).filter("held = 1")
    per = M.metrics_at_k(held, P.popularity_topk(inter, K), K, shared=True)
    return per.agg(
        F.count(F.lit(1)).alias("n_playlists"),
        r6(F.avg("recall")).alias("recall_at_k"),
        r6(F.avg("ndcg")).alias("ndcg_at_k"),
        r6(F.avg("hit")).alias("hit_rate"),
    ).select(F.lit("popularity").alias("arm"), F.lit(K).alias("k"), "*")


_UNSEEN_POP_SQL = Q.with_(
    Q.INTERACTIONS, Q.eligible(MIN_TRACKS), Q.split("eligible_interactions", HOLDOUT, SALT),
    "held AS (SELECT playlist_id, track_id FROM split WHERE pos <= n_hold)",
    "seen AS (SELECT DISTINCT playlist_id, track_id FROM split WHERE pos > n_hold)",
    """ranked AS (
  SELECT track_id, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, track_id ASC) AS place FROM interactions GROUP BY track_id
),
lists AS (
  SELECT e.playlist_id, r.track_id, ROW_NUMBER() OVER (PARTITION BY e.playlist_id ORDER BY r.place) AS rank
  FROM eligible e CROSS JOIN ranked r ANTI JOIN seen s ON s.playlist_id = e.playlist_id AND s.track_id = r.track_id
)""", Q.metrics("held", "lists", K, shared=False)) + """
SELECT playlist_id, 'popularity_unseen' AS arm, n_held, n_held_distinct, n_hits, ROUND(recall, 6) AS recall,
       ROUND(ndcg, 6) AS ndcg, hit
FROM per"""


def unseen_popularity_metrics(spark, sf_dir):
    """Metrics of the popularity list without each playlist's own seeds (K13)."""
    split = eval_heldout(spark, sf_dir)
    held = split.filter("held = 1").select("playlist_id", "track_id")
    places = P.unseen_popularity(C.interactions(spark, sf_dir), split.filter("held = 0"), held, K)
    return M.metrics_at_k(held, places, K).withColumn("arm", F.lit("popularity_unseen"))


@query("popularity_unseen", _UNSEEN_POP_SQL)
def popularity_unseen(spark, sf_dir):
    """L-03, E-04 (K13): the popularity arm whose lists leave out a playlist's own
    seeds, for every eligible playlist."""
    return _metric_cols(unseen_popularity_metrics(spark, sf_dir))


# --------------------------------------------------------------------------
# Phase 1: ingestion
# --------------------------------------------------------------------------

from ..operators import ingest as I  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import constrained as CN  # noqa: E402
from ..sources import slices as SL  # noqa: E402
from ..streaming import growing_ids as G  # noqa: E402
from ..streaming.slices import ingest_slices_stream  # noqa: E402

_INTERACTIONS_SQL = Q.with_(Q.INTERACTIONS) + "SELECT playlist_id, track_id FROM interactions"


def written_slices(spark, sf_dir):
    """Slice documents derived from the tables, written to the shared scratch folder."""
    return SL.write_slices_from_tables(spark, sf_dir, scratch_path(spark, "slices"))


@query("slice_flatten", _INTERACTIONS_SQL)
def slice_flatten(spark, sf_dir):
    """S-01, P-01, P-02: scan multi-line JSON slices, flatten to (playlist, track)."""
    return I.flatten_slices(SL.read_slices(spark, written_slices(spark, sf_dir)))


@query("slice_ingest_stream", _INTERACTIONS_SQL)
def slice_ingest_stream(spark, sf_dir):
    """S-06/S-07/U-01: the same slices through the streaming file source,
    micro-batches bounded by bytes, appended to a parquet sink with a
    checkpoint."""
    src = written_slices(spark, sf_dir)
    sink = scratch_path(spark, "interactions-sink")
    ingest_slices_stream(spark, src, sink, scratch_path(spark, "ingest-ckpt"))
    return spark.read.parquet(sink).select("playlist_id", "track_id")


_URI_CLEAN_SQL = Q.with_(Q.INTERACTIONS, """
uris AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS playlist_id,
         CASE WHEN l.l_linenumber = 1 THEN CAST(l.l_partkey AS VARCHAR)
              WHEN l.l_linenumber = 3 THEN 'spotify:track:spotify:track:' || CAST(l.l_partkey AS VARCHAR)
              ELSE 'spotify:track:' || CAST(l.l_partkey AS VARCHAR) END AS track_uri
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)""") + """
SELECT playlist_id, track_uri,
       CASE WHEN instr(track_uri, 'spotify:track:') > 0
            THEN substr(track_uri, 1, instr(track_uri, 'spotify:track:') - 1)
                 || substr(track_uri, instr(track_uri, 'spotify:track:') + 14)
            ELSE track_uri END AS track_id_clean,
       string_split(track_uri, ':')[-1] AS track_id_last
FROM uris"""


@query("uri_clean", _URI_CLEAN_SQL)
def uri_clean(spark, sf_dir):
    """P-03 (first prefix only) next to P-02 (last segment); F-06."""
    u = SL.interaction_uris(spark, sf_dir)
    return u.select(F.col("pid").cast("string").alias("playlist_id"), "track_uri",
                    I.strip_uri_prefix(F.col("track_uri")).alias("track_id_clean"),
                    I.last_uri_segment(F.col("track_uri")).alias("track_id_last"))


_FEATS6 = ", ".join(f"f.{c}" for c in
                    ["danceability", "tempo", "energy", "acousticness", "loudness", "valence"])

_CATALOG_SQL = Q.with_(Q.INTERACTIONS, Q.FEATURE_ARCHIVE) + f"""
SELECT t.track_id, f.artist_name, f.track_name, {_FEATS6}
FROM (SELECT DISTINCT track_id FROM interactions) t
LEFT JOIN (SELECT replace(track_uri, 'spotify:track:', '') AS track_id, * EXCLUDE (track_uri)
           FROM feature_archive) f ON f.track_id = t.track_id"""


@query("catalog_left_join", _CATALOG_SQL)
def catalog_left_join(spark, sf_dir):
    """S-02, A-01, J-01, S-05, S-09: catalog of interaction tracks LEFT JOIN the
    feature archive, written (overwrite) and read back with the fixed schema."""
    from ..sources.schemas import FEATURE_ARCHIVE, FEATURES, TRACK_METADATA, conform
    archive = conform(T.feature_archive(spark, sf_dir), FEATURE_ARCHIVE)
    cat = I.catalog(C.interactions(spark, sf_dir), archive)
    path = SL.write_table(cat.select(*[f.name for f in TRACK_METADATA.fields]),
                          scratch_path(spark, "track_metadata"))
    back = spark.read.schema(TRACK_METADATA).parquet(path)
    return back.select("track_id", "artist_name", "track_name", *FEATURES)


_IDMAP_SQL = Q.with_(Q.INTERACTIONS) + """
SELECT playlist_id, CAST(DENSE_RANK() OVER (ORDER BY playlist_id) - 1 AS BIGINT) AS playlist_int_id,
       track_id, CAST(DENSE_RANK() OVER (ORDER BY track_id) - 1 AS BIGINT) AS track_int_id
FROM interactions"""


@query("id_mapping", _IDMAP_SQL)
def id_mapping(spark, sf_dir):
    """S-08, W-01: interaction_matrix_mapped with contiguous 0-based ids."""
    return C.mapped(spark, sf_dir)


@query("fk_orphans", Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA) + """
SELECT i.track_id, CAST(COUNT(*) AS BIGINT) AS n_interactions
FROM interactions i WHERE i.track_id NOT IN (SELECT track_id FROM track_metadata)
GROUP BY i.track_id""")
def fk_orphans(spark, sf_dir):
    """Q-01: interactions whose track is missing from track_metadata."""
    return I.fk_orphans(C.interactions(spark, sf_dir), C.track_metadata(spark, sf_dir))


@query("pk_duplicates", Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA) + """
SELECT track_id, CAST(COUNT(*) AS BIGINT) AS n_rows FROM track_metadata
GROUP BY track_id HAVING COUNT(*) > 1""")
def pk_duplicates(spark, sf_dir):
    """Q-02: primary-key violations in track_metadata."""
    return I.pk_duplicates(C.track_metadata(spark, sf_dir))


_OFFERS_SQL = """
offers AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS track_id,
         CAST(l_suppkey AS VARCHAR) AS artist_name, CAST(l_linenumber AS VARCHAR) AS track_name
  FROM lineitem
),
first AS (SELECT * FROM offers WHERE artist_name < '5'),
second AS (SELECT * FROM offers WHERE NOT artist_name < '5')"""


def _checked_sql(offers: str, out: str, present: str | None) -> str:
    there = f"track_id IN (SELECT track_id FROM {present})" if present else "FALSE"
    return f"""
{out} AS (
  SELECT track_id, artist_name, track_name,
         CASE WHEN track_id IS NULL THEN 'null key' WHEN {there} THEN 'key exists'
              WHEN place > 1 THEN 'repeated key' END AS reason
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY artist_name, track_name) AS place FROM {offers})
),
{out}_kept AS (SELECT track_id FROM {out} WHERE reason IS NULL)"""


@query("constrained_catalog", Q.with_(_OFFERS_SQL, _checked_sql("first", "a", None), _checked_sql("second", "b", "a_kept")) + """
SELECT track_id, artist_name, track_name, reason, CAST(COUNT(*) AS BIGINT) AS copies
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def constrained_catalog(spark, sf_dir):
    """Q-02, S-05: track rows offered by every line item, in two batches, appended
    under the primary key; the first batch is offered again, which changes nothing.
    All accepted rows (no reason) and rejected ones with their copies."""
    li = T.table(spark, sf_dir, "lineitem")
    offers = li.select(F.when(F.col("l_linenumber") != 7, F.col("l_partkey").cast("string")).alias("track_id"),
                       F.col("l_suppkey").cast("string").alias("artist_name"),
                       F.col("l_linenumber").cast("string").alias("track_name"))
    path, early = scratch_path(spark, "constrained-catalog"), F.col("artist_name") < "5"
    for rows, batch in ((offers.filter(early), "1"), (offers.filter(~early), "2"), (offers.filter(early), "1")):
        CN.append_catalog(rows, path, batch)
    kept = CN.read_table(spark, path, offers.schema).select(
        "*", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("copies"))
    return kept.unionByName(CN.read_rejected(spark, path, offers.schema))


@query("constrained_interactions", Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA) + """
SELECT playlist_id, track_id,
       CASE WHEN track_id NOT IN (SELECT track_id FROM track_metadata) THEN 'unknown key' END AS reason,
       CAST(COUNT(*) AS BIGINT) AS copies
FROM interactions GROUP BY ALL""")
def constrained_interactions(spark, sf_dir):
    """Q-01: all interactions appended under the foreign key to the catalog; accepted
    rows (no reason) and rejected ones with their copies."""
    inter, path = C.interactions(spark, sf_dir), scratch_path(spark, "constrained-interactions")
    CN.append_interactions(inter, path, "1", C.track_metadata(spark, sf_dir))
    kept = CN.read_table(spark, path, inter.schema).groupBy(*inter.columns).agg(F.count(F.lit(1)).alias("copies"))
    return kept.select(*inter.columns, F.lit(None).cast("string").alias("reason"), "copies").unionByName(
        CN.read_rejected(spark, path, inter.schema))


_ID_COLUMNS = ("n_keys", "least_id", "greatest_id", "n_ids", "n_rows", "early_ids")


@query("growing_ids", Q.with_(Q.INTERACTIONS) + """
SELECT kind, COUNT(DISTINCT k) AS n_keys, CAST(0 AS BIGINT) AS least_id, COUNT(DISTINCT k) - 1 AS greatest_id,
       COUNT(DISTINCT k) AS n_ids, COUNT(*) AS n_rows, COUNT(DISTINCT CASE WHEN early THEN k END) AS early_ids
FROM (SELECT 'playlist' AS kind, playlist_id AS k, playlist_id < '5' AS early FROM interactions
      UNION ALL SELECT 'track', track_id, playlist_id < '5' FROM interactions) GROUP BY kind""")
def growing_ids(spark, sf_dir):
    """W-01, S-06: all interactions in two batches of playlists, the first replayed, as
    in ``foreachBatch``: ids stay contiguous, the first batch's keys have the lowest
    ones, and every row maps back to its own keys."""
    inter, folder = C.interactions(spark, sf_dir), scratch_path(spark, "growing-ids")
    early, write = F.col("playlist_id") < "5", G.batch_writer(folder, "slices")
    write(inter.filter(early), 0)
    write(inter.filter(~early), 1)
    write(inter.filter(early), 0)
    mapped, playlists, tracks = G.read_mapped(spark, folder)
    rows = None
    for kind, dim in (("playlist", playlists), ("track", tracks)):
        key, out = f"{kind}_id", f"{kind}_int_id"
        first = mapped.filter(early).select(key).distinct()
        ids = dim.agg(F.count_distinct(key).alias("n_keys"), F.min(out).alias("least_id"), F.max(out).alias("greatest_id"),
                      F.count_distinct(out).alias("n_ids"))
        back = mapped.join(dim.select(F.col(key).alias("k"), out), out).agg(F.count_if(F.col("k") == F.col(key)).alias("n_rows"))
        lowest = dim.join(first, key, "left_semi").agg(F.count_if(F.col(out) < F.lit(first.count())).alias("early_ids"))
        for part in (ids, back, lowest):   # one row each
            one = part.select(F.lit(kind).alias("kind"), *(
                (F.col(c) if c in part.columns else F.lit(None).cast("long")).alias(c) for c in _ID_COLUMNS))
            rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("kind").agg(*(F.max(c).alias(c) for c in _ID_COLUMNS))


_MAPPED_CTE = """
mapped AS (
  SELECT playlist_id, DENSE_RANK() OVER (ORDER BY playlist_id) - 1 AS playlist_int_id,
         track_id, DENSE_RANK() OVER (ORDER BY track_id) - 1 AS track_int_id
  FROM interactions
)"""


@query("interaction_confidence", Q.with_(Q.INTERACTIONS, _MAPPED_CTE) + """
SELECT CAST(playlist_int_id AS BIGINT) AS playlist_int_id, CAST(track_int_id AS BIGINT) AS track_int_id,
       CAST(COUNT(*) AS BIGINT) AS confidence
FROM mapped GROUP BY 1, 2""")
def interaction_confidence(spark, sf_dir):
    """S-03, M-01, A-13, P-07, P-09: long-form sparse matrix, duplicates summed."""
    mapped = C.mapped(spark, sf_dir)
    return I.confidence(mapped)


@query("matrix_stats", Q.with_(Q.INTERACTIONS, _MAPPED_CTE, """
cells AS (SELECT playlist_int_id, track_int_id, COUNT(*) AS c FROM mapped GROUP BY 1, 2)""") + """
SELECT CAST(MAX(playlist_int_id) + 1 AS BIGINT) AS n_playlists, CAST(MAX(track_int_id) + 1 AS BIGINT) AS n_tracks,
       CAST(SUM(c) AS BIGINT) AS n_interactions, CAST(COUNT(*) AS BIGINT) AS n_nonzero,
       CAST(COUNT(*) FILTER (WHERE c > 1) AS BIGINT) AS n_duplicate_cells,
       ROUND(COUNT(*) / ((MAX(playlist_int_id) + 1) * (MAX(track_int_id) + 1))::DOUBLE, 9) AS density
FROM cells""")
def matrix_stats(spark, sf_dir):
    """A-12, A-19: matrix shape and counts."""
    mapped = C.mapped(spark, sf_dir)
    return I.matrix_stats(mapped)


# --------------------------------------------------------------------------
# Phase 2: profiles, features, samples
# --------------------------------------------------------------------------

from ..operators import profiles as PR  # noqa: E402
from ..sources.schemas import AVG_FEATURES, DIFF_FEATURES, FEATURES, TRACK_FEATURES  # noqa: E402

_AVG_SQL = ", ".join(f"{stable_round_sql(f'AVG(m.{f})')} AS avg_{f}" for f in FEATURES)
_PMAP_CTE = """
pmap AS (
  SELECT playlist_id, DENSE_RANK() OVER (ORDER BY playlist_id) - 1 AS playlist_int_id
  FROM (SELECT DISTINCT playlist_id FROM interactions)
),
tmap AS (
  SELECT track_id, DENSE_RANK() OVER (ORDER BY track_id) - 1 AS track_int_id
  FROM (SELECT DISTINCT track_id FROM interactions)
)"""
_SPLIT_ELIGIBLE = (Q.INTERACTIONS, Q.eligible(MIN_TRACKS), Q.split("eligible_interactions", HOLDOUT, SALT))


def _round_cols(df, cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _mean_cols(df, cols):
    """Means, and what is computed from them, rounded alike in both engines."""
    return df.withColumns({c: stable_round(F.col(c)) for c in cols})


@query("profile_playlist", Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA, _PMAP_CTE) + f"""
SELECT CAST(p.playlist_int_id AS BIGINT) AS request_id, {_AVG_SQL},
       CAST(COUNT(i.track_id) AS BIGINT) AS playlist_length
FROM interactions i JOIN pmap p USING (playlist_id) JOIN track_metadata m USING (track_id)
GROUP BY p.playlist_int_id""")
def profile_playlist(spark, sf_dir):
    """A-03, J-03, P-06: known-playlist profile for every playlist int id
    (int id -> text id through the id map, then rows ⋈ catalog, GROUP BY)."""
    inter = C.interactions(spark, sf_dir)
    reqs = inter.join(C.playlist_map(spark, sf_dir), "playlist_id").select(F.col("playlist_int_id").alias("request_id"), "track_id")
    prof = PR.profiles(reqs, C.track_metadata(spark, sf_dir), mode="rows")
    return _mean_cols(prof, AVG_FEATURES)


def seed_requests(spark, sf_dir):
    """Seed-track requests: the seed side of every eligible playlist's split."""
    return eval_heldout(spark, sf_dir).filter("held = 0").select(
        F.col("playlist_id").alias("request_id"), "track_id")


_SEEDS_CTE = "seeds AS (SELECT playlist_id AS request_id, track_id FROM split WHERE pos > n_hold)"


@query("profile_seeds", Q.with_(*_SPLIT_ELIGIBLE, Q.TRACK_METADATA, _SEEDS_CTE) + f"""
SELECT r.request_id, {", ".join(f"x.avg_{f}" for f in FEATURES)},
       CAST(COALESCE(x.playlist_length, 0) AS BIGINT) AS playlist_length
FROM (SELECT DISTINCT request_id FROM seeds) r LEFT JOIN (
  SELECT s.request_id, {_AVG_SQL}, COUNT(*) AS playlist_length
  FROM (SELECT DISTINCT request_id, track_id FROM seeds) s JOIN track_metadata m USING (track_id)
  GROUP BY s.request_id) x USING (request_id)""")
def profile_seeds(spark, sf_dir):
    """A-04, P-05, P-18, S-12: seed-list profile over distinct matched tracks;
    requests with no match keep a row of NULLs and length 0 (K4)."""
    reqs = seed_requests(spark, sf_dir)
    prof = PR.profiles(reqs, C.track_metadata(spark, sf_dir), mode="distinct", keep_empty=True)
    return _mean_cols(prof, AVG_FEATURES)


@query("profile_train", Q.with_(*_SPLIT_ELIGIBLE, Q.TRACK_METADATA, _SEEDS_CTE) + f"""
SELECT s.request_id, {_AVG_SQL}
FROM seeds s JOIN track_metadata m USING (track_id) GROUP BY s.request_id""")
def profile_train(spark, sf_dir):
    """A-05, J-07, S-04: training seed profile, mean over seed occurrences."""
    prof = PR.profiles(seed_requests(spark, sf_dir), C.track_metadata(spark, sf_dir),
                       mode="rows", with_length=False)
    return _mean_cols(prof, AVG_FEATURES)


_TRACK_SQL = ", ".join(f"ROUND(m.{f}, 6) AS track_{f}" for f in FEATURES)
_PROF_SQL = ", ".join(f"{stable_round_sql(f'x.avg_{f}')} AS avg_{f}" for f in FEATURES)
_DIFF_SQL = ", ".join(f"{stable_round_sql(f'ABS(x.avg_{f} - m.{f})')} AS {f}_diff" for f in FEATURES)


@query("cross_features", Q.with_(*_SPLIT_ELIGIBLE, Q.TRACK_METADATA, _PMAP_CTE, _SEEDS_CTE, f"""
counts AS (SELECT track_id, COUNT(*) AS c FROM interactions GROUP BY track_id),
cands AS (
  SELECT DISTINCT s.playlist_id AS request_id, t.track_int_id
  FROM split s JOIN tmap t USING (track_id) WHERE s.pos <= s.n_hold
),
prof AS (
  SELECT r.request_id, {", ".join(f"x.avg_{f}" for f in FEATURES)},
         COALESCE(x.playlist_length, 0) AS playlist_length
  FROM (SELECT DISTINCT request_id FROM seeds) r LEFT JOIN (
    SELECT s.request_id, {", ".join(f"AVG(m.{f}) AS avg_{f}" for f in FEATURES)},
           COUNT(*) AS playlist_length
    FROM (SELECT DISTINCT request_id, track_id FROM seeds) s JOIN track_metadata m USING (track_id)
    GROUP BY s.request_id) x USING (request_id)
)""") + f"""
SELECT c.request_id, CAST(c.track_int_id AS BIGINT) AS track_int_id, t.track_id, {_TRACK_SQL},
       CAST(n.c AS DOUBLE) AS als_score, {_PROF_SQL}, CAST(x.playlist_length AS BIGINT) AS playlist_length,
       {_DIFF_SQL}
FROM cands c JOIN tmap t USING (track_int_id) JOIN counts n USING (track_id)
JOIN track_metadata m USING (track_id) LEFT JOIN prof x USING (request_id)""")
def cross_features(spark, sf_dir):
    """M-07, P-04, P-08, F-02, A-02, J-02, J-04, J-05 for every request at once.

    Candidate source (deterministic stand-in for retrieval): each playlist's
    held-out tracks, scored by global track popularity; profile = the
    playlist's seed-list profile (seed requests keep candidates, K4)."""
    inter = C.interactions(spark, sf_dir)
    split = eval_heldout(spark, sf_dir)
    tmap = C.track_map(spark, sf_dir)
    counts = P.track_counts(inter)
    cands = (split.filter("held = 1").select(F.col("playlist_id").alias("request_id"), "track_id")
             .distinct().join(tmap, "track_id").join(counts, "track_id")
             .select("request_id", "track_int_id", F.col("n_interactions").cast("double").alias("als_score")))
    meta = C.track_metadata(spark, sf_dir)
    prof = PR.profiles(seed_requests(spark, sf_dir), meta, mode="distinct", keep_empty=True)
    out = PR.candidate_features(cands, tmap, meta, prof, keep_unprofiled=True)
    return _mean_cols(_round_cols(out, TRACK_FEATURES), AVG_FEATURES + DIFF_FEATURES)


@query("sample_playlists", Q.with_(Q.INTERACTIONS) + f"""
SELECT playlist_id, CAST(COUNT(*) AS BIGINT) AS n_tracks, md5('{SALT}:' || playlist_id) AS sample_key
FROM interactions GROUP BY playlist_id HAVING COUNT(*) >= {MIN_TRACKS}
ORDER BY sample_key, playlist_id LIMIT 2000""")
def sample_playlists(spark, sf_dir):
    """L-02, A-07: seeded sample of 2000 eligible playlists (the sampling is
    the feature; a top-n by hash key, no global sort)."""
    return S.sample_playlists(C.interactions(spark, sf_dir), 2000, MIN_TRACKS, SALT).select(
        "playlist_id", F.col("n_tracks").cast("long").alias("n_tracks"), "sample_key")


@query("train_playlists", Q.with_(Q.INTERACTIONS, _MAPPED_CTE) + """
SELECT CAST(playlist_int_id AS BIGINT) AS playlist_int_id, CAST(COUNT(*) AS BIGINT) AS n_tracks
FROM mapped WHERE playlist_int_id IN (
  SELECT DISTINCT playlist_int_id FROM mapped ORDER BY playlist_int_id LIMIT 10000)
GROUP BY playlist_int_id HAVING COUNT(*) >= 2""")
def train_playlists(spark, sf_dir):
    """L-01, P-11, A-10: the first 10,000 playlist ids (K11) with >= 2 tracks."""
    mapped = C.mapped(spark, sf_dir)
    return S.train_playlists(mapped, 10000).select(
        F.col("playlist_int_id").cast("long").alias("playlist_int_id"),
        F.col("n_tracks").cast("long").alias("n_tracks"))


# --------------------------------------------------------------------------
# Phase 3: retrieval on given factors (embeddings, FIXTURES F2)
# --------------------------------------------------------------------------

from ..operators import retrieval as RV  # noqa: E402

N_CANDIDATES = 200

_EMB_CTES = """
dims AS (
  SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS v FROM embeddings
),
umean AS (SELECT label AS user_id, d, CAST(AVG(CAST(v AS DOUBLE)) AS FLOAT) AS m FROM dims GROUP BY label, d),
uvec AS (SELECT CAST(user_id AS BIGINT) AS user_id, list(m ORDER BY d) AS uv FROM umean GROUP BY user_id),
scores AS (
  SELECT u.user_id, e.vec_id AS item_id,
         list_dot_product(list_transform(u.uv, lambda x: CAST(x AS DOUBLE)),
                          list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) AS score
  FROM uvec u CROSS JOIN embeddings e
)"""


def _emb_topn(spark, sf_dir, unseen: bool):
    items, users = T.embedding_factors(spark, sf_dir)
    seen = None
    if unseen:
        seen = T.table(spark, sf_dir, "embeddings").select(
            F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("item_id"))
    return RV.top_n(users, items, N_CANDIDATES, seen=seen)


@query("topn_dot_product", Q.with_(_EMB_CTES) + f"""
SELECT user_id, item_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scores)
WHERE rank <= {N_CANDIDATES}""")
def topn_dot_product(spark, sf_dir):
    """M-05, P-12: exact top-200 items per user on given factors (item factor =
    embedding, user factor = mean of its label's vectors)."""
    out = _emb_topn(spark, sf_dir, unseen=False)
    return out.select("user_id", "item_id", r6(F.col("score")).alias("score"),
                      F.col("rank").cast("long").alias("rank"))


_UNSEEN_SQL = Q.with_(_EMB_CTES, """
unseen AS (
  SELECT s.* FROM scores s
  WHERE NOT EXISTS (SELECT 1 FROM embeddings x WHERE x.label = s.user_id AND x.vec_id = s.item_id)
),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM unseen
)""")


@query("topn_unseen", _UNSEEN_SQL + f"""
SELECT user_id, item_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM ranked
WHERE rank <= {N_CANDIDATES}""")
def topn_unseen(spark, sf_dir):
    """M-03, J-10: top-200 with each user's own items (its label's vectors)
    left out."""
    out = _emb_topn(spark, sf_dir, unseen=True)
    return out.select("user_id", "item_id", r6(F.col("score")).alias("score"),
                      F.col("rank").cast("long").alias("rank"))


@query("candidate_lookup", Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA, _PMAP_CTE) + _UNSEEN_SQL.replace("WITH ", ",", 1) + f"""
SELECT r.user_id, r.item_id, t.track_id, CAST(r.rank AS BIGINT) AS rank,
       CAST(ROW_NUMBER() OVER (PARTITION BY r.user_id ORDER BY r.rank, r.item_id) AS BIGINT) AS position
FROM ranked r JOIN tmap t ON t.track_int_id = r.item_id
WHERE r.rank <= {N_CANDIDATES} AND t.track_id IN (SELECT track_id FROM track_metadata)""")
def candidate_lookup(spark, sf_dir):
    """J-09, A-11, P-10 (K15): candidate int ids -> track ids through the
    catalog's id dimension; unmapped candidates drop out and positions close up."""
    catalog_ids = C.track_map(spark, sf_dir).join(C.track_metadata(spark, sf_dir).select("track_id"), "track_id", "left_semi")
    cands = _emb_topn(spark, sf_dir, unseen=True)
    dim = catalog_ids.select(F.col("track_int_id").alias("item_id"), "track_id")
    out = RV.lookup_ids(cands, dim, key="user_id", int_col="item_id", out_id="track_id")
    return out.select("user_id", "item_id", "track_id", F.col("rank").cast("long").alias("rank"),
                      F.col("position").cast("long").alias("position"))


# --------------------------------------------------------------------------
# Phase 4: stage-1 model (rows-only checks: not SQL-expressible)
# --------------------------------------------------------------------------

from ..operators import als as AL  # noqa: E402
from ..operators.ordering import global_row_number  # noqa: E402
from . import recommend as REC  # noqa: E402

ALS_RANK, ALS_ITERS, ALS_REG = 50, 15, 0.01


def trained_stage1(spark, sf_dir, fit_on: str = "all"):
    """Map ids, build confidence cells, fit ALS (K16: ``fit_on='all'`` as the
    reference; ``'seed_only'`` fits on the seed side of the eval split), save
    and reload the artifact.  Returns (model, mapped, cells).  The 'all' fit
    is shared with the two-stage plans (one fit per application)."""
    mapped = C.mapped(spark, sf_dir)
    cells = I.confidence(mapped)
    if fit_on == "all":
        s1 = REC.train_stage1(spark, sf_dir, REC.Params(rank=ALS_RANK, iters=ALS_ITERS, reg=ALS_REG))
        return AL.load_model(s1.model_path), mapped, cells
    model = AL.fit_als(I.confidence(seed_side(spark, sf_dir)), ALS_RANK, ALS_ITERS, ALS_REG)
    path = AL.save_model(model, scratch_path(spark, "als-model"))
    return AL.load_model(path), mapped, cells


def seed_side(spark, sf_dir):
    """The mapped rows that are not held out: the seed occurrences of eligible
    playlists, and every row of the others.  A pair with copies on both sides
    keeps its seed copies (K8)."""
    rows = whole_split(spark, sf_dir).filter((F.col("held") == 0) | (F.col("n") < MIN_TRACKS))
    return I.with_ids(rows.select("playlist_id", "track_id"), C.playlist_map(spark, sf_dir),
                      C.track_map(spark, sf_dir))


@query("seed_side", Q.with_(Q.INTERACTIONS, Q.split("interactions", HOLDOUT, SALT)) + f"""
SELECT playlist_id, track_id, CAST(COUNT(*) AS BIGINT) AS n_rows FROM split
WHERE pos > n_hold OR n < {MIN_TRACKS} GROUP BY 1, 2""")
def seed_side_rows(spark, sf_dir):
    """K16: the rows that the leakage-free fit reads, with their copies."""
    return seed_side(spark, sf_dir).groupBy("playlist_id", "track_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("als_candidates")
def als_candidates(spark, sf_dir):
    """M-02, M-03, M-05, M-06, L-07, S-10, S-11: fit ALS (50 factors, 15
    iterations, λ 0.01), save + load it, then the top-200 unseen tracks for
    every playlist (``als_rank`` <= 20 is the stage-1-only arm)."""
    model, mapped, cells = trained_stage1(spark, sf_dir)
    users, items = AL.factors(model)
    seen = cells.select(F.col("playlist_int_id").alias("user_id"), F.col("track_int_id").alias("item_id"))
    cand = RV.top_n(users, items, N_CANDIDATES, seen=seen)
    return cand.select(F.col("user_id").alias("playlist_int_id"), F.col("item_id").alias("track_int_id"),
                       F.col("score").alias("als_score"), F.col("rank").cast("int").alias("als_rank"))


def foldin_requests(spark, sf_dir, mapped):
    """Seed requests keyed by playlist int id, seeds as track int ids."""
    seeds = eval_heldout(spark, sf_dir).filter("held = 0").select("playlist_id", "track_id")
    return (seeds.join(C.playlist_map(spark, sf_dir), "playlist_id").join(C.track_map(spark, sf_dir), "track_id")
                 .select(F.col("playlist_int_id").alias("request_id"), F.col("track_int_id").alias("item_id")))


@query("foldin_candidates")
def foldin_candidates(spark, sf_dir):
    """M-04, M-05: cold-start user vectors folded in from each eligible
    playlist's seed tracks (occurrence confidence), then the top-200 tracks
    that are not seeds."""
    model, mapped, _ = trained_stage1(spark, sf_dir)
    _, items = AL.factors(model)
    seeds = foldin_requests(spark, sf_dir, mapped)
    conf = AL.seed_confidence(seeds, "occurrence")
    users = AL.fold_in(conf, items, ALS_REG).withColumnRenamed("request_id", "user_id")
    cand = RV.top_n(users, items, N_CANDIDATES,
                    seen=seeds.select(F.col("request_id").alias("user_id"), "item_id"))
    return cand.select(F.col("user_id").alias("request_id"), F.col("item_id").alias("track_int_id"),
                       F.col("score").alias("als_score"), F.col("rank").cast("int").alias("als_rank"))


def track_vectors(spark, sf_dir):
    """A given factor for every track: the embedding whose place (by vec_id) is
    the track's number modulo theirs, stretched by a 1024th for each time the
    embeddings were used up, so that no two tracks have equal factors."""
    def build():
        emb = global_row_number(T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "place")
        n = emb.count()
        tracks = C.track_map(spark, sf_dir).select(F.col("track_int_id").cast("long").alias("item_id"))
        rows = tracks.join(emb.select((F.col("place") - 1).alias("place"), "embedding"), F.col("item_id") % n == F.col("place"))
        stretch = F.lit(1.0) + F.expr(f"item_id div {n}") / F.lit(1024.0)
        return rows.select("item_id", F.transform("embedding", lambda x: (x.cast("double") * stretch).cast("float"))
                           .alias("features"))
    return C.shared_table(spark, ("track_vectors", sf_dir), build)


def _track_vectors_sql() -> str:
    return """
evec AS (SELECT embedding, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS place, COUNT(*) OVER () AS nv FROM embeddings),
tvec AS MATERIALIZED (
  SELECT t.track_int_id, list_transform(e.embedding, lambda x: CAST(CAST(x AS DOUBLE)
           * (1.0::DOUBLE + (t.track_int_id // e.nv) / 1024.0::DOUBLE) AS FLOAT)) AS fv
  FROM tmap t JOIN evec e ON t.track_int_id % e.nv = e.place
),
dvec AS MATERIALIZED (SELECT track_int_id, list_transform(fv, lambda x: CAST(x AS DOUBLE)) AS dv FROM tvec)"""


BLOCKS_K, BLOCKS_SIZE = 20, 256


def sized_factors(spark, sf_dir):
    """Given factors of differing lengths: every track's vector times its part's
    size, and as users the embeddings themselves."""
    sizes = (T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("track_id"), "p_size")
             .join(C.track_map(spark, sf_dir), "track_id"))
    sizes = sizes.select(F.col("track_int_id").cast("long").alias("item_id"), F.col("p_size").cast("double").alias("_s"))
    items = track_vectors(spark, sf_dir).join(sizes, "item_id").select(
        "item_id", F.transform("features", lambda x: (x.cast("double") * F.col("_s")).cast("float")).alias("features"))
    users = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("features"))
    return users, items


def sized_top(spark, sf_dir):
    """Top rows and block report over ``sized_factors``, both written once."""
    both = []

    def build(part):
        if not both:
            both.extend(RV.top_n_blocks(*sized_factors(spark, sf_dir), BLOCKS_K, item_block=BLOCKS_SIZE))
        return both[part]
    return tuple(C.shared_table(spark, (f"sized_top_{part}", sf_dir), lambda part=part: build(part)) for part in (0, 1))


def _sized_sql() -> tuple:
    return (Q.INTERACTIONS, _PMAP_CTE, _track_vectors_sql(), """
sized AS MATERIALIZED (
  SELECT t.track_int_id AS item_id, list_transform(t.fv, lambda x: CAST(CAST(CAST(x AS DOUBLE) * p.p_size AS FLOAT) AS DOUBLE)) AS dv
  FROM tvec t JOIN tmap m USING (track_int_id) JOIN part p ON CAST(p.p_partkey AS VARCHAR) = m.track_id
),
lens AS (SELECT *, SQRT(list_dot_product(dv, dv)) AS len FROM sized),
ordered AS MATERIALIZED (SELECT *, (ROW_NUMBER() OVER (ORDER BY len DESC, item_id) - 1) // %d AS block FROM lens),
sdot AS MATERIALIZED (
  SELECT e.vec_id AS user_id, o.item_id, o.block, list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), o.dv) AS score
  FROM embeddings e CROSS JOIN ordered o
)""" % BLOCKS_SIZE)


@query("topn_sized", Q.with_(*_sized_sql()) + f"""
SELECT user_id, item_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sdot)
WHERE rank <= {BLOCKS_K}""")
def topn_sized(spark, sf_dir):
    """M-05: exact top-20 tracks of each embedding where lengths differ, found block by
    block of falling length, with the blocks out of a user's reach left out."""
    out = sized_top(spark, sf_dir)[0]
    return out.select("user_id", "item_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("topn_blocks", Q.with_(*_sized_sql(), f"""
ulen AS (SELECT vec_id AS user_id, SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS ulen
         FROM embeddings),
blocks AS (SELECT block, COUNT(*) AS n_items, MAX(len) AS max_length,
                  CASE WHEN block = 0 THEN 0 ELSE CAST(2 ** FLOOR(LOG2(block)) AS BIGINT) END AS wave
           FROM ordered GROUP BY block),
waves AS (SELECT DISTINCT wave FROM blocks WHERE wave > 0),
kth AS (
  SELECT wave, user_id, score AS kth FROM (
    SELECT w.wave, s.user_id, s.score,
           ROW_NUMBER() OVER (PARTITION BY w.wave, s.user_id ORDER BY s.score DESC, s.item_id) AS rank
    FROM sdot s JOIN waves w ON s.block < w.wave) WHERE rank = {BLOCKS_K}
)""") + f"""
SELECT CAST(b.block AS INTEGER) AS block, CAST(ANY_VALUE(b.n_items) AS BIGINT) AS n_items,
       ROUND(ANY_VALUE(b.max_length), 6) AS max_length, CAST(COUNT(*) AS BIGINT) AS n_users,
       CAST(COUNT(*) FILTER (WHERE k.kth IS NULL OR u.ulen * b.max_length * {RV.BOUND_SLACK!r}::DOUBLE >= k.kth) AS BIGINT) AS n_scored
FROM blocks b CROSS JOIN ulen u LEFT JOIN kth k ON k.wave = b.wave AND k.user_id = u.user_id
GROUP BY b.block""")
def topn_blocks(spark, sf_dir):
    """M-05: for each item block of ``topn_sized``, the users scored against it; all
    others had their top 20 above the block's bound."""
    return sized_top(spark, sf_dir)[1].withColumn("max_length", r6(F.col("max_length")))


def _candidates_sql() -> str:
    """``cands``: the top unseen tracks by the mean factor of ``seeds``."""
    return f"""
sdims AS (
  SELECT s.playlist_int_id, generate_subscripts(e.fv, 1) AS d, unnest(e.fv) AS v
  FROM seeds s JOIN tvec e USING (track_int_id)
),
smean AS (SELECT playlist_int_id, d, CAST(AVG(CAST(v AS DOUBLE)) AS FLOAT) AS m FROM sdims GROUP BY 1, 2),
svec AS MATERIALIZED (SELECT playlist_int_id, list(CAST(m AS DOUBLE) ORDER BY d) AS uv FROM smean GROUP BY 1),
sc AS (
  SELECT u.playlist_int_id, e.track_int_id, list_dot_product(u.uv, e.dv) AS als_score
  FROM svec u CROSS JOIN dvec e
  WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.playlist_int_id = u.playlist_int_id AND x.track_int_id = e.track_int_id)
),
cands AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY playlist_int_id ORDER BY als_score DESC, track_int_id)
                 AS als_rank FROM sc) WHERE als_rank <= {N_CANDIDATES}
)"""


@query("foldin_vectors", Q.with_(Q.INTERACTIONS, _MAPPED_CTE) + """
SELECT m.confidence, CAST(playlist_int_id AS BIGINT) AS request_id, CAST(COUNT(DISTINCT track_int_id) AS BIGINT) AS n_seeds,
       0.0::DOUBLE AS residual
FROM mapped, (VALUES ('occurrence'), ('popularity')) m(confidence) GROUP BY m.confidence, playlist_int_id""")
def foldin_vectors(spark, sf_dir):
    """M-04, K1 on given factors: one vector per playlist from all its
    interactions, for both confidence rules, with the residual of its normal
    equations, relative to the greatest entry of the Gram matrix, to 4 digits."""
    items = track_vectors(spark, sf_dir)
    seeds = C.mapped(spark, sf_dir).select(F.col("playlist_int_id").alias("request_id"), F.col("track_int_id").alias("item_id"))
    popularity = seeds.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_interactions"))
    scale = float(abs(AL.gram(items)).max())
    out = None
    for mode in ("occurrence", "popularity"):
        conf = C.shared_copy(AL.seed_confidence(seeds, mode, popularity), "confidence")
        vectors = C.shared_copy(AL.fold_in(conf, items, ALS_REG), "vectors")
        one = AL.normal_residual(conf, items, vectors, ALS_REG).select(
            F.lit(mode).alias("confidence"), "request_id", "n_seeds",
            F.abs(F.round(F.col("residual") / F.lit(scale), 4)).alias("residual"))
        out = one if out is None else out.unionByName(one)
    return out


@query("als_loss_given", Q.with_(Q.INTERACTIONS, _PMAP_CTE, _MAPPED_CTE, _track_vectors_sql()) + f""",
cells AS (SELECT playlist_int_id, track_int_id, COUNT(*) AS c FROM mapped GROUP BY 1, 2),
udims AS (SELECT m.playlist_int_id, generate_subscripts(e.fv, 1) AS d, unnest(e.fv) AS v FROM mapped m JOIN tvec e USING (track_int_id)),
umean AS (SELECT playlist_int_id, d, CAST(AVG(CAST(v AS DOUBLE)) AS FLOAT) AS m FROM udims GROUP BY 1, 2),
uvec AS MATERIALIZED (SELECT playlist_int_id, list(CAST(m AS DOUBLE) ORDER BY d) AS uv FROM umean GROUP BY 1),
pairs AS (
  SELECT COALESCE(c.c, 0) AS c, list_dot_product(u.uv, e.dv) AS p,
         list_dot_product(u.uv, u.uv) AS uu, list_dot_product(e.dv, e.dv) AS ee
  FROM uvec u CROSS JOIN dvec e LEFT JOIN cells c USING (playlist_int_id, track_int_id)),
total AS (
  SELECT CAST(COUNT(*) FILTER (WHERE c > 0) AS BIGINT) AS n_cells, SUM(p * p) AS squares,
         SUM(CASE WHEN c > 0 THEN c * (1 - p) * (1 - p) - p * p ELSE 0 END) AS observed,
         {ALS_REG}::DOUBLE * SUM(CASE WHEN c > 0 THEN uu + ee ELSE 0 END) AS penalty,
         SUM(CASE WHEN c > 0 THEN c * (1 - p) * (1 - p) ELSE p * p END) AS fit
  FROM pairs)
SELECT n_cells, ROUND(squares, 3) AS squares, ROUND(observed, 3) AS observed, ROUND(penalty, 3) AS penalty,
       ROUND(fit + penalty, 3) AS loss FROM total""")
def als_loss_given(spark, sf_dir):
    """M-02: the implicit objective over all playlist-track cells on given
    factors (the SQL forms every pair, the operator none)."""
    items, mapped = track_vectors(spark, sf_dir), C.mapped(spark, sf_dir)
    rows = mapped.select(F.col("playlist_int_id").alias("user_id"), F.col("track_int_id").cast("long").alias("item_id"))
    users = T.element_mean(rows, "user_id", "features", of=items)
    out = AL.implicit_loss(C.shared_copy(users, "mean-factors"), items, I.confidence(mapped), ALS_REG)
    return out.select("n_cells", *[round_to(F.col(c), 3).alias(c) for c in ("squares", "observed", "penalty", "loss")])


# --------------------------------------------------------------------------
# Phase 5: training set.  SQL-checked with a deterministic candidate source:
# given-factor retrieval (F2) where every track has a given factor and a
# playlist's factor is the mean of its seed tracks'.
# --------------------------------------------------------------------------

from ..operators import training as TR  # noqa: E402

N_TRAIN, N_NEG = 10000, 50


def training_split(spark, sf_dir):
    """Split of the first N_TRAIN playlists with >= 2 tracks (L-01, P-11),
    with int ids attached: [playlist_int_id, track_int_id, track_id, held]."""
    mapped = C.mapped(spark, sf_dir)
    pmap, tmap = C.playlist_map(spark, sf_dir), C.track_map(spark, sf_dir)
    keep = S.train_playlists(mapped, N_TRAIN).select("playlist_int_id")
    rows = mapped.join(keep, "playlist_int_id", "left_semi").select("playlist_id", "track_id")
    sp = S.holdout_split(rows, HOLDOUT, SALT)
    sp = sp.join(pmap, "playlist_id").join(tmap, "track_id")
    return sp.select("playlist_int_id", "track_int_id", "track_id", "held"), tmap


def embedding_candidates(spark, sf_dir, seeds):
    """Top-200 unseen tracks for each playlist's mean seed factor."""
    items = track_vectors(spark, sf_dir)
    rows = seeds.select(F.col("playlist_int_id").alias("user_id"), F.col("track_int_id").cast("long").alias("item_id"))
    users = T.element_mean(rows, "user_id", "features", of=items)
    c = RV.top_n(users, items, N_CANDIDATES, seen=rows)
    return c.select(F.col("user_id").alias("playlist_int_id"), F.col("item_id").alias("track_int_id"),
                    F.col("score").alias("als_score"), F.col("rank").cast("long").alias("als_rank"))


def _training_pipeline(spark, sf_dir):
    """Split and candidates are written once per application and shared by
    the four training-set queries."""
    split_tbl = C.shared_table(spark, ("train_split", sf_dir), lambda: training_split(spark, sf_dir)[0])
    tmap = C.track_map(spark, sf_dir)
    seeds = split_tbl.filter("held = 0")
    targets = split_tbl.filter("held = 1").select("playlist_int_id", "track_int_id")
    cands = C.shared_table(spark, ("train_emb_cands", sf_dir), lambda: embedding_candidates(spark, sf_dir, seeds))
    labelled = TR.label_candidates(cands, targets)
    sampled = TR.hard_negatives(labelled, N_NEG)
    return seeds, tmap, labelled, sampled


_TRAIN_SQL = Q.with_(Q.INTERACTIONS, Q.TRACK_METADATA, _PMAP_CTE, _MAPPED_CTE, f"""
tp AS (SELECT DISTINCT playlist_int_id FROM mapped ORDER BY playlist_int_id LIMIT {N_TRAIN}),
tsz AS (SELECT playlist_int_id FROM mapped WHERE playlist_int_id IN (SELECT playlist_int_id FROM tp)
        GROUP BY playlist_int_id HAVING COUNT(*) >= 2),
tr AS (SELECT playlist_id, track_id FROM mapped WHERE playlist_int_id IN (SELECT playlist_int_id FROM tsz))""",
    Q.split("tr", HOLDOUT, SALT, name="tsplit"), f"""
ts AS (
  SELECT p.playlist_int_id, t.track_int_id, s.track_id, CASE WHEN s.pos <= s.n_hold THEN 1 ELSE 0 END AS held
  FROM tsplit s JOIN pmap p USING (playlist_id) JOIN tmap t USING (track_id)
),
seeds AS (SELECT playlist_int_id, track_int_id, track_id FROM ts WHERE held = 0),
targets AS (SELECT DISTINCT playlist_int_id, track_int_id FROM ts WHERE held = 1)""", _track_vectors_sql(), _candidates_sql(), f"""
lab AS (
  SELECT c.*, CAST(CASE WHEN t.track_int_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label
  FROM cands c LEFT JOIN targets t USING (playlist_int_id, track_int_id)
),
labelled AS (SELECT * FROM lab WHERE playlist_int_id IN (SELECT playlist_int_id FROM lab WHERE label = 1)),
sampled AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY playlist_int_id, label ORDER BY als_rank, track_int_id) AS r
    FROM labelled) WHERE label = 1 OR r <= {N_NEG}
),
prof AS (
  SELECT s.playlist_int_id, {", ".join(f"AVG(m.{f}) AS avg_{f}" for f in FEATURES)}
  FROM seeds s JOIN track_metadata m USING (track_id) GROUP BY s.playlist_int_id
),
frame AS (
  SELECT x.playlist_int_id, t.track_id, x.label, x.als_score,
         {", ".join(f"m.{f} AS track_{f}" for f in FEATURES)},
         {", ".join(f"p.avg_{f}" for f in FEATURES)},
         {", ".join(f"ABS(p.avg_{f} - m.{f}) AS {f}_diff" for f in FEATURES)}
  FROM sampled x JOIN tmap t USING (track_int_id) JOIN track_metadata m USING (track_id)
  JOIN prof p USING (playlist_int_id)
)""")

_CAND_COLS_SQL = """CAST(playlist_int_id AS BIGINT) AS playlist_int_id, CAST(track_int_id AS BIGINT) AS track_int_id,
       ROUND(als_score, 6) AS als_score, CAST(als_rank AS BIGINT) AS als_rank, label"""


def _cand_cols(df):
    return df.select(F.col("playlist_int_id").cast("long").alias("playlist_int_id"),
                     F.col("track_int_id").cast("long").alias("track_int_id"),
                     r6(F.col("als_score")).alias("als_score"),
                     F.col("als_rank").cast("long").alias("als_rank"), "label")


@query("label_candidates", _TRAIN_SQL + f"SELECT {_CAND_COLS_SQL} FROM labelled")
def label_candidates(spark, sf_dir):
    """P-13, P-14: candidates labelled by the held-out targets; playlists with
    no retrieved target dropped (K24)."""
    _, _, labelled, _ = _training_pipeline(spark, sf_dir)
    return _cand_cols(labelled)


@query("hard_negatives", _TRAIN_SQL + f"SELECT {_CAND_COLS_SQL} FROM sampled")
def hard_negatives(spark, sf_dir):
    """W-04, U-02: positives plus the 50 highest-scored negatives per playlist."""
    _, _, _, sampled = _training_pipeline(spark, sf_dir)
    return _cand_cols(sampled)


def _train_frame(spark, sf_dir):
    seeds, tmap, _, sampled = _training_pipeline(spark, sf_dir)
    return TR.training_frame(sampled.drop("als_rank"), tmap, C.track_metadata(spark, sf_dir),
                             seeds.select("playlist_int_id", "track_id"))


@query("training_frame", _TRAIN_SQL + f"""
SELECT CAST(playlist_int_id AS BIGINT) AS playlist_int_id, track_id, label, ROUND(als_score, 6) AS als_score,
       {", ".join(f"ROUND({c}, 6) AS {c}" for c in TRACK_FEATURES)},
       {", ".join(f"{stable_round_sql(c)} AS {c}" for c in AVG_FEATURES + DIFF_FEATURES)}
FROM frame""")
def training_frame(spark, sf_dir):
    """M-08, J-06, P-17 inputs: labelled rows with track, profile and
    difference features."""
    f = _train_frame(spark, sf_dir)
    return f.select(F.col("playlist_int_id").cast("long").alias("playlist_int_id"), "track_id", "label",
                    r6(F.col("als_score")).alias("als_score"), *[r6(F.col(c)).alias(c) for c in TRACK_FEATURES],
                    *[stable_round(F.col(c)).alias(c) for c in AVG_FEATURES + DIFF_FEATURES])


@query("both_label_groups", _TRAIN_SQL + """
SELECT CAST(playlist_int_id AS BIGINT) AS playlist_int_id, CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(label) AS BIGINT) AS n_pos
FROM frame GROUP BY playlist_int_id HAVING COUNT(DISTINCT label) = 2""")
def both_label_groups(spark, sf_dir):
    """A-08, P-15, A-09, L-05: groups with both labels, contiguous by playlist,
    and their sizes in playlist order."""
    f = TR.grouped_by_playlist(TR.both_label_groups(_train_frame(spark, sf_dir)))
    return TR.group_sizes(f).select(F.col("playlist_int_id").cast("long").alias("playlist_int_id"),
                                    "n_rows", "n_pos")


# --------------------------------------------------------------------------
# Phase 6: ranker, rerank, batch recommendation
# --------------------------------------------------------------------------

from ..operators import experiment as EX  # noqa: E402
from ..operators import ranker as RK  # noqa: E402

@query("lambda_first_round", _TRAIN_SQL + """,
ordered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY playlist_int_id ORDER BY als_score DESC, track_id) AS r,
         SUM(label) OVER (PARTITION BY playlist_int_id) AS np, COUNT(*) OVER (PARTITION BY playlist_int_id) AS n
  FROM frame
),
fr AS (SELECT *, list_sum(list_transform(range(1, np::BIGINT + 1), lambda i: 1.0 / LOG2(1.0 + i))) AS idcg
       FROM ordered WHERE np > 0 AND np < n),
pairs AS (
  SELECT p.playlist_int_id, p.r AS pr, q.r AS nr, ABS(1.0 / LOG2(1.0 + p.r) - 1.0 / LOG2(1.0 + q.r)) / p.idcg AS d
  FROM fr p JOIN fr q ON p.playlist_int_id = q.playlist_int_id AND p.label = 1 AND q.label = 0
),
sums AS (
  SELECT playlist_int_id, pr AS r, SUM(d) AS d FROM pairs GROUP BY 1, 2
  UNION ALL SELECT playlist_int_id, nr AS r, -SUM(d) AS d FROM pairs GROUP BY 1, 2
)
SELECT CAST(f.playlist_int_id AS BIGINT) AS playlist_int_id, f.track_id, f.label,
       ROUND(0.5 * s.d, 6) AS lam, ROUND(0.25 * ABS(s.d), 6) AS w
FROM fr f JOIN sums s USING (playlist_int_id, r)""")
def lambda_first_round(spark, sf_dir):
    """M-09: gradients and weights of the first boosting round, where all scores
    are zero and the ranking is the tie order."""
    rows = RK.ordered_rows(TR.both_label_groups(_train_frame(spark, sf_dir)), "playlist_int_id",
                           ["track_id", "als_score"])
    data = (rows.withColumn("score", F.lit(0.0)).repartition("playlist_int_id")
            .sortWithinPartitions("playlist_int_id", "row_id"))
    return RK.lambda_rows(data, "playlist_int_id").select(
        F.col("playlist_int_id").cast("long").alias("playlist_int_id"), "track_id", "label",
        r6(F.col("lam")).alias("lam"), r6(F.col("w")).alias("w"))


def _first_tree_sql() -> str:
    """Two levels of the first tree over the rounded training frame: quantile
    cuts, sums per node, input and cut, and the best split of each node."""
    from ..sources.schemas import MODEL_INPUTS
    bins, reg, least = 128, 1.0, 1.0
    inputs = ", ".join(f"{{'f': {i}, 'v': CAST({c} AS DOUBLE)}}" for i, c in enumerate(MODEL_INPUTS))
    rounded = ", ".join([f"ROUND({c}, 6) AS {c}" for c in ["als_score", *TRACK_FEATURES]]
                        + [f"{stable_round_sql(c)} AS {c}" for c in AVG_FEATURES + DIFF_FEATURES])

    def level(n: int) -> str:
        return f"""
tot{n} AS (SELECT node, SUM(lam) AS g, SUM(w) AS h FROM rows{n} GROUP BY node),
val{n} AS (SELECT r.node, b.f, b.v, b.b, r.lam, r.w FROM rows{n} r JOIN binned b USING (playlist_int_id, r)),
mis{n} AS (SELECT node, f, SUM(lam) AS g, SUM(w) AS h FROM val{n} WHERE v IS NULL GROUP BY 1, 2),
cell{n} AS (SELECT node, f, b AS cut, SUM(lam) AS g, SUM(w) AS h FROM val{n} WHERE b IS NOT NULL GROUP BY 1, 2, 3),
at{n} AS (
  SELECT t.node, c.f, c.cut, SUM(COALESCE(x.g, 0)) OVER p AS g, SUM(COALESCE(x.h, 0)) OVER p AS h
  FROM tot{n} t CROSS JOIN cuts c LEFT JOIN cell{n} x ON x.node = t.node AND x.f = c.f AND x.cut = c.cut
  WINDOW p AS (PARTITION BY t.node, c.f ORDER BY c.cut)),
side{n} AS (
  SELECT a.node, a.f, a.cut, s.side, a.g + s.side * COALESCE(m.g, 0) AS gl, a.h + s.side * COALESCE(m.h, 0) AS hl,
         t.g, t.h
  FROM at{n} a JOIN tot{n} t USING (node) LEFT JOIN mis{n} m USING (node, f), (VALUES (0), (1)) s(side)),
gain{n} AS (
  SELECT *, gl * gl / (hl + {reg}) + (g - gl) * (g - gl) / (h - hl + {reg}) - g * g / (h + {reg}) AS gain
  FROM side{n} WHERE hl >= {least} AND h - hl >= {least}),
split{n} AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, cut, side) AS k FROM gain{n})
  WHERE k = 1 AND gain > 1e-10)"""

    return _TRAIN_SQL + f""",
rf AS (SELECT playlist_int_id, track_id, label, {rounded} FROM frame),
ordered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY playlist_int_id ORDER BY als_score DESC, track_id) AS r,
         SUM(label) OVER (PARTITION BY playlist_int_id) AS np, COUNT(*) OVER (PARTITION BY playlist_int_id) AS n
  FROM rf
),
fr AS MATERIALIZED (
  SELECT *, list_sum(list_transform(range(1, np::BIGINT + 1), lambda i: 1.0 / LOG2(1.0 + i))) AS idcg
  FROM ordered WHERE np > 0 AND np < n),
pairs AS (
  SELECT p.playlist_int_id, p.r AS pr, q.r AS nr, ABS(1.0 / LOG2(1.0 + p.r) - 1.0 / LOG2(1.0 + q.r)) / p.idcg AS d
  FROM fr p JOIN fr q ON p.playlist_int_id = q.playlist_int_id AND p.label = 1 AND q.label = 0
),
sums AS (
  SELECT playlist_int_id, pr AS r, SUM(d) AS d FROM pairs GROUP BY 1, 2
  UNION ALL SELECT playlist_int_id, nr AS r, -SUM(d) AS d FROM pairs GROUP BY 1, 2
),
grads AS MATERIALIZED (
  SELECT f.*, ROUND(0.5 * s.d * 16777216) / 16777216 AS lam, ROUND(0.25 * ABS(s.d) * 16777216) / 16777216 AS w
  FROM fr f JOIN sums s USING (playlist_int_id, r)),
long AS MATERIALIZED (
  SELECT playlist_int_id, r, u.f AS f, u.v AS v FROM (SELECT playlist_int_id, r, unnest([{inputs}]) AS u FROM grads)),
vals AS (SELECT f, v, COUNT(*) AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2),
run AS (SELECT f, v, n, SUM(n) OVER (PARTITION BY f ORDER BY v) AS upto, SUM(n) OVER (PARTITION BY f) AS total FROM vals),
cuts AS MATERIALIZED (
  SELECT f, v AS cut FROM run WHERE LEAST((upto * {bins}) // total, {bins - 1}) > ((upto - n) * {bins}) // total),
binned AS MATERIALIZED (
  SELECT l.*, c.cut AS b FROM long l ASOF LEFT JOIN cuts c ON l.f = c.f AND l.v <= c.cut),
rows0 AS (SELECT playlist_int_id, r, lam, w, 0 AS node FROM grads),{level(0)},
rows1 AS (
  SELECT g.playlist_int_id, g.r, g.lam, g.w,
         CASE WHEN (b.v IS NULL AND s.side = 1) OR b.v <= s.cut THEN 1 ELSE 2 END AS node
  FROM rows0 g CROSS JOIN split0 s JOIN binned b ON b.playlist_int_id = g.playlist_int_id AND b.r = g.r AND b.f = s.f),{level(1)},
kids AS (SELECT *, 1 + 2 * ROW_NUMBER() OVER (ORDER BY node) AS l FROM split1),
nodes AS (
  SELECT t.node, s.f, s.cut, s.side, CASE WHEN s.f IS NULL THEN 0 ELSE 1 END AS l, t.g, t.h FROM tot0 t LEFT JOIN split0 s USING (node)
  UNION ALL SELECT t.node, s.f, s.cut, s.side, s.l, t.g, t.h FROM tot1 t LEFT JOIN kids s USING (node)
  UNION ALL SELECT l, NULL, NULL, NULL, NULL, gl, hl FROM kids
  UNION ALL SELECT l + 1, NULL, NULL, NULL, NULL, g - gl, h - hl FROM kids)
SELECT CAST(node AS INTEGER) AS node, CAST(COALESCE(f, -1) AS INTEGER) AS feature, ROUND(COALESCE(cut, 0), 6) AS cut,
       COALESCE(side, 0) = 1 AS missing_left, CAST(COALESCE(l, 0) AS INTEGER) AS left_node,
       CAST(CASE WHEN COALESCE(l, 0) = 0 THEN 0 ELSE l + 1 END AS INTEGER) AS right_node, ROUND(g / (h + {reg}), 6) + 0.0::DOUBLE AS value
FROM nodes"""


@query("ranker_first_tree", _first_tree_sql())
def ranker_first_tree(spark, sf_dir):
    """M-09: the node table of a ranker of one tree with two levels, learned from
    the whole training frame (its columns rounded alike in both engines)."""
    model = RK.fit_lambdamart(TR.both_label_groups(training_frame.__wrapped__(spark, sf_dir)), n_trees=1, max_depth=2)
    return model.table(spark).select("node", "feature", r6(F.col("cut")).alias("cut"), "missing_left",
                                     F.col("left").alias("left_node"), F.col("right").alias("right_node"),
                                     (r6(F.col("value")) + F.lit(0.0)).alias("value"))   # no negative zero


#: A given ranker of two trees over five inputs: (tree, node, feature, cut,
#: missing_left, left, right, value).
GIVEN_INPUTS = ["als_score", "track_tempo", "acousticness_diff", "valence_diff", "track_danceability"]
GIVEN_NODES = [
    (0, 0, 2, 9.5, True, 1, 2, 0.0), (0, 1, 0, 29.5, False, 3, 4, 0.0), (0, 2, 1, 1400.0, False, 5, 6, 0.0),
    (0, 3, -1, 0.0, False, 0, 0, 0.5), (0, 4, -1, 0.0, False, 0, 0, 1.25), (0, 5, -1, 0.0, False, 0, 0, -0.75),
    (0, 6, 3, 2500.0, True, 7, 8, 0.0), (0, 7, -1, 0.0, False, 0, 0, 0.0625), (0, 8, -1, 0.0, False, 0, 0, -2.0),
    (1, 0, 4, 0.05, False, 1, 2, 0.0), (1, 1, -1, 0.0, False, 0, 0, 3.0), (1, 2, 0, 31.0, False, 3, 4, 0.0),
    (1, 3, -1, 0.0, False, 0, 0, -1.5), (1, 4, -1, 0.0, False, 0, 0, 0.25)]
_GIVEN_INPUTS_SQL = ", ".join(f"{{'feature': {i}, 'v': CAST({c} AS DOUBLE)}}" for i, c in enumerate(GIVEN_INPUTS))
_GIVEN_SQL = f"""
WITH RECURSIVE frame AS MATERIALIZED ({ORACLE["cross_features"]}),
nodes(tree, node, feature, cut, missing_left, l, r, value) AS (VALUES {", ".join(map(str, GIVEN_NODES))}),
x AS MATERIALIZED (
  SELECT request_id, track_int_id, u.feature AS feature, u.v AS v
  FROM (SELECT request_id, track_int_id, unnest([{_GIVEN_INPUTS_SQL}]) AS u FROM frame)),
walk AS (
  SELECT f.request_id, f.track_int_id, n.* FROM frame f, nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.request_id, w.track_int_id, n.*
  FROM walk w JOIN x USING (request_id, track_int_id, feature)
  JOIN nodes n ON n.tree = w.tree
   AND n.node = CASE WHEN (x.v IS NULL AND w.missing_left) OR x.v <= w.cut THEN w.l ELSE w.r END
  WHERE w.feature >= 0
)
SELECT request_id, track_int_id, ROUND(0.5 + 0.1::DOUBLE * SUM(value::DOUBLE), 6) AS rank_score
FROM walk WHERE feature < 0 GROUP BY request_id, track_int_id"""


@query("ranker_table_scores", _GIVEN_SQL)
def ranker_table_scores(spark, sf_dir):
    """M-10, S-10, S-11: a given node table saved, loaded and walked for every
    candidate of ``cross_features``; missing inputs take the node's side."""
    given = RK.LambdaMARTModel(GIVEN_NODES, 0.1, 0.5, GIVEN_INPUTS)
    model = RK.LambdaMARTModel.load(given.save(scratch_path(spark, "given-ranker")))
    scored = model.score(cross_features.__wrapped__(spark, sf_dir))
    return scored.select("request_id", F.col("track_int_id").cast("long").alias("track_int_id"),
                         r6(F.col("rank_score")).alias("rank_score"))


def check_params() -> REC.Params:
    """The reference's settings: 50 factors, 15 iterations, λ 0.01, 200
    candidates, 10,000 training playlists, 50 negatives, 100 trees, lr 0.1,
    depth 6.  Both trained stages are memoised per application, so only the
    first query that needs them pays for training."""
    return REC.Params()


@query("rerank_topk", Q.with_(*_SPLIT_ELIGIBLE, Q.TRACK_METADATA, _PMAP_CTE, _SEEDS_CTE, f"""
counts AS (SELECT track_id, COUNT(*) AS c FROM interactions GROUP BY track_id),
cands AS (
  SELECT DISTINCT s.playlist_id AS request_id, t.track_int_id
  FROM split s JOIN tmap t USING (track_id) WHERE s.pos <= s.n_hold
),
prof AS (
  SELECT r.request_id, x.avg_acousticness
  FROM (SELECT DISTINCT request_id FROM seeds) r LEFT JOIN (
    SELECT s.request_id, AVG(m.acousticness) AS avg_acousticness
    FROM (SELECT DISTINCT request_id, track_id FROM seeds) s JOIN track_metadata m USING (track_id)
    GROUP BY s.request_id) x USING (request_id)
),
scored AS (
  SELECT c.request_id, c.track_int_id, CAST(n.c AS DOUBLE) AS als_score,
         0.0 - ROUND(COALESCE({stable_round_sql('ABS(x.avg_acousticness - m.acousticness)')}, 1000.0)) AS rank_score
  FROM cands c JOIN tmap t USING (track_int_id) JOIN counts n USING (track_id)
  JOIN track_metadata m USING (track_id) LEFT JOIN prof x USING (request_id)
)""") + f"""
SELECT * FROM (
  SELECT request_id, CAST(track_int_id AS BIGINT) AS track_int_id, als_score, rank_score,
         CAST(ROW_NUMBER() OVER (PARTITION BY request_id
              ORDER BY rank_score DESC, als_score DESC, track_int_id ASC) AS BIGINT) AS rank
  FROM scored) WHERE rank <= {K}""")
def rerank_topk(spark, sf_dir):
    """W-03, M-10 tie-break (K14) on given scores: the cross-feature frame of
    ``cross_features`` scored by a coarse given score with many ties
    (``0 - round(|acousticness diff|)``), top-20 by (score, als_score, id)."""
    feats = cross_features.__wrapped__(spark, sf_dir)
    scored = feats.withColumn(
        "rank_score", F.lit(0.0) - F.round(F.coalesce(F.col("acousticness_diff"), F.lit(1000.0))))
    top = RK.rerank_topk(scored, K)
    return top.select("request_id", F.col("track_int_id").cast("long").alias("track_int_id"),
                      "als_score", "rank_score", F.col("rank").cast("long").alias("rank"))


_DIAGNOSTIC_CTES = (*_SPLIT_ELIGIBLE, Q.TRACK_METADATA, _PMAP_CTE, f"""
seeds AS (
  SELECT p.playlist_int_id, t.track_int_id, s.track_id
  FROM split s JOIN pmap p USING (playlist_id) JOIN tmap t USING (track_id) WHERE s.pos > s.n_hold)""",
    _track_vectors_sql(), _candidates_sql(), f"""
pool AS (SELECT c.playlist_int_id AS request_id, c.track_int_id, t.track_id, ROUND(c.als_score, 6) AS als_score
         FROM cands c JOIN tmap t USING (track_int_id)),
prof AS (
  SELECT s.request_id, AVG(m.acousticness) AS a
  FROM (SELECT DISTINCT playlist_int_id AS request_id, track_id FROM seeds) s JOIN track_metadata m USING (track_id)
  GROUP BY s.request_id
),
scored AS (
  SELECT p.*, 0.0 - ROUND(COALESCE({stable_round_sql('ABS(x.a - m.acousticness)')}, 1000.0)) AS rank_score
  FROM pool p JOIN track_metadata m USING (track_id) LEFT JOIN prof x USING (request_id)
),
held AS (SELECT p.playlist_int_id AS request_id, s.track_id FROM split s JOIN pmap p USING (playlist_id) WHERE s.pos <= s.n_hold),
hd AS (SELECT DISTINCT * FROM held),
als AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY als_score DESC, track_int_id) AS ar FROM pool),
eng AS (SELECT request_id, track_int_id, rank_score,
               ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY rank_score DESC, als_score DESC, track_int_id) AS er FROM scored),
both_arms AS (
  SELECT a.*, e.rank_score, e.er, h.track_id IS NOT NULL AS hit
  FROM als a LEFT JOIN eng e USING (request_id, track_int_id) LEFT JOIN hd h USING (request_id, track_id)
)""")


@query("diagnostics_given", Q.with_(*_DIAGNOSTIC_CTES) + f"""
SELECT CAST(b.request_id AS BIGINT) AS request_id, CAST(COUNT(*) AS BIGINT) AS n_retrieved, CAST(COUNT(rank_score) AS BIGINT) AS n_scored,
       MIN(als_score) FILTER (WHERE er IS NOT NULL) AS als_min, MAX(als_score) FILTER (WHERE er IS NOT NULL) AS als_max,
       ROUND(STDDEV_POP(als_score) FILTER (WHERE er IS NOT NULL), 6) AS als_std,
       MIN(rank_score) AS score_min, MAX(rank_score) AS score_max, ROUND(STDDEV_POP(rank_score), 6) AS score_std,
       CAST(COUNT(DISTINCT rank_score) AS BIGINT) AS n_distinct_scores,
       CAST(COUNT(*) FILTER (WHERE ar <= {K} AND hit) AS BIGINT) AS als_hits,
       CAST(COUNT(*) FILTER (WHERE er <= {K} AND hit) AS BIGINT) AS engine_hits,
       CAST(COUNT(*) FILTER (WHERE ar <= {K} AND er <= {K} AND hit) AS BIGINT) AS als_hits_kept,
       COALESCE(STRING_AGG(track_id, ',' ORDER BY ar) FILTER (WHERE ar <= 5), '') AS als_top5,
       COALESCE(STRING_AGG(track_id, ',' ORDER BY er) FILTER (WHERE er <= 5), '') AS engine_top5,
       CAST(CASE WHEN COUNT(DISTINCT rank_score) = 1 THEN 1 ELSE 0 END AS INTEGER) AS degenerate,
       CAST((SELECT COUNT(*) FROM held WHERE held.request_id = b.request_id) AS BIGINT) AS n_held
FROM both_arms b GROUP BY b.request_id""")
def diagnostics_given(spark, sf_dir):
    """E-08, A-17, J-12 on given factors and scores: the top-200 unseen tracks
    of every eligible playlist's mean seed factor (tracks without metadata
    included), reranked by the coarse score of ``rerank_topk``, against all
    held-out rows, k = 20."""
    split = eval_heldout(spark, sf_dir).join(C.playlist_map(spark, sf_dir), "playlist_id")
    tmap, meta = C.track_map(spark, sf_dir), C.track_metadata(spark, sf_dir)
    seeds = split.filter("held = 0").select("playlist_int_id", "track_id")
    cands = C.shared_table(spark, ("eval_emb_cands", sf_dir),
                           lambda: embedding_candidates(spark, sf_dir, seeds.join(tmap, "track_id")))
    pool = cands.join(tmap, "track_int_id").select(
        F.col("playlist_int_id").alias("request_id"), "track_int_id", "track_id", r6(F.col("als_score")).alias("als_score"))
    prof = PR.profiles(seeds.withColumnRenamed("playlist_int_id", "request_id"), meta, mode="distinct", keep_empty=True)
    feats = _mean_cols(PR.candidate_features(pool, tmap, meta, prof, keep_unprofiled=True), DIFF_FEATURES)
    scored = feats.withColumn(
        "rank_score", F.lit(0.0) - F.round(F.coalesce(F.col("acousticness_diff"), F.lit(1000.0))))
    held = split.filter("held = 1").select(F.col("playlist_int_id").alias("request_id"), "track_id")
    return _round_cols(EX.rerank_diagnostics(pool, scored, held, K), ["als_std", "score_std"])


def eval_seed_requests(spark, sf_dir):
    """Seed requests of every eligible playlist, keyed by its int id."""
    sp = eval_heldout(spark, sf_dir).filter("held = 0").join(C.playlist_map(spark, sf_dir), "playlist_id")
    return sp.select(F.col("playlist_int_id").alias("request_id"), "track_id")


def by_playlist(spark, sf_dir, requests):
    """Rows of int request ids with their text playlist ids."""
    ids = C.playlist_map(spark, sf_dir).select(F.col("playlist_int_id").alias("request_id"), "playlist_id")
    return requests.join(ids, "request_id")


_EVAL_RECS: dict = {}


def eval_recommend(spark, sf_dir):
    """Both arms' recommendations, the scored candidates and the whole pool for
    every eligible playlist: computed once per application, written to the shared
    checkpoint folder and reused by every report."""
    from ..session import shared_copy
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _EVAL_RECS:
        requests = eval_seed_requests(spark, sf_dir)
        pool = REC.seed_pool(spark, sf_dir, requests, check_params())
        recs, scored = REC.recommend(spark, sf_dir, requests, check_params(), pool=pool)
        _EVAL_RECS[k] = (shared_copy(recs, "recommendations"), scored, pool)
    return _EVAL_RECS[k]


@query("ranker_scores")
def ranker_scores(spark, sf_dir):
    """M-08 -> M-09 -> M-10: train LambdaMART on stage-1 candidates of the
    training playlists and score every eligible playlist's candidate pool."""
    _, scored, _ = eval_recommend(spark, sf_dir)
    return scored.select("request_id", "track_int_id", "track_id", "als_score", "rank_score")


@query("recommend_batch")
def recommend_batch(spark, sf_dir):
    """M-11, M-12: top-20 of the full engine and of stage 1 alone (same pool)
    for every eligible playlist's seed tracks."""
    recs, _, _ = eval_recommend(spark, sf_dir)
    return recs


@query("recommend_named")
def recommend_named(spark, sf_dir):
    """S-13, J-08, L-06: the engine's top-20 with artist and track names."""
    recs, _, _ = eval_recommend(spark, sf_dir)
    return REC.present(recs.filter("arm = 'engine'"), C.track_metadata(spark, sf_dir))


# --------------------------------------------------------------------------
# Phase 7-8: evaluation and experiment.  SQL-checked queries use two
# deterministic arms: 'popularity' (counts over all interactions, as the
# reference) and 'popularity_seed' (counts over seed rows only, i.e. without
# the held-out rows -- the leakage-free variant, cf. K16).
# --------------------------------------------------------------------------

from ..operators import experiment as EX  # noqa: E402
from ..operators import stats as ST  # noqa: E402
from ..operators import resampling as RS  # noqa: E402

ARM_A, ARM_B = "popularity_seed", "popularity"
PILOT_N = 200


def seed_popularity(inter, held, k):
    """Top-k by interaction count without the held-out rows."""
    c = P.track_counts(inter).join(held.groupBy("track_id").agg(F.count(F.lit(1)).alias("_h")), "track_id", "left")
    c = c.select("track_id", (F.col("n_interactions") - F.coalesce("_h", F.lit(0))).alias("n_interactions"))
    c = c.filter("n_interactions > 0")
    from pyspark.sql import Window
    top = c.orderBy(F.desc("n_interactions"), F.asc("track_id")).limit(k)
    w = Window.orderBy(F.desc("n_interactions"), F.asc("track_id"))   # over k rows
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "track_id", "n_interactions")


def two_arm_metrics(spark, sf_dir, longtail: bool = False):
    return C.shared_table(spark, ("two_arm_metrics", sf_dir, longtail),
                          lambda: _two_arm_metrics(spark, sf_dir, longtail))


def _two_arm_metrics(spark, sf_dir, longtail: bool = False):
    inter = C.interactions(spark, sf_dir)
    held = eval_heldout(spark, sf_dir).filter("held = 1").select("playlist_id", "track_id")
    tops = {ARM_B: P.popularity_topk(inter, K), ARM_A: seed_popularity(inter, held, K)}
    scored_held = M.longtail_heldout(held, P.popular_head(inter, N_POPULAR)) if longtail else held
    per = [M.metrics_at_k(scored_held, top, K, shared=True).withColumn("arm", F.lit(name))
           for name, top in tops.items()]
    return per[0].unionByName(per[1])


_TWO_ARM_CTES = (*_SPLIT_ELIGIBLE,
                 "held AS (SELECT playlist_id, track_id FROM split WHERE pos <= n_hold)",
                 Q.popularity(K), f"""
hcounts AS (SELECT track_id, COUNT(*) AS h FROM held GROUP BY track_id),
seedc AS (
  SELECT c.track_id, c.n_interactions - COALESCE(h.h, 0) AS n_interactions
  FROM top_counts c LEFT JOIN hcounts h USING (track_id) WHERE c.n_interactions - COALESCE(h.h, 0) > 0
),
top2 AS (
  SELECT * FROM (
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY n_interactions DESC, track_id ASC) AS BIGINT) AS rank,
           track_id, n_interactions FROM seedc) WHERE rank <= {K}
)""")


def _two_arm_sql(held_name: str = "held") -> tuple:
    return (Q.metrics(held_name, "top", K, True, "pa"), Q.metrics(held_name, "top2", K, True, "pb"), f"""
per_all AS (
  SELECT '{ARM_B}' AS arm, * FROM pa UNION ALL SELECT '{ARM_A}' AS arm, * FROM pb
)""")


_METRIC_COLS_SQL = """playlist_id, arm, n_held, n_held_distinct, n_hits, ROUND(recall, 6) AS recall,
       ROUND(ndcg, 6) AS ndcg, hit"""


def _metric_cols(df):
    return df.select("playlist_id", "arm", "n_held", "n_held_distinct", "n_hits",
                     r6(F.col("recall")).alias("recall"), r6(F.col("ndcg")).alias("ndcg"), "hit")


@query("metrics_by_playlist", Q.with_(*_TWO_ARM_CTES, *_two_arm_sql()) + f"SELECT {_METRIC_COLS_SQL} FROM per_all")
def metrics_by_playlist(spark, sf_dir):
    """E-01..E-04, J-11, W-02, F-03, F-04, U-03: recall / NDCG / hit at 20 for
    every eligible playlist under two arms; zero-hit playlists kept."""
    return _metric_cols(two_arm_metrics(spark, sf_dir))


_LT_CTES = (*_TWO_ARM_CTES, Q.popularity(N_POPULAR, "head"), """
held_lt AS (SELECT * FROM held WHERE track_id NOT IN (SELECT track_id FROM head))""")


@query("metrics_longtail", Q.with_(*_LT_CTES, *_two_arm_sql("held_lt")) + f"SELECT {_METRIC_COLS_SQL} FROM per_all")
def metrics_longtail(spark, sf_dir):
    """E-05, P-16, U-04: the same metrics on held-out tracks outside the top-50
    popular head; only playlists with a long-tail held-out track are scored."""
    return _metric_cols(two_arm_metrics(spark, sf_dir, longtail=True))


@query("heldout_composition", Q.with_(*_SPLIT_ELIGIBLE, "held AS (SELECT playlist_id, track_id FROM split WHERE pos <= n_hold)",
                                      Q.popularity(N_POPULAR, "head")) + """,
flag AS (
  SELECT h.playlist_id, CASE WHEN h.track_id IN (SELECT track_id FROM head) THEN 1 ELSE 0 END AS pop FROM held h
),
pk AS (SELECT playlist_id, SUM(pop) AS p, SUM(1 - pop) AS lt FROM flag GROUP BY playlist_id)
SELECT CAST(SUM(p) AS BIGINT) AS n_popular_heldout, CAST(SUM(lt) AS BIGINT) AS n_longtail_heldout,
       CAST(COUNT(*) FILTER (WHERE lt > 0) AS BIGINT) AS n_playlists_with_longtail,
       CAST(COUNT(*) AS BIGINT) AS n_playlists,
       ROUND(100.0 * SUM(lt) / (SUM(p) + SUM(lt)), 6) AS pct_longtail
FROM pk""")
def heldout_composition(spark, sf_dir):
    """A-16: popular vs long-tail held-out counts."""
    inter = C.interactions(spark, sf_dir)
    held = eval_heldout(spark, sf_dir).filter("held = 1")
    out = M.heldout_composition(held, P.popular_head(inter, N_POPULAR))
    return out.withColumn("pct_longtail", r6(F.col("pct_longtail")))


@query("eval_summary", Q.with_(*_TWO_ARM_CTES, *_two_arm_sql()) + """
SELECT arm, CAST(COUNT(*) AS BIGINT) AS n_playlists, ROUND(AVG(recall), 6) AS recall_at_k,
       ROUND(AVG(ndcg), 6) AS ndcg_at_k, ROUND(AVG(hit), 6) AS hit_rate
FROM per_all GROUP BY arm""")
def eval_summary(spark, sf_dir):
    """E-06, A-15: mean of each metric by arm."""
    s = M.summarize_arms(two_arm_metrics(spark, sf_dir))
    return s.select("arm", "n_playlists", *[r6(F.col(c)).alias(c) for c in ("recall_at_k", "ndcg_at_k", "hit_rate")])


_TTEST_COLS = ["n", "mean_a", "mean_b", "lift", "lift_pct", "t_stat", "df"]


def _paired_sql(metric):
    return f"""
SELECT '{metric}' AS metric, '{ARM_A}' AS arm_a, '{ARM_B}' AS arm_b, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(AVG(a), 6) AS mean_a, ROUND(AVG(b), 6) AS mean_b, ROUND(AVG(a) - AVG(b), 6) AS lift,
       ROUND(100.0 * (AVG(a) - AVG(b)) / AVG(b), 6) AS lift_pct,
       AVG(a - b) / (STDDEV_SAMP(a - b) / SQRT(COUNT(*))) AS t,
       CAST(COUNT(*) - 1 AS DOUBLE) AS df
FROM (SELECT playlist_id, MAX(CASE WHEN arm = '{ARM_A}' THEN {metric} END) AS a,
             MAX(CASE WHEN arm = '{ARM_B}' THEN {metric} END) AS b
      FROM per_all GROUP BY playlist_id) WHERE a IS NOT NULL AND b IS NOT NULL"""


_PAIRED_SQL = f"""
SELECT * EXCLUDE (t), ROUND(t, 6) AS t_stat, ROUND({Q.t_p("t", "df")}, 6) AS p_value
FROM ({_paired_sql("ndcg")} UNION ALL {_paired_sql("recall")})"""


def paired_tests(per):
    """The paired tests of both metrics with their p-values."""
    return ST.with_t_p(ST.paired_ttest(per, "ndcg", ARM_A, ARM_B).unionByName(ST.paired_ttest(per, "recall", ARM_A, ARM_B)))


@query("paired_ttest", Q.with_(*_TWO_ARM_CTES, *_two_arm_sql()) + _PAIRED_SQL)
def paired_ttest(spark, sf_dir):
    """E-07, F-09: paired t-tests (pairs by playlist) for NDCG and recall.  (The SQL
    integrates the t density by Simpson's rule.)"""
    out = paired_tests(two_arm_metrics(spark, sf_dir))
    return out.select("metric", "arm_a", "arm_b", *[r6(F.col(c)).alias(c) if c not in ("n", "df") else c
                                                    for c in (*_TTEST_COLS, "p_value")])


@query("eval_lift", Q.with_(*_TWO_ARM_CTES, *_two_arm_sql(), f"tt AS ({_PAIRED_SQL})") + """
SELECT metric, arm_a, arm_b, mean_a, mean_b, lift, lift_pct, t_stat,
       CASE WHEN p_value IS NULL THEN 'no variance' WHEN p_value < 0.05 THEN 'significant at 0.05'
            ELSE 'not significant at 0.05' END AS note
FROM tt""")
def eval_lift(spark, sf_dir):
    """E-06: means of both arms with the lift and its significance note."""
    out = paired_tests(two_arm_metrics(spark, sf_dir)).withColumn("note", ST.significance_note(F.col("p_value")))
    return out.select("metric", "arm_a", "arm_b", *[r6(F.col(c)).alias(c) for c in
                                                    ("mean_a", "mean_b", "lift", "lift_pct", "t_stat")], "note")


_PILOT_CTES = (*_TWO_ARM_CTES, *_two_arm_sql(), f"""
pilot AS (SELECT playlist_id FROM eligible ORDER BY md5('{SALT}:' || playlist_id), playlist_id LIMIT {PILOT_N}),
pstats AS (
  SELECT arm, COUNT(*) AS n, AVG(recall) AS mean_recall, STDDEV_SAMP(recall) AS std_recall,
         AVG(ndcg) AS mean_ndcg, STDDEV_SAMP(ndcg) AS std_ndcg, AVG(hit) AS mean_hit, STDDEV_SAMP(hit) AS std_hit
  FROM per_all WHERE playlist_id IN (SELECT playlist_id FROM pilot) GROUP BY arm
)""")
_PSTATS = ["mean_recall", "std_recall", "mean_ndcg", "std_ndcg", "mean_hit", "std_hit"]


def pilot_metrics(spark, sf_dir):
    inter = C.interactions(spark, sf_dir)
    pilot = S.sample_playlists(inter, PILOT_N, MIN_TRACKS, SALT).select("playlist_id")
    return two_arm_metrics(spark, sf_dir).join(pilot, "playlist_id", "left_semi")


@query("pilot_stats", Q.with_(*_PILOT_CTES) + f"""
SELECT arm, CAST(n AS BIGINT) AS n, {", ".join(f"ROUND({c}, 6) AS {c}" for c in _PSTATS)} FROM pstats""")
def pilot_stats(spark, sf_dir):
    """E-17, A-14: pilot of 200 sampled playlists scored under both arms."""
    s = EX.pilot_stats(pilot_metrics(spark, sf_dir))
    return s.select("arm", "n", *[r6(F.col(c)).alias(c) for c in _PSTATS])


def _per_arm_n(spark, sf_dir):
    inter = C.interactions(spark, sf_dir)
    return S.eligible_playlists(inter, MIN_TRACKS).count() // 2


def _power_ctes():
    # standard normal quantiles at 0.975 and 0.8, from tables
    za, zb = 1.959963984540054, 0.8416212335729143
    zz = (za + zb) ** 2
    return Q.with_(*_PILOT_CTES, f"""
pw AS (
  SELECT MAX(CASE WHEN arm = '{ARM_A}' THEN mean_hit END) AS ha, MAX(CASE WHEN arm = '{ARM_B}' THEN mean_hit END) AS hb,
         MAX(CASE WHEN arm = '{ARM_A}' THEN std_recall END) AS ra, MAX(CASE WHEN arm = '{ARM_B}' THEN std_recall END) AS rb,
         MAX(CASE WHEN arm = '{ARM_A}' THEN std_ndcg END) AS na, MAX(CASE WHEN arm = '{ARM_B}' THEN std_ndcg END) AS nb,
         (SELECT COUNT(*) FROM eligible) // 2 AS per_arm_n
  FROM pstats
),
tbl AS (
  SELECT 'binary' AS metric, 0.03 AS target_mde,
         {za + zb!r} * SQRT(2.0 * ((ha + hb) / 2.0) * (1.0 - (ha + hb) / 2.0) / per_arm_n) AS mde_at_n,
         CAST(CEIL({zz!r} * 2.0 * ((ha + hb) / 2.0) * (1.0 - (ha + hb) / 2.0) / {0.03 ** 2!r}) AS BIGINT) AS required_n,
         per_arm_n FROM pw
  UNION ALL
  SELECT 'recall', 0.03, {za + zb!r} * SQRT((ra * ra + rb * rb) / per_arm_n),
         CAST(CEIL({zz!r} * (ra * ra + rb * rb) / {0.03 ** 2!r}) AS BIGINT), per_arm_n FROM pw
  UNION ALL
  SELECT 'ndcg', 0.03, {za + zb!r} * SQRT((na * na + nb * nb) / per_arm_n),
         CAST(CEIL({zz!r} * (na * na + nb * nb) / {0.03 ** 2!r}) AS BIGINT), per_arm_n FROM pw
),
full_tbl AS (
  SELECT * FROM tbl UNION ALL
  SELECT 'overall', NULL, NULL, MAX(required_n), MAX(per_arm_n) FROM tbl
)""")


@query("power_table", _power_ctes() + """
SELECT metric, CAST(target_mde AS DOUBLE) AS target_mde, ROUND(mde_at_n, 6) AS mde_at_n, required_n,
       CAST(per_arm_n AS BIGINT) AS per_arm_n, CAST(CASE WHEN per_arm_n >= required_n THEN 1 ELSE 0 END AS INTEGER) AS ok
FROM full_tbl""")
def power_table(spark, sf_dir):
    """E-13..E-16, E-18, E-19, F-07, F-08: MDE at the planned per-arm n (half
    of the eligible playlists), required per-arm n per metric (target 0.03,
    power 0.8, alpha 0.05) and the binding requirement."""
    pilot = EX.pilot_stats(pilot_metrics(spark, sf_dir))
    t = EX.power_table(pilot, _per_arm_n(spark, sf_dir), arm_a=ARM_A, arm_b=ARM_B)
    return t.select("metric", "target_mde", r6(F.col("mde_at_n")).alias("mde_at_n"), "required_n", "per_arm_n", "ok")


EXP_SALT = "43"   # the full sample is drawn with seed + 1 (K17)

_ASSIGN_CTE = f"""
assign AS (
  SELECT playlist_id, CAST(position AS BIGINT) AS position,
         CASE WHEN (position - 1) % 2 = 0 THEN '{ARM_A}' ELSE '{ARM_B}' END AS arm
  FROM (SELECT playlist_id, ROW_NUMBER() OVER (ORDER BY md5('{EXP_SALT}:' || playlist_id), playlist_id) AS position
        FROM eligible)
)"""


@query("ab_assignment", Q.with_(Q.INTERACTIONS, Q.eligible(MIN_TRACKS), _ASSIGN_CTE) + "SELECT * FROM assign")
def ab_assignment(spark, sf_dir):
    """W-06, E-20: every eligible playlist shuffled by md5(43:playlist) and
    assigned alternately -- one arm per playlist, exactly balanced."""
    elig = S.eligible_playlists(C.interactions(spark, sf_dir), MIN_TRACKS)
    return EX.assign_arms(elig, EXP_SALT, arms=(ARM_A, ARM_B))


def assigned_metrics(spark, sf_dir):
    elig = S.eligible_playlists(C.interactions(spark, sf_dir), MIN_TRACKS)
    return EX.experiment_metrics(two_arm_metrics(spark, sf_dir), EX.assign_arms(elig, EXP_SALT, arms=(ARM_A, ARM_B)))


_EXP_CTES = (*_TWO_ARM_CTES, *_two_arm_sql(), _ASSIGN_CTE, """
exp AS (SELECT p.* FROM per_all p JOIN assign a USING (playlist_id, arm))""")


def _welch_sql(metric):
    return f"""
SELECT '{metric}' AS metric, '{ARM_A}' AS arm_a, '{ARM_B}' AS arm_b, n_a, n_b, ROUND(ma, 6) AS mean_a,
       ROUND(mb, 6) AS mean_b, ROUND(ma - mb, 6) AS lift,
       (ma - mb) / SQRT(va / n_a + vb / n_b) AS t,
       (va / n_a + vb / n_b) * (va / n_a + vb / n_b)
             / ((va / n_a) * (va / n_a) / (n_a - 1) + (vb / n_b) * (vb / n_b) / (n_b - 1)) AS d
FROM (SELECT CAST(COUNT(*) FILTER (WHERE arm = '{ARM_A}') AS BIGINT) AS n_a,
             CAST(COUNT(*) FILTER (WHERE arm = '{ARM_B}') AS BIGINT) AS n_b,
             AVG(CASE WHEN arm = '{ARM_A}' THEN {metric} END) AS ma, AVG(CASE WHEN arm = '{ARM_B}' THEN {metric} END) AS mb,
             VAR_SAMP(CASE WHEN arm = '{ARM_A}' THEN {metric} END) AS va,
             VAR_SAMP(CASE WHEN arm = '{ARM_B}' THEN {metric} END) AS vb FROM exp)"""


@query("welch_ttest", Q.with_(*_EXP_CTES) + f"""
SELECT * EXCLUDE (t, d), ROUND(t, 6) AS t_stat, ROUND(d, 6) AS df, ROUND({Q.t_p("t", "d")}, 6) AS p_value
FROM ({_welch_sql("ndcg")} UNION ALL {_welch_sql("recall")})""")
def welch_ttest(spark, sf_dir):
    """E-10, F-09: Welch tests between the disjoint arms of the experiment."""
    per = assigned_metrics(spark, sf_dir)
    out = ST.with_t_p(ST.welch_ttest(per, "ndcg", ARM_A, ARM_B).unionByName(ST.welch_ttest(per, "recall", ARM_A, ARM_B)))
    return out.select("metric", "arm_a", "arm_b", "n_a", "n_b",
                      *[r6(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "lift", "t_stat", "df", "p_value")])


@query("two_prop_ztest", Q.with_(*_EXP_CTES) + f"""
SELECT 'hit' AS metric, '{ARM_A}' AS arm_a, '{ARM_B}' AS arm_b, n_a, n_b, ROUND(pa, 6) AS p_a, ROUND(pb, 6) AS p_b,
       ROUND(pa - pb, 6) AS lift, ROUND(z, 6) AS z_stat, ROUND({Q.z_p("z")}, 6) AS p_value
FROM (SELECT *, CASE WHEN se = 0 THEN 0.0::DOUBLE ELSE (pa - pb) / se END AS z FROM (SELECT *, SQRT(pool * (1.0 - pool) * (1.0 / n_a + 1.0 / n_b)) AS se FROM (
  SELECT n_a, n_b, sa / n_a AS pa, sb / n_b AS pb, (sa + sb) / (n_a + n_b) AS pool FROM (
    SELECT CAST(COUNT(*) FILTER (WHERE arm = '{ARM_A}') AS BIGINT) AS n_a,
           CAST(COUNT(*) FILTER (WHERE arm = '{ARM_B}') AS BIGINT) AS n_b,
           CAST(SUM(CASE WHEN arm = '{ARM_A}' THEN hit END) AS DOUBLE) AS sa,
           CAST(SUM(CASE WHEN arm = '{ARM_B}' THEN hit END) AS DOUBLE) AS sb FROM exp))))""")
def two_prop_ztest(spark, sf_dir):
    """E-09, F-08: pooled two-proportion z-test for the hit rate."""
    out = ST.with_z_p(ST.two_prop_ztest(assigned_metrics(spark, sf_dir), "hit", ARM_A, ARM_B))
    return out.select("metric", "arm_a", "arm_b", "n_a", "n_b",
                      *[r6(F.col(c)).alias(c) for c in ("p_a", "p_b", "lift", "z_stat", "p_value")])


N_BOOT = 5000


@query("bootstrap_ci", Q.with_(*_EXP_CTES, f"""
draws AS (
  SELECT e.arm, e.ndcg AS v, q.id * {ST.WORDS} + w.r AS rep,
         ('0x' || substr(md5('42:' || e.arm || ':' || e.playlist_id || ':' || CAST(q.id AS VARCHAR)), 4 * w.r + 1, 4))::BIGINT AS u
  FROM exp e, range(0, {-(-N_BOOT // ST.WORDS)}) q(id), range(0, {ST.WORDS}) w(r)
),
weighted AS (SELECT arm, rep, v, {" + ".join(f"CAST(u >= {c} AS INTEGER)" for c in ST.poisson_cuts())} AS w FROM draws WHERE rep < {N_BOOT}),
reps AS (SELECT arm, rep, SUM(w * v) / SUM(w) AS m FROM weighted GROUP BY arm, rep),
diffs AS (
  SELECT a.m - b.m AS d FROM reps a JOIN reps b ON a.rep = b.rep AND a.arm = '{ARM_A}' AND b.arm = '{ARM_B}'
)""") + f"""
SELECT 'ndcg' AS metric, '{ARM_A}' AS arm_a, '{ARM_B}' AS arm_b, {N_BOOT} AS n_boot,
       ROUND(AVG(d), 6) AS boot_mean_diff, ROUND(quantile_cont(d, 0.025), 6) AS ci_low,
       ROUND(quantile_cont(d, 0.975), 6) AS ci_high
FROM diffs""")
def bootstrap_ci(spark, sf_dir):
    """E-11, A-18: 5000-replicate independent-groups bootstrap CI (95 %) of the
    NDCG difference between the experiment arms (Poisson weights from md5,
    eight to a digest, portable)."""
    out = ST.bootstrap_ci(assigned_metrics(spark, sf_dir), "ndcg", ARM_A, ARM_B, N_BOOT, 95.0, seed=42)
    return out.select("metric", "arm_a", "arm_b", "n_boot",
                      *[r6(F.col(c)).alias(c) for c in ("boot_mean_diff", "ci_low", "ci_high")])


@query("bootstrap_sizes", Q.with_(*_EXP_CTES) + " UNION ALL ".join(f"""
SELECT '{m}' AS metric, arm, COUNT(*) AS n_values, {N_BOOT} AS n_boot, COUNT(*) AS least_draws, COUNT(*) AS most_draws,
       CAST(COUNT(*) * {N_BOOT} AS BIGINT) AS all_draws, MIN({m}) = MAX({m}) AS one_value FROM exp GROUP BY arm"""
    for m in ("ndcg", "recall", "hit")))
def bootstrap_sizes(spark, sf_dir):
    """E-11: the sizes of the 5000 exact replicates of each metric and arm (all draws
    are the arm's values), and whether their means never differ, as they do only for
    one value."""
    per = assigned_metrics(spark, sf_dir)
    long = per.select("arm", F.explode(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in ("ndcg", "recall", "hit")))).alias("x")).select("x.metric", "arm", "x.value")
    drawn = RS.replicate_sums(long, N_BOOT, 42).groupBy("metric", "arm").agg(
        F.count(F.lit(1)).cast("int").alias("n_boot"), F.min("draws").alias("least_draws"),
        F.max("draws").alias("most_draws"), F.sum("draws").alias("all_draws"),
        (F.min("total") == F.max("total")).alias("one_value"))
    sizes = long.groupBy("metric", "arm").agg(F.count("value").alias("n_values"))
    return sizes.join(drawn, ["metric", "arm"]).select(
        "metric", "arm", "n_values", "n_boot", "least_draws", "most_draws", "all_draws", "one_value")


# --------------------------------------------------------------------------
# Reports over the real arms (engine, stage-1 only, popularity): rows-only.
# --------------------------------------------------------------------------

def engine_recs(spark, sf_dir):
    """Both model arms' top-20 for every eligible playlist, computed once and
    persisted (the expensive part of every report)."""
    recs, _, _ = eval_recommend(spark, sf_dir)
    return by_playlist(spark, sf_dir, recs).select("playlist_id", "arm", "rank", "track_id")


def engine_arm_metrics(spark, sf_dir, recs, longtail: bool = False):
    """E-04: per-playlist metrics of the three arms over the same splits,
    paired by playlist.  Stage 1 is trained on all interactions (K16)."""
    inter = C.interactions(spark, sf_dir)
    held = eval_heldout(spark, sf_dir).filter("held = 1").select("playlist_id", "track_id")
    if longtail:
        held = M.longtail_heldout(held, P.popular_head(inter, N_POPULAR))
    per = []
    for arm in ("engine", "als_only"):
        per.append(M.metrics_at_k(held, recs.filter(F.col("arm") == arm), K).withColumn("arm", F.lit(arm)))
    per.append(M.metrics_at_k(held, P.popularity_topk(inter, K), K, shared=True).withColumn("arm", F.lit("popularity")))
    return C.shared_copy(per[0].unionByName(per[1]).unionByName(per[2]), "arm-metrics")


@query("eval_report")
def eval_report(spark, sf_dir):
    """E-04, E-05, E-06, E-07, F-09: three-arm offline evaluation -- mean
    recall / NDCG by arm plus paired t-tests (with p-values) of the full engine
    against stage 1 alone and against popularity, on all and on long-tail
    held-out tracks."""
    rows = []
    recs = engine_recs(spark, sf_dir)
    for view, per in (("all", engine_arm_metrics(spark, sf_dir, recs)),
                      ("longtail", engine_arm_metrics(spark, sf_dir, recs, longtail=True))):
        for metric in ("ndcg", "recall"):
            for other in ("als_only", "popularity"):
                rows.append(ST.with_t_p(ST.paired_ttest(per, metric, "engine", other))
                            .withColumn("view", F.lit(view)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("rerank_diagnostics")
def rerank_diagnostics(spark, sf_dir):
    """E-08, A-17, J-12: rank-score spread per playlist, degenerate flag, and
    how many stage-1 hits in the top 20 survive the rerank."""
    _, scored, pool = eval_recommend(spark, sf_dir)
    pool = pool.join(C.track_map(spark, sf_dir), "track_int_id")
    held = eval_heldout(spark, sf_dir).filter("held = 1").join(C.playlist_map(spark, sf_dir), "playlist_id").select(
        F.col("playlist_int_id").alias("request_id"), "track_id")
    return EX.rerank_diagnostics(pool, scored, held, K)


@query("ab_report")
def ab_report(spark, sf_dir):
    """E-12, E-17..E-21: pilot (200 playlists, both arms) -> power analysis ->
    one arm per eligible playlist (engine 'treatment' vs stage-1 'als') ->
    Welch / z tests with p-values, bootstrap CIs, agreement and power flags."""
    inter = C.interactions(spark, sf_dir)
    elig = S.eligible_playlists(inter, MIN_TRACKS).select("playlist_id")
    pilot_ids = S.sample_playlists(inter, PILOT_N, MIN_TRACKS, SALT).select("playlist_id")
    recs = engine_recs(spark, sf_dir)
    held = eval_heldout(spark, sf_dir).filter("held = 1").select("playlist_id", "track_id")
    per = None
    for arm, name in (("engine", "treatment"), ("als_only", "als")):
        one = M.metrics_at_k(held, recs.filter(F.col("arm") == arm), K).withColumn("arm", F.lit(name))
        per = one if per is None else per.unionByName(one)
    per = C.shared_copy(per, "experiment-metrics")
    pilot = EX.pilot_stats(per.join(pilot_ids, "playlist_id", "left_semi"))
    power = EX.power_table(pilot, _per_arm_n(spark, sf_dir), arm_a="treatment", arm_b="als")
    plan = EX.sizing(power, elig.count()).first()   # one row
    assigned = EX.assign_arms(elig, EXP_SALT, ("treatment", "als")).filter(
        F.col("position") <= 2 * (plan["per_arm_n"] or 0))
    return EX.report(EX.experiment_metrics(per, assigned), "treatment", "als",
                     required_per_arm_n=plan["required_n"])


@query("experiment_sizing", _power_ctes() + """,
need AS (SELECT MAX(required_n) AS r, MAX(per_arm_n) AS half, (SELECT COUNT(*) FROM eligible) AS n FROM full_tbl),
plans AS (SELECT *, r AS wanted, 'auto' AS planned FROM need UNION ALL SELECT *, 100, 'override' FROM need)
SELECT CAST(n AS BIGINT) AS n_eligible, CAST(r AS BIGINT) AS required_n, CAST(LEAST(wanted, half) AS BIGINT) AS per_arm_n,
       CAST(2 * LEAST(wanted, half) AS BIGINT) AS total_n, planned,
       CAST(CASE WHEN LEAST(wanted, half) < r THEN 1 ELSE 0 END AS INTEGER) AS underpowered
FROM plans""")
def experiment_sizing(spark, sf_dir):
    """E-17..E-19: planned size of the experiment, from the pilot's power
    analysis (auto) and with an override of 100 playlists per arm."""
    elig = S.eligible_playlists(C.interactions(spark, sf_dir), MIN_TRACKS).count()
    power = EX.power_table(EX.pilot_stats(pilot_metrics(spark, sf_dir)), _per_arm_n(spark, sf_dir), arm_a=ARM_A, arm_b=ARM_B)
    return EX.sizing(power, elig).unionByName(EX.sizing(power, elig, 100))


# CRC-32 byte by byte: eight shifts of the reflected polynomial each.
_CRC32_SQL = """xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1))::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                               lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query("stable_seed", Q.with_(Q.INTERACTIONS, Q.eligible(MIN_TRACKS)) + f"""
SELECT playlist_id, CAST({_CRC32_SQL} AS BIGINT) AS stable_seed
FROM (SELECT playlist_id, '{SALT}:' || playlist_id AS s FROM eligible)""")
def stable_seed(spark, sf_dir):
    """F-01: the per-playlist stable seed
    ``crc32(f"{salt}:{playlist}")`` for every eligible playlist."""
    elig = S.eligible_playlists(C.interactions(spark, sf_dir), MIN_TRACKS).select("playlist_id")
    return S.stable_seed(elig, SALT)


@query("stage1_leakage")
def stage1_leakage(spark, sf_dir):
    """K16 (M-02, M-06, E-07): stage-1-only arm with ALS fitted on all interactions (as the
    reference, held-out tracks leak into the item factors) versus fitted on
    seed rows only; per-arm means and a paired t-test with p-value."""
    held = eval_heldout(spark, sf_dir).filter("held = 1").select("playlist_id", "track_id")
    p = check_params()
    s1 = REC.train_stage1(spark, sf_dir, p)
    seeds = eval_seed_requests(spark, sf_dir).join(s1.tmap, "track_id").select(
        "request_id", F.col("track_int_id").alias("item_id"))
    per = []
    for name, fit_on in (("als_all", "all"), ("als_seed_only", "seed_only")):
        model, _, _ = trained_stage1(spark, sf_dir, fit_on)
        _, items = AL.factors(model)
        pool = REC.retrieve_for_seeds(s1, seeds, p, items=items).filter(F.col("als_rank") <= K)
        recs = by_playlist(spark, sf_dir, pool.join(s1.tmap, "track_int_id")).select(
            "playlist_id", F.col("als_rank").alias("rank"), "track_id")
        per.append(M.metrics_at_k(held, recs, K).withColumn("arm", F.lit(name)))
    both = C.shared_copy(per[0].unionByName(per[1]), "leakage-metrics")
    out = None
    for metric in ("ndcg", "recall"):
        t = ST.with_t_p(ST.paired_ttest(both, metric, "als_all", "als_seed_only"))
        out = t if out is None else out.unionByName(t)
    return out


@query("recommend_known")
def recommend_known(spark, sf_dir):
    """M-03, M-11, P-18 (int targets): the two-stage top-20 for every known
    playlist from its trained factor, its own tracks filtered as seen and its
    row-mode profile (A-03) -- both arms."""
    playlists = C.playlist_map(spark, sf_dir).select("playlist_int_id")
    recs, _ = REC.recommend_known(spark, sf_dir, playlists, check_params())
    return recs
