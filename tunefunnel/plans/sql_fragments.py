"""ANSI SQL fragments (DuckDB dialect) that rebuild the fixture views from the
driver's tables; the oracle queries in ``registry`` are built from them.

They mirror ``sources.tables`` and the split of ``operators.split`` exactly.
"""

from __future__ import annotations

INTERACTIONS = """
interactions AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS playlist_id, CAST(l.l_partkey AS VARCHAR) AS track_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

_PART_FEATURES = """
  FROM part p LEFT JOIN (
    SELECT l_partkey,
           SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) / COUNT(l_discount) / 100.0 AS a_disc,
           SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) / COUNT(l_tax) / 100.0 AS a_tax,
           SUM(CAST(ROUND(l_quantity * 1) AS BIGINT)) / COUNT(l_quantity) / 1.0 AS a_qty,
           SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / COUNT(l_extendedprice) / 100.0 AS a_price
    FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey"""

_FEATURE_COLS = """
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(a.a_disc AS DOUBLE) END AS danceability,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(p.p_retailprice AS DOUBLE) END AS tempo,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(a.a_tax AS DOUBLE) END AS energy,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(p.p_size AS DOUBLE) END AS acousticness,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(-a.a_qty AS DOUBLE) END AS loudness,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(a.a_price AS DOUBLE) END AS valence"""

TRACK_METADATA = f"""
track_metadata AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS track_id, p.p_brand AS artist_name, p.p_name AS track_name,
{_FEATURE_COLS}
{_PART_FEATURES}
  WHERE p.p_partkey % 23 <> 0
)"""

FEATURE_ARCHIVE = f"""
feature_archive AS (
  SELECT 'spotify:track:' || CAST(p.p_partkey AS VARCHAR) AS track_uri,
         p.p_brand AS artist_name, p.p_name AS track_name,
{_FEATURE_COLS}
{_PART_FEATURES}
)"""


def split(source: str = "interactions", frac: float = 0.2, salt: str = "42",
          name: str = "split") -> str:
    """W-05 in SQL: occurrence number, md5 order key, first n_hold held out."""
    return f"""
{name}_occ AS (
  SELECT playlist_id, track_id,
         ROW_NUMBER() OVER (PARTITION BY playlist_id, track_id ORDER BY track_id) AS occ
  FROM {source}
),
{name}_keyed AS (
  SELECT playlist_id, track_id, occ,
         md5('{salt}:' || playlist_id || ':' || track_id || ':' || CAST(occ AS VARCHAR)) AS k,
         COUNT(*) OVER (PARTITION BY playlist_id) AS n
  FROM {name}_occ
),
{name} AS (
  SELECT playlist_id, track_id, CAST(occ AS BIGINT) AS occ, CAST(n AS BIGINT) AS n,
         CAST(GREATEST(1, FLOOR(n * {float(frac)!r}::DOUBLE)) AS BIGINT) AS n_hold,
         CAST(ROW_NUMBER() OVER (PARTITION BY playlist_id ORDER BY k) AS BIGINT) AS pos
  FROM {name}_keyed
)"""


def eligible(min_tracks: int = 10) -> str:
    return f"""
eligible AS (
  SELECT playlist_id FROM interactions GROUP BY playlist_id HAVING COUNT(*) >= {int(min_tracks)}
),
eligible_interactions AS (
  SELECT i.playlist_id, i.track_id FROM interactions i
  WHERE i.playlist_id IN (SELECT playlist_id FROM eligible)
)"""


def popularity(k: int, name: str = "top", source: str = "interactions") -> str:
    return f"""
{name}_counts AS (
  SELECT track_id, COUNT(*) AS n_interactions FROM {source} GROUP BY track_id
),
{name} AS (
  SELECT * FROM (
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY n_interactions DESC, track_id ASC) AS BIGINT) AS rank,
           track_id, CAST(n_interactions AS BIGINT) AS n_interactions
    FROM {name}_counts) WHERE rank <= {int(k)}
)"""


def metrics(held: str, recs: str, k: int, shared: bool, name: str = "per") -> str:
    """Per-playlist recall / NDCG / hit in SQL (same definitions as operators.metrics)."""
    join = "USING (track_id)" if shared else "USING (playlist_id, track_id)"
    return f"""
{name}_hd AS (SELECT DISTINCT playlist_id, track_id FROM {held}),
{name}_pk AS (SELECT playlist_id, COUNT(*) AS n_held FROM {held} GROUP BY playlist_id),
{name}_pkd AS (SELECT playlist_id, COUNT(*) AS n_held_distinct FROM {name}_hd GROUP BY playlist_id),
{name}_hits AS (
  SELECT h.playlist_id, COUNT(*) AS n_hits, SUM(1.0 / LOG2(r.rank + 1.0)) AS dcg
  FROM {name}_hd h JOIN (SELECT * FROM {recs} WHERE rank <= {int(k)}) r {join}
  GROUP BY h.playlist_id
),
{name} AS (
  SELECT pk.playlist_id, CAST(pk.n_held AS BIGINT) AS n_held,
         CAST(pkd.n_held_distinct AS BIGINT) AS n_held_distinct,
         CAST(COALESCE(x.n_hits, 0) AS BIGINT) AS n_hits,
         CASE WHEN pk.n_held > 0 THEN COALESCE(x.n_hits, 0) / pk.n_held ELSE 0.0 END AS recall,
         CASE WHEN pkd.n_held_distinct > 0
              THEN COALESCE(x.dcg, 0.0) / list_sum(list_transform(
                     range(1, LEAST(pkd.n_held_distinct, {int(k)}) + 1), lambda i: 1.0 / LOG2(i + 1.0)))
              ELSE 0.0 END AS ndcg,
         CAST(CASE WHEN COALESCE(x.n_hits, 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS hit
  FROM {name}_pk pk JOIN {name}_pkd pkd USING (playlist_id)
  LEFT JOIN {name}_hits x USING (playlist_id)
)"""


def _simpson(end: str, density: str, steps: int = 4000) -> str:
    """1 - 2 * the integral of ``density`` (of ``x``) from 0 to ``end``."""
    x = f"(i * ({end}) / {steps}.0::DOUBLE)"
    return f"""GREATEST(0.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * ({end}) / {3 * steps}.0::DOUBLE * list_sum(list_transform(range(0, {steps + 1}),
      lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END)
                * ({density.replace("{x}", x)}))))"""


def t_p(t: str, df: str) -> str:
    """F-09 in SQL: the two-sided Student-t p-value by Simpson's rule over its density."""
    scale = f"EXP(LGAMMA((({df}) + 1) / 2.0) - LGAMMA(({df}) / 2.0)) / SQRT(({df}) * PI())"
    return _simpson(f"ABS({t})", f"{scale} * POW(1.0::DOUBLE + {{x}} * {{x}} / ({df}), -(({df}) + 1) / 2.0)")


def z_p(z: str) -> str:
    """F-08 in SQL: the two-sided normal p-value, likewise."""
    return _simpson(f"ABS({z})", "EXP(-{x} * {x} / 2.0) / SQRT(2.0 * PI())")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"
