"""Positions by digest: groups of one range and of many."""
import hashlib

import pytest
from pyspark.sql import functions as F

from tunefunnel.operators import ordering as O


@pytest.mark.parametrize("bucket_rows,broadcast", [(1 << 18, 100_000), (100, 100_000), (7, 0)])
def test_positions_in_groups_of_all_sizes(spark, monkeypatch, bucket_rows, broadcast):
    monkeypatch.setattr(O, "BROADCAST_GROUPS", broadcast)
    rows = [("hot", i) for i in range(2000)] + [("mid", i) for i in range(120)] + [("one", 0)] + [
        (f"g{i % 50}", i) for i in range(200)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int").withColumn(
        "k", F.md5(F.concat_ws(":", F.coalesce("g", F.lit("-")), F.col("i").cast("string"))))
    got = {(r.g, r.i): (r.pos, r.n) for r in O.rank_by_hash_key(
        df, ["g"], "k", "pos", "n", bucket_rows).collect()}
    by = {}
    for g, i in rows:
        if g is not None:
            by.setdefault(g, []).append((hashlib.md5(f"{g}:{i}".encode()).hexdigest(), i))
    want = {(g, i): (p, len(m)) for g, m in by.items() for p, (_, i) in enumerate(sorted(m), 1)}
    assert got == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, k string")
    assert O.rank_by_hash_key(none, ["g"], "k", "pos", "n").count() == 0
