"""Every registered query with an oracle matches DuckDB on sf0.001."""
import math

import pytest

import __spark_entry__ as E
from data_dirs import SF001
from tunefunnel.plans.registry import ORACLE


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    got = df.toPandas()
    want = duck.execute(ORACLE[name]).df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["n_playlists"] == 148
