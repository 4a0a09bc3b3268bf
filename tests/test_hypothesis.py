"""Hypothesis property (K9): Spark's n_hold equals Python's max(1, int(n * frac))
for arbitrary sizes and fractions, evaluated as one DataFrame per example."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunefunnel.operators import split as S


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=100_000), min_size=1, max_size=50),
       st.floats(min_value=0.01, max_value=0.99, allow_nan=False))
def test_n_hold_matches_python(spark, ns, frac):
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r[0] for r in df.select(S.n_hold_expr(F.col("n"), frac)).collect()]
    assert got == [max(1, int(n * frac)) for n in ns]
