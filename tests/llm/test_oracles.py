import duckdb
import pytest

from tunefunnel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    order = sorted(columns)
    rows = [tuple(r[columns.index(c)] for c in order) for r in want.fetchall()]
    out = queries.QUERIES[name](spark, SF)
    assert sorted(out.columns) == order
    got = [tuple(r) for r in out.select(*order).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
