import duckdb
import pytest

from panelweave.llm import queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    res = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
