"""Each catalog query gives the rows that its SQL gives in DuckDB."""

import duckdb
import pytest

from shutterlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    rows = [_plain(r) for r in want.fetchall()]
    assert sorted(map(_plain, got.select(*cols).collect()), key=str) == sorted(rows, key=str)
    assert rows or name == "flt19_scope_none"


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
