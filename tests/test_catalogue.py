"""Every query with a SQL twin gives its rows."""

from pathlib import Path

import duckdb
import pytest

from cutline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want
