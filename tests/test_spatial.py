import os

import duckdb
import pytest

from pointweave.plans import filters, more, regions, shapes, spatial, tables, timed

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 8) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(spatial.QUERIES | more.QUERIES | shapes.QUERIES | timed.QUERIES | filters.QUERIES | tables.QUERIES | regions.QUERIES))
def test_query_equals_sql(spark, name):
    df = (spatial.QUERIES | more.QUERIES | shapes.QUERIES | timed.QUERIES | filters.QUERIES | tables.QUERIES | regions.QUERIES)[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    if name not in spatial.SQL | more.SQL | shapes.SQL | timed.SQL | filters.SQL | tables.SQL | regions.SQL:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({(spatial.SQL | more.SQL | shapes.SQL | timed.SQL | filters.SQL | tables.SQL | regions.SQL)[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)
