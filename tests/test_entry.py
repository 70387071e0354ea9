import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["b0", "b1", "variance"]


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "supplier", "customer", "part", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    names = list(rel.columns)
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)
