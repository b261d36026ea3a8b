"""Every query against its SQL on the smallest test data, where it is there."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(rows, columns):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, DATA)
    expected = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([r.asDict() for r in df.collect()], names) == plain([dict(zip(names, r)) for r in expected.fetchall()], names)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql(spark):
    for name in ("greedy_assignment", "indel_similarity", "map_tables", "map_columns"):
        assert entry.queries()[name](spark, DATA).count() > 0
