"""Every registered query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from palimpsest.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_as_duckdb(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    theirs_columns = [d[0] for d in cur.description]
    assert sorted(theirs_columns) == columns
    at = [theirs_columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", [k for k in catalog.queries() if k not in catalog.oracle_sql()])
def test_same_however_partitioned(spark, sf, name):
    """Queries without SQL: rows come, and the same ones in other partitions and batches."""
    rows = lambda: sorted(tuple(plain(x) for x in r) for r in catalog.queries()[name](spark, sf).collect())
    before = rows()
    try:
        for k, v in OTHER.items():
            spark.conf.set(k, v)
        assert before and rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(OTHER)[1:]:
            spark.conf.unset(k)


OTHER = {"spark.sql.shuffle.partitions": "7", "spark.sql.execution.arrow.maxRecordsPerBatch": "13", "spark.sql.autoBroadcastJoinThreshold": "-1"}
