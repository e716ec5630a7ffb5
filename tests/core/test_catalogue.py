"""Each catalogue query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quireline import catalogue


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def table_views(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def same(df, con, sql):
    got = [r.asDict() for r in df.collect()]
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {n: KINDS.get(k, k) for n, k in df.dtypes} == theirs
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: [str(plain(r[n])) for n in names]
    assert sorted(map(key, got)) == sorted(map(key, want))
    return len(got)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), table_views(sf), catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0
