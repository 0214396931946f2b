"""Every named query with SQL against DuckDB on the smallest tables; results don't depend on the
number of shuffle partitions."""

import math
import os

import duckdb
import pytest

from quaver.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in found.fetchall())
    assert got == want


def test_partition_invariance(spark):
    runs = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, registry.QUERIES["beat_timeline"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]
