"""Each query of the catalogue against DuckDB on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from meshwright.catalogue import QUERIES, SQL

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    got = duck.sql(SQL[name])
    assert sorted(got.columns) == columns
    at = [got.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert rows == want


def test_components_of_all_customers(spark):
    d = "/root/testdata/sf0.01"
    root = {3_000_000_000 + r[0]: 3_000_000_000 + r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    orders = [3_000_000_000 + r[0] for r in spark.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey").select("o_custkey").collect()]
    for a, b in zip(orders, orders[1:]):
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert len(root) > 300
    assert {r["id"]: r["component"] for r in QUERIES["components"](spark, d).collect()} == {i: find(i) for i in root}
