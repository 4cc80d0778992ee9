"""The queries that have SQL against DuckDB."""

from collections import Counter

import duckdb
import pytest

pytest.importorskip("meshwright.llm.queries")
from meshwright.llm import queries as q  # noqa: E402


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name, d):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = q.queries()[name](spark, d), duck.sql(q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in got.dtypes if not (name == "op9_chat" and c == "conv_id")}.items() <= dict(zip(want.columns, map(str, want.types))).items()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.select(*columns).fetchall())
