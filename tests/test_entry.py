import os

import duckdb
import pytest

import __spark_entry__ as entry
from pixelweave.plans import registry

DATA = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want)
