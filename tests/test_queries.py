"""Every registered query against its DuckDB text on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessella.plans import catalogue

def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = catalogue.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rows = sorted((plain(tuple(r)) for r in got.select(*[got[c] for c in cols]).collect()), key=repr)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.SQL[name]})").fetchall()
    assert rows == sorted((plain(r) for r in want), key=repr)


def test_every_text_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 100
