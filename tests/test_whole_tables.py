"""Queries that once ran over a subset of ids: each takes in its whole tables and equals its text."""

import duckdb
import pytest

from tessella.plans import catalogue

#: Larger than the other tests' tables: there some of the subsets were all rows.
DATA = "/root/testdata/sf0.01"
#: For each query what its result must show, and that of the source.
WHOLE = {
    "w3_systematic_sampling": ("max(event_id) > 5000", "SELECT count(*) > 5000 FROM events"),
    "w4_catmull_rom": ("count(DISTINCT user_id)", "SELECT count(DISTINCT user_id) FROM events"),
    "w7_simplify_ring": ("count(DISTINCT id % 10)", "SELECT count(DISTINCT o_custkey % 10) FROM orders"),
    "w8_ring_area": ("count(*)", "SELECT count(DISTINCT o_custkey) FROM orders"),
    "w9_chain_lengths": ("count(*)", "SELECT count(DISTINCT o_custkey) FROM orders"),
    "s15_as_of": ("count(*)", "SELECT count(*) FROM orders"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_takes_in_the_whole_table(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*cols).collect()), key=repr)
    text = f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})"
    assert rows == sorted(con.sql(text).fetchall(), key=repr)
    measure, want = WHOLE[name]
    assert con.sql(f"SELECT {measure} FROM ({text})").fetchall() == con.sql(want).fetchall()
