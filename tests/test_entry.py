import os

import duckdb
import pytest

import __spark_entry__ as contract
from quillmine.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def plain(rows, columns):
    kept = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([kept(r[c]) for c in columns] for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in frame.collect()]
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        found = con.sql(SQL[name])
        want = [dict(zip(found.columns, r)) for r in found.fetchall()]
        assert sorted(frame.columns) == sorted(found.columns)
        assert plain(rows, sorted(frame.columns)) == plain(want, sorted(frame.columns))
