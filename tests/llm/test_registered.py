import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_same_rows_as_sql(spark, name):
    assert name in entry.queries()
    df = Q.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) > 0
    if name not in Q.oracle_sql():
        return
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = [tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()]
    assert sorted(names) == sorted(df.columns) and sorted(rows) == sorted(want)
