import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.plans import oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in oracle.oracle_sql():
        return
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = db.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()]
    norm = lambda t: tuple(round(v, 6) if isinstance(v, float) else str(v) for v in t)
    assert sorted(map(norm, rows), key=str) == sorted(map(norm, want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_fold_has_sql():
    assert set(registry.queries()) - set(oracle.oracle_sql()) == {"near_dup_fold"}
