import glob
import os

import pytest

import __spark_entry__ as entry
from tablewright.plans import workload

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    return value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(workload.ORACLES[name])
    got = workload.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want_rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[c]) for c in columns]) for r in want_rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
