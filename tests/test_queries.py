"""Every core query against its SQL on the smallest tables; the columns must be the same."""

import glob
import math
import os

import duckdb
import pytest

from fabula.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-9 else "0"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({all_sql()[name]})")
    assert got == sorted((tuple(map(norm, r)) for r in rel.fetchall()), key=repr)


def test_entry_imports_without_llm():
    import __spark_entry__

    assert set(all_sql()) <= set(all_queries()) <= set(__spark_entry__.queries())
