"""Every query of the library itself equals its SQL on the smallest tables."""

import glob
import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from statloom.jobs import registry

SF = "/root/testdata/sf0.001"
#: At this size groups are judged by order statistics, which SQL lacks.
SKIP = {"normality_by_moments"}


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return float(v) + 0.0
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SKIP))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(map(cell, r)) for r in x[columns].itertuples(index=False)), key=str) for x in (got, want)]
    assert rows[0] == rows[1]
