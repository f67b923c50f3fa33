"""Every query of the engine's own against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from iontide import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v) else round(float(v), 7) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False, name=None)), key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    found = catalog.queries()[name](spark, DATA).toPandas()
    if name not in catalog.oracle_sql():
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    true = db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(true.columns)
    assert rows(found) == rows(true)
