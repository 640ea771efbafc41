import glob
import os

import duckdb
import pytest

from pageloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    r = c.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(x[n] for n in names) for x in df.collect()))) == sorted(map(str, r.fetchall()))
