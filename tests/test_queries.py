"""Every query of the core against its SQL on the smallest data folder, and the plans of searches."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pageloom.plans import registry, retrieval

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        return
    r = duck.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_reads_what_it_needs(spark, monkeypatch):
    from pageloom.sources import tables

    monkeypatch.setattr(tables, "spread", lambda df: df)  # as on input of more row groups than cores
    plan = retrieval.bm25_corpus_stats(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert any("text:string" in x for x in read) and not any("source_id" in x.split("ReadSchema")[1] for x in read)
    assert "Cartesian" not in plan


@pytest.mark.parametrize("name", ["page_quality", "page_normalize", "number_facts", "legacy_units"])
def test_texts_stay_where_they_are_read(spark, monkeypatch, name):
    from pageloom.sources import tables

    monkeypatch.setattr(tables, "spread", lambda df: df)  # as on input of more row groups than cores
    df = registry.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # what is grouped or shuffled holds no text: copies are found by ids, and left out by a broadcast join
    assert not [x for x in plan.split("\n") if "Aggregate" in x and "first(text" in x] and "LeftAnti" in plan
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in physical.split("\n") if "SortMergeJoin" in x and "_file" in x]
