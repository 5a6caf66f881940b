"""Registered queries against their DuckDB twins on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(float(x) if isinstance(x := plain(v), int) and not isinstance(x, bool) else x for v in r) for r in frame.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name not in entry.oracle_sql():
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_optional_part_is_not_needed():
    try:
        importlib.import_module("corpus_pipeline")
        importlib.import_module("lineweave.llm.queries")
        there = True
    except ImportError:
        there = False
    assert ("pipeline" in entry.queries()) == there
