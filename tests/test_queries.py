"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from acopio.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["nth", "source_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_is_a_top_k(spark):
    """The page never sorts or joins all rows."""
    plan = registry.QUERIES["browse_page_date_desc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan
