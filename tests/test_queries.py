"""Every query with SQL against DuckDB on the smallest tables, and every query's shape."""

import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = tables.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries()) and "p4_found" in __spark_entry__.queries()


def test_filters_and_columns_reach_the_scan(spark):
    plan = __spark_entry__.queries()["items_filter_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(kind,news)" in plan and "summary" not in plan.split("ReadSchema")[1][:200]


def test_core_stands_without_the_text_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("siftwell.llm")]:
        monkeypatch.delitem(sys.modules, m)
    real = importlib.import_module

    def without(name, *a):
        if name.startswith("siftwell.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="siftwell.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert "p4_found" in __spark_entry__.queries() and "p1_found" not in __spark_entry__.queries() and builtins
