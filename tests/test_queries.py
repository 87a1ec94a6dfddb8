"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

_spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "compare.py"))
_compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_compare)

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert ": ok" in _compare.compare(spark, SF, name, entry.queries()[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["contract", "slot_start", "px", "vol", "readings", "covered"]
    assert set(SQL) <= set(entry.queries())
