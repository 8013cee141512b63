"""Every catalogue query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import pytest
from differential import duck, same

import __spark_entry__ as entry
from lectern.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE:
        same(df, duck(sf_dir), catalogue.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
