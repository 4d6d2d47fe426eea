"""Every registered query against its DuckDB oracle on sf0.001 (the driver runs
the same comparison on sf0.01)."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

from conftest import SF_SMALL
from tessera.plans.catalog import QUERIES
from tessera.plans.oracle import ORACLE


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) >= 62
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(key, spark, duck):
    sdf = QUERIES[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.sql(ORACLE[key])
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(res.columns)
    assert len(s_rows) == len(d_rows)
    assert rows_of(sdf.columns, s_rows) == rows_of(res.columns, d_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "rays_hit", "min_n", "max_n", "avg_dist"]
