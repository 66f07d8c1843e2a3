"""Every ledger query against its DuckDB SQL, and the entry points."""

import pytest

from ledgerloom.plans import registry
from tests.conftest import SMALL


def rows(columns, records):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(clean(r[c])) for c in sorted(columns)) for r in records)


@pytest.fixture(scope="module")
def con(duck):
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SMALL)
    told = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(told.columns)
    want = [dict(zip(told.columns, r, strict=True)) for r in told.fetchall()]
    assert rows(df.columns, df.collect()) == rows(df.columns, want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
