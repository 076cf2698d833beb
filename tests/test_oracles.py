"""Every registered core query against its SQL, over the smallest tables."""

import pytest

from paperline.plans import registry

from .conftest import SF


def same_rows(df, duck, sql):
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
