"""Every registered query of the library against its SQL on the smallest tables."""

import math

import pytest

from tidewater import plans

from .conftest import SF

QUERIES, SQL = plans.registered()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    at = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["t", "imbalance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
