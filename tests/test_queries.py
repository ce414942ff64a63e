"""Every query of the package's own plans, against its SQL or for rows and a stable schema."""

import pytest

from rillet import plans

Q, S = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(S))
def test_against_sql(name, same):
    same(Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_rows(name, spark, sf_dir):
    df = Q[name](spark, sf_dir)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert plans.entry(spark).count() > 0
