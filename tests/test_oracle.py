"""Every registered query with an oracle equals it; the others run."""

from __future__ import annotations

import pytest
from compare import compare, duck
from quernstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert compare(df, con, registry.ORACLE_SQL[name]) == ""
    else:
        again = registry.QUERIES[name](spark, SF)
        rows = sorted(map(repr, df.collect()))
        assert rows and rows == sorted(map(repr, again.collect()))  # without an oracle: something, and the same each time


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["conversation", "score", "n_hits", "best_key"]
