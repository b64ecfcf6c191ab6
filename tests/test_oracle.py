"""Every query with an SQL oracle equals DuckDB on sf0.001 (rows, columns, values)."""

import pytest

from conftest import SF_SMALL
from strata.plans import catalog as _c

_c.load_all()


@pytest.fixture(scope="module")
def duck():
    from strata.plans.check import duck_connect
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(_c.ORACLES))
def test_matches_oracle(spark, duck, name):
    from strata.plans.check import compare
    r = compare(spark, duck, name, SF_SMALL)
    assert r["status"] == "ok", r


def test_every_query_runs(spark):
    for name in sorted(set(_c.QUERIES) - set(_c.ORACLES)):
        assert _c.QUERIES[name](spark, SF_SMALL).count() >= 0, name
