"""Every registered query against its SQL on DuckDB."""

import pytest

from cloudgauge.plans import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, note
