"""Every registered query against its DuckDB twin on the smallest tables (the driver runs sf0.01)."""

import pytest

from emberwatch.plans import catalog
from emberwatch.plans.verify import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.load_all())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(name, spark, SF, con)
    assert ok, f"{name}: {msg}"
