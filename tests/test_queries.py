"""Every registered query against its SQL text over the small tables."""

import pytest
from conftest import SF_DIR
from harness import difference

import __spark_entry__ as driver

from rasterlake.plans.catalogue import ALL  # noqa: E402

CHECKS = ALL.checks


def test_every_query_is_checked():
    assert set(ALL.queries) == set(CHECKS) <= set(driver.oracle_sql())


def test_entry_has_rows(spark):
    df = driver.entry(spark)
    assert df.columns == ["raster_id", "z", "tiles", "pixels", "brightness"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, name):
    problem = difference(driver.queries()[name](spark, SF_DIR), SF_DIR, CHECKS[name])
    assert problem is None, problem
