"""Every registered query runs on the smallest data set; entry() works."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = sorted(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "share_pct" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0
