import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import rows as fixtures  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return fixtures.frame(spark, fixtures.awkward()).repartition(3).persist()


@pytest.fixture(scope="session")
def with_odd_ids(spark):
    """The same with a null id and rows that repeat."""
    some = fixtures.awkward()
    return fixtures.frame(spark, [*some, *some[20:24], some[30], (None, *some[25][1:]), (None, None, *some[25][2:])])


@pytest.fixture(scope="session")
def empty(spark):
    return fixtures.frame(spark, [])
