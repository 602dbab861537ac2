"""Every registered core query against its DuckDB counterpart."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from tidegauge.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()) == ""
