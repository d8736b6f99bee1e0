"""Every query with an oracle gives the oracle's rows."""

import oracle
import pytest

import tesselon.store_queries  # noqa: F401
from tesselon.queries import ORACLES, QUERIES

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, f"{oracle.DATA}/{SF}")) == oracle.oracle_rows(ORACLES[name], SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
