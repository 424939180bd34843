"""Corpus queries against their SQL, over the whole tables."""

import pytest
from compare import assert_same
from conftest import DATA

from soquy.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, star, name):
    assert assert_same(QUERIES[name](spark, DATA), star.sql(ORACLES[name])) > 0
