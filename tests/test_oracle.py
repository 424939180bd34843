"""Each registered query against its SQL, over the whole tables."""

import pytest
from compare import assert_same
from conftest import DATA

from soquy.registry import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, star, name):
    query = QUERIES[name]
    assert query.oracle is not None
    rows = assert_same(query.run(spark, DATA), star.sql(query.oracle))
    assert rows > 0
