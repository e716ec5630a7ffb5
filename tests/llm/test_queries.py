"""Each corpus query with SQL against that SQL in DuckDB."""

import pytest

from quireline.llm import queries
from tests.core.test_catalogue import same, table_views


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), table_views(sf), queries.ORACLES[name])
