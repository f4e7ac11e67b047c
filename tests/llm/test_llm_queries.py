"""All queries of the subpackage at the smallest scale, against their SQL where there is one."""

import pytest
from test_queries import agree, duck  # noqa: F401

from pagewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, folder, name):  # noqa: F811
    agree(spark, duck, folder, queries.QUERIES[name], queries.ORACLE.get(name))
