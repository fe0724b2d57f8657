"""Every query that SQL can express equals its SQL."""

from __future__ import annotations

import pytest
from compare import difference

from barloom import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, duck, data, name):
    assert difference(Q.QUERIES[name](spark, data), duck, Q.SQL[name]) == ""
