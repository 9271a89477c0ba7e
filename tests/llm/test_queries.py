"""Every training query against its SQL, on the smallest tables."""

import pytest

from ledgerloom.llm import queries as training

from ..compare import assert_same
from ..conftest import DATA

QUERIES, SQL = training.queries(), training.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        df.collect()
