"""Every query outside of the training operators against its SQL, on the smallest tables."""

import pytest

from ledgerloom.plans import registry

from .compare import assert_same
from .conftest import DATA

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, compiled, duck):
    df = QUERIES[name](compiled, DATA)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        assert len(set(df.columns)) == len(df.columns)
        df.collect()


def test_entry(compiled):
    import __spark_entry__

    rows = __spark_entry__.entry(compiled).collect()
    assert len(rows) == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
