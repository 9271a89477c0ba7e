"""Comparison of a query with its SQL."""

from collections import Counter


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(_norm, v)) if isinstance(v, list | tuple) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(_norm(r[i]) for i in at) for r in got.fetchall())


def assert_same(df, con, sql):
    assert rows_of(df) == sql_rows(con, sql)
