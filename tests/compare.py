"""Order-free comparison of a Spark result with rows of another engine."""

from __future__ import annotations


def value(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(data, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(value(r[i]) for i in at) for r in data), key=repr)


def same(df, columns, data):
    order = sorted(df.columns)
    assert order == sorted(columns)
    assert rows(df.collect(), df.columns, order) == rows(data, list(columns), order)
