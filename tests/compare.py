"""Whole-table comparison of a DataFrame with a SQL result, regardless of row order."""

import math
from collections import Counter


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 4)
    if isinstance(value, int):
        return value
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def assert_same(df, relation):
    names, got = bag(df.columns, df.collect())
    expected_names, expected = bag(relation.columns, relation.fetchall())
    assert names == expected_names
    missing, extra = expected - got, got - expected
    assert not missing and not extra, (
        f"{sum(got.values())} rows against {sum(expected.values())}; "
        f"missing {list(missing.items())[:3]}; extra {list(extra.items())[:3]}"
    )
    return sum(got.values())
