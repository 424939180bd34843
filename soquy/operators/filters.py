"""Row filters. A filter value of None or the empty text is one that was not given."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_optional(df: DataFrame, **equals) -> DataFrame:
    """Conjunction of the equalities whose value was given."""
    given = {c: v for c, v in equals.items() if v is not None and v != ""}
    if not given:
        return df
    return df.where(reduce(and_, [F.col(c) == F.lit(v) for c, v in given.items()]))


def filter_dept(df: DataFrame, order: str | None = None, perform: str | None = None) -> DataFrame:
    """Ordering and performing department, each optional."""
    return filter_optional(df, sd_makhoa_taichinh_order=order, sd_makhoa_taichinh=perform)


def split_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals the value; null is not equal."""
    return df.where(F.col(column) == F.lit(value))


def having_any_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" OR ".join(f"{c} > 0" for c in columns))


def search_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which every word of ``text`` occurs in some column, in any letter case."""
    row = F.expr(f"lower(concat_ws(' ', {', '.join(columns or df.columns)}))")
    words = text.lower().split()
    return df.where(reduce(and_, [F.contains(row, F.lit(w)) for w in words])) if words else df
