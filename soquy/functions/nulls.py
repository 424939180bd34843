"""Null-aware predicates and key texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from soquy.operators.shape import NULL_INVOICE


def constant(value) -> str:
    """A fixed value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def ne_keep_null(col: str, value) -> str:
    """``col != value`` that is true for null, where ``<>`` would be null."""
    return f"NOT ({col} <=> {constant(value)})"


def or_zero(col: str) -> str:
    return f"coalesce({col}, 0)"


def invoice_key(col: str) -> str:
    """Invoice as key text. Null invoices stay together as one group instead of being dropped."""
    return f"coalesce(CAST({col} AS STRING), {constant(NULL_INVOICE)})"


def fill_text(col: str, label: str) -> str:
    return f"coalesce({col}, {constant(label)})"


def is_blank(col: str) -> str:
    """Null, empty or only spaces."""
    return f"trim(coalesce({col}, '')) = ''"


def ensure_columns(df: DataFrame, columns: Mapping[str, str], default=None) -> DataFrame:
    """Add the columns that ``df`` lacks, as ``default`` cast to the given type."""
    missing = {c: t for c, t in columns.items() if c not in df.columns}
    if not missing:
        return df
    added = [f"CAST({constant(default)} AS {t}) AS {c}" for c, t in missing.items()]
    return df.selectExpr("*", *added)
