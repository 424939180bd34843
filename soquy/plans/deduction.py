"""Deductions from revenue by service category."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soquy.operators.filters import filter_dept
from soquy.plans.revenue import ORDER_DEPT, PERFORM_DEPT, item_sums, pivot_by


def summary_deduction(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    return pivot_by(tables, from_date, to_date, "deduction", [], ordered=ordered)


def deduction_by_order_dept(
    tables, from_date: str, to_date: str, dept: str | None = None, ordered: bool = True
) -> DataFrame:
    return pivot_by(tables, from_date, to_date, "deduction", [ORDER_DEPT], dept, ordered)


def deduction_by_order_and_perform_dept(
    tables, from_date: str, to_date: str, dept: str | None = None, ordered: bool = True
) -> DataFrame:
    """``dept`` is the ordering department."""
    return pivot_by(
        tables, from_date, to_date, "deduction", [ORDER_DEPT, PERFORM_DEPT], dept, ordered
    )


def detail_deduction(
    tables,
    from_date: str,
    to_date: str,
    order: str | None = None,
    perform: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Items of all categories, with their departments."""
    rows = filter_dept(tables.fact("detail_deduction", from_date, to_date), order, perform)
    return item_sums(rows, [ORDER_DEPT, PERFORM_DEPT], ordered)
