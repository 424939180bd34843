"""Cost inside packages by performing department."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.labels import decode_classes
from soquy.functions.nulls import fill_text
from soquy.operators.filters import filter_dept
from soquy.operators.present import order_report
from soquy.operators.shape import CLASS_KEYS, UNKNOWN_DEPARTMENT
from soquy.operators.sums import (
    ANY_CATEGORY_OR_RETAIL_KIND,
    Measure,
    Source,
    category_measures,
    retail_measure,
    sum_sources,
)
from soquy.plans.revenue import PERFORM_DEPT


def package_cost_by_dept(
    tables, from_date: str, to_date: str, dept: str | None = None, ordered: bool = True
) -> DataFrame:
    """Cost of non-retail lines per category, retail revenue and all revenue. Every line makes a
    group, whatever its code, flag or null class."""
    columns = [*CLASS_KEYS, "hft_id2", "drug_retail", "revenue", "cost_in_package", PERFORM_DEPT]
    rows = tables.fact("revenue", from_date, to_date, columns=columns)
    rows = rows.withColumn(PERFORM_DEPT, F.expr(fill_text(PERFORM_DEPT, UNKNOWN_DEPARTMENT)))
    amounts = {"revenue": "revenue", "cost_in_package": "cost_in_package"}
    source = Source(filter_dept(rows, perform=dept), ANY_CATEGORY_OR_RETAIL_KIND, amounts)
    measures = [
        *category_measures("cost_in_package"),
        retail_measure("revenue"),
        Measure("revenue", "revenue"),
    ]
    keys = [*CLASS_KEYS, PERFORM_DEPT]
    sums = sum_sources([source], keys, measures, keep_null_keys=True)
    return decode_classes(order_report(sums, keys, ordered))
