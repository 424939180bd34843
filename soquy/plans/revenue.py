"""Revenue by service category."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soquy.functions.labels import decode_classes
from soquy.operators.checks import within
from soquy.operators.filters import filter_dept, filter_optional
from soquy.operators.present import order_report
from soquy.operators.shape import CATEGORIES, CATEGORY_COLUMNS, CLASS_KEYS
from soquy.operators.sums import (
    ANY_CATEGORY_KIND,
    CATEGORY_OR_RETAIL_KIND,
    Measure,
    Source,
    category_measures,
    resum,
    retail_measure,
    sum_sources,
)

ORDER_DEPT = "sd_makhoa_taichinh_order"
PERFORM_DEPT = "sd_makhoa_taichinh"
ITEM_KEYS = ["hft_name", "hfe_group", "hfe_itemid", "hfe_desc"]
REVENUE_TOLERANCE = 100

# Sums shown at the end of a row.
CATEGORY_TOTALS = {"total": CATEGORIES}
CATEGORY_RETAIL_TOTALS = {"total": [*CATEGORIES, "drug_retail"]}

_PIVOT = [*CLASS_KEYS, "hft_id2", "drug_retail", "revenue"]


_REVENUE = {"revenue": "revenue"}
_RETAIL_MEASURES = [*category_measures("revenue"), retail_measure("revenue")]

# Receivables beside revenue lines: a kind of their own.
_INVOICED = "invoiced"
_INVOICED_REVENUE = Measure("revenue", "revenue", (_INVOICED,))


def _invoiced(ar: DataFrame) -> Source:
    return Source(ar, f"'{_INVOICED}'", _REVENUE)


def pivot_by(
    tables,
    from_date: str,
    to_date: str,
    fact: str,
    depts: list[str],
    order: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Categories and retail of a fact by class and department columns."""
    rows = tables.fact(fact, from_date, to_date, columns=[*_PIVOT, *depts])
    keys = [*depts, *CLASS_KEYS]
    source = Source(filter_dept(rows, order=order), CATEGORY_OR_RETAIL_KIND, _REVENUE)
    sums = sum_sources([source], keys, _RETAIL_MEASURES)
    return decode_classes(order_report(sums, keys, ordered))


def summary_revenue(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    """By class, beside the revenue of the receivables."""
    rows = tables.fact("revenue", from_date, to_date, columns=_PIVOT)
    ar = tables.fact("ar", from_date, to_date, columns=[*CLASS_KEYS, "revenue"])
    sources = [Source(rows, CATEGORY_OR_RETAIL_KIND, _REVENUE), _invoiced(ar)]
    sums = sum_sources(sources, CLASS_KEYS, [*_RETAIL_MEASURES, _INVOICED_REVENUE])
    return decode_classes(order_report(sums, CLASS_KEYS, ordered))


def revenue_by_order_dept(
    tables, from_date: str, to_date: str, dept: str | None = None, ordered: bool = True
) -> DataFrame:
    return pivot_by(tables, from_date, to_date, "revenue", [ORDER_DEPT], dept, ordered)


def revenue_by_order_and_perform_dept(
    tables, from_date: str, to_date: str, dept: str | None = None, ordered: bool = True
) -> DataFrame:
    """``dept`` is the ordering department."""
    return pivot_by(
        tables, from_date, to_date, "revenue", [ORDER_DEPT, PERFORM_DEPT], dept, ordered
    )


def item_sums(rows: DataFrame, depts: list[str], ordered: bool) -> DataFrame:
    """Quantity and revenue per item, null keys kept."""
    keys = [*CLASS_KEYS, *ITEM_KEYS, *depts, "hfe_unit"]
    sums = resum(rows, keys, ["hfe_quantity", "revenue"])
    return decode_classes(order_report(sums, CLASS_KEYS, ordered, keys))


def detail_revenue(
    tables,
    from_date: str,
    to_date: str,
    category: str,
    order: str | None = None,
    perform: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Items of one category. Departments are filtered on the rows and not part of the key, which
    gives the sums of the filtered department lines."""
    rows = tables.fact("detail_revenue", from_date, to_date, category=category)
    return item_sums(filter_dept(rows, order, perform), [], ordered)


def revenue_reconciliation(
    tables, from_date: str, to_date: str, status: bool | None = None, ordered: bool = True
) -> DataFrame:
    """Revenue lines against receivables per document, whatever the category or invoice."""
    columns = ["hfe_docno_1", "hft_id2", "revenue"]
    rows = tables.fact("revenue", from_date, to_date, columns=columns)
    ar = tables.fact("ar", from_date, to_date, columns=["hfe_docno_1", "revenue"])
    by_detail = Measure("revenue_by_detail", "revenue", ("", *CATEGORY_COLUMNS))
    keys = ["hfe_docno_1"]
    sums = sum_sources(
        [Source(rows, ANY_CATEGORY_KIND, _REVENUE), _invoiced(ar)],
        keys,
        [*category_measures("revenue"), by_detail, _INVOICED_REVENUE],
    )
    agrees = within("revenue_by_detail", "revenue", REVENUE_TOLERANCE)
    checked = sums.selectExpr("*", f"{agrees} AS comparison_criteria")
    return order_report(filter_optional(checked, comparison_criteria=status), keys, ordered)
