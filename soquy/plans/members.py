"""Dimension members seen by the reports, to be stored by an explicit job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soquy.operators.dims import upsert_members, upsert_storage
from soquy.operators.shape import CLASS_KEYS
from soquy.operators.sums import CATEGORY_KIND, distinct_members, drop_null_keys, pairs_by_id
from soquy.plans.reconcile import ledger_keys
from soquy.plans.revenue import ORDER_DEPT, PERFORM_DEPT
from soquy.sources.schemas import PERIOD_COLUMN, PLACE_COLUMN

_DOCUMENT = ["hfe_docno_1", "hfe_invoiceno", "thungan", "hfe_payment_method"]


def upsert_cashiers(tables, from_date: str, to_date: str, dim: DataFrame) -> DataFrame:
    """Cashiers of the detail reconciliation added to ``dim(name)``."""
    seen = distinct_members(ledger_keys(tables, from_date, to_date, _DOCUMENT), "thungan")
    return upsert_members(dim, seen.withColumnRenamed("thungan", "name"))


def upsert_methods(tables, from_date: str, to_date: str, dim: DataFrame) -> DataFrame:
    """Payment methods of the detail reconciliation added to ``dim(method)``."""
    keys = ledger_keys(tables, from_date, to_date, _DOCUMENT)
    seen = distinct_members(keys, "hfe_payment_method")
    return upsert_members(dim, seen.withColumnRenamed("hfe_payment_method", "method"))


def upsert_order_departments(tables, from_date: str, to_date: str, dim: DataFrame) -> DataFrame:
    """Ordering departments of the non-retail revenue report added to ``dim(dept, dept_name)``."""
    columns = [*CLASS_KEYS, "hft_id2", "drug_retail", ORDER_DEPT]
    rows = tables.fact("revenue", from_date, to_date, columns=columns)
    rows = rows.where(f"drug_retail = 'N' AND ({CATEGORY_KIND}) IS NOT NULL")
    seen = distinct_members(drop_null_keys(rows, CLASS_KEYS), ORDER_DEPT)
    return upsert_members(dim, seen.withColumnRenamed(ORDER_DEPT, "dept"))


def upsert_perform_departments(
    tables,
    from_date: str,
    to_date: str,
    dim: DataFrame,
    fact: str = "detail_revenue",
    category: str | None = None,
) -> DataFrame:
    """Performing departments of an item report added to ``dim(dept, dept_name)``."""
    rows = tables.fact(fact, from_date, to_date, category=category, columns=[PERFORM_DEPT])
    seen = distinct_members(rows, PERFORM_DEPT)
    return upsert_members(dim, seen.withColumnRenamed(PERFORM_DEPT, "dept"))


def storage_pairs(tables, from_date: str, to_date: str, storage_ids=None) -> DataFrame:
    """Storages of the import report, each with the name of its last row: the latest day, and there
    the last place in the answer."""
    rows = tables.fact(
        "inv_import", from_date, to_date, storage_ids=storage_ids,
        columns=["stock_import", "stock_name"], placed=True,
    )
    pairs = pairs_by_id(rows, "stock_import", "stock_name", PERIOD_COLUMN, PLACE_COLUMN)
    return pairs.withColumnsRenamed({"stock_import": "storage_id", "stock_name": "storage_name"})


def upsert_storages(
    tables, from_date: str, to_date: str, dim: DataFrame, storage_ids=None
) -> DataFrame:
    return upsert_storage(dim, storage_pairs(tables, from_date, to_date, storage_ids))
