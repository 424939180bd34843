"""Retail sales and functional food."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soquy.functions.labels import decode_classes
from soquy.functions.nulls import ensure_columns
from soquy.operators.filters import split_eq
from soquy.operators.joins import cogs_with_pivot
from soquy.operators.present import order_report
from soquy.operators.shape import CATEGORIES, CLASS_KEYS
from soquy.operators.sums import category_pivot

FUNCTIONAL_FOOD = 2002

_COLUMNS = [*CLASS_KEYS, "hft_id2", "drug_retail", "revenue"]


def _retail(
    tables, from_date: str, to_date: str, fact: str, cogs: bool, ordered: bool
) -> DataFrame:
    columns = [*_COLUMNS, *(["cogs_drug_retail"] if cogs else [])]
    rows = split_eq(
        tables.fact(fact, from_date, to_date, columns=columns), "drug_retail", "Y"
    )
    sums = cogs_with_pivot(rows, CLASS_KEYS) if cogs else category_pivot(rows, CLASS_KEYS)
    amounts = [c for c in sums.columns if c not in CLASS_KEYS]
    flagged = sums.selectExpr(*CLASS_KEYS, "'Y' AS drug_retail", *amounts)
    return decode_classes(order_report(flagged, CLASS_KEYS, ordered))


def retail_revenue(
    tables, from_date: str, to_date: str, cogs: bool = True, ordered: bool = True
) -> DataFrame:
    """Retail revenue by class beside its cost; without ``cogs`` the categories alone."""
    return _retail(tables, from_date, to_date, "revenue", cogs, ordered)


def retail_deduction(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    return _retail(tables, from_date, to_date, "deduction", True, ordered)


def functional_food_revenue(
    tables, from_date: str, to_date: str, ordered: bool = True
) -> DataFrame:
    rows = tables.fact("revenue", from_date, to_date, columns=[*_COLUMNS, "hft_id"])
    rows = ensure_columns(rows, {"drug_retail": "string", "hft_id": "int"})
    rows = split_eq(split_eq(rows, "drug_retail", "Y"), "hft_id", FUNCTIONAL_FOOD)
    sums = category_pivot(rows, [*CLASS_KEYS, "drug_retail", "hft_id"])
    chosen = sums.select(*CLASS_KEYS, "drug_retail", "hft_id", *CATEGORIES)
    return decode_classes(order_report(chosen, CLASS_KEYS, ordered))
