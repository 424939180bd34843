"""Stock movements, row by row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.text import date_text, to_int_or_null


def _movements(
    tables,
    from_date: str,
    to_date: str,
    fact: str,
    storage_ids: Iterable[int] | None,
    dates: list[str],
    numbers: list[str],
) -> DataFrame:
    rows = tables.fact(fact, from_date, to_date, storage_ids=storage_ids)
    texts = {c: F.expr(date_text(c)) for c in dates}
    return rows.withColumns({**texts, **{c: F.expr(to_int_or_null(c)) for c in numbers}})


def inventory_import(
    tables, from_date: str, to_date: str, storage_ids: Iterable[int] | None = None
) -> DataFrame:
    dates = ["transaction_date", "invoicedate", "signeddate", "expdate"]
    return _movements(tables, from_date, to_date, "inv_import", storage_ids, dates, [])


def inventory_export(
    tables, from_date: str, to_date: str, storage_ids: Iterable[int] | None = None
) -> DataFrame:
    dates = ["transaction_date", "receiptdate", "expdate"]
    return _movements(
        tables, from_date, to_date, "inv_export", storage_ids, dates, ["docno", "invoiceno"]
    )


def inventory_export_requisition(
    tables, from_date: str, to_date: str, storage_ids: Iterable[int] | None = None
) -> DataFrame:
    """Requisition slips; they carry no expiry date."""
    dates = ["transaction_date", "receiptdate"]
    return _movements(
        tables, from_date, to_date, "inv_export_pdt", storage_ids, dates, ["docno", "invoiceno"]
    )
