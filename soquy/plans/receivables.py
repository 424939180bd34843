"""Waivers, other payments and receivables from payers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.text import date_text_strict
from soquy.operators.filters import filter_optional, having_any_positive, split_eq
from soquy.operators.joins import receivable_sums
from soquy.operators.present import order_report
from soquy.operators.sums import Source, resum, sum_by, sum_sources
from soquy.plans import reconcile

_DOCUMENT = ["hfe_docno_1", "hfe_invoiceno", "thungan", "hfe_payment_method"]

# The measures in report order.
EXEMPTION_MEASURES = [
    "revenue_by_receipt_patpaid",
    "revenue_by_receipt_otherpaid",
    "revenue_exemption_by_receipt_patpaid",
    "revenue_by_refund_patpaid",
    "revenue_by_refund_otherpaid",
    "revenue_exemption_by_refund_patpaid",
    "advance_payment",
]
RECEIVABLE_MEASURES = [
    "insurance_hn_receivable",
    "insurance_bqp_receivable",
    "cuctaichinh_bqp_receivable",
]

# Sums shown at the end of a row.
EXEMPTION_TOTALS = {"total": EXEMPTION_MEASURES[0:6]}
RECEIVABLE_TOTALS = {"total": RECEIVABLE_MEASURES}


def detail_exemption(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    """Documents with a waived amount; adjustments count here too."""
    ar = tables.fact("ar", from_date, to_date)
    source = Source(ar, reconcile.RECEIVABLE_KIND, reconcile.RECEIVABLE_AMOUNTS)
    sums = sum_sources([source], _DOCUMENT, reconcile.RECEIVABLE_MEASURES, fine=True)
    waived = having_any_positive(
        sums, ["revenue_exemption_by_receipt_patpaid", "revenue_exemption_by_refund_patpaid"]
    )
    keys = ["hfe_docno_1", "thungan", "hfe_payment_method"]
    return order_report(
        resum(waived, keys, EXEMPTION_MEASURES),
        ["hfe_docno_1", "hfe_payment_method", "thungan"],
        ordered,
    )


def detail_other_paid(
    tables, from_date: str, to_date: str, cashier: str | None = None, ordered: bool = True
) -> DataFrame:
    """Other payments with patient and reason."""
    refund = filter_optional(tables.fact("refund", from_date, to_date), thungan=cashier)
    paid = split_eq(refund, "refund_type", 4).withColumnRenamed("hfe_amount", "other_paid_amount")
    keys = [
        "hfe_docno_1", "hp_name", "hfe_invoiceno", "thungan", "hfe_payment_method", "hfe_desc"
    ]
    return order_report(sum_by(paid, keys, ["other_paid_amount"]), ["thungan"], ordered, keys)


def account_receivables(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    """What payers owe, per document, card and day.

    The day is text, and the order is the order of that text, so by day of the month first;
    ``receivable_date`` is the same day as a date.
    """
    keys = [*_DOCUMENT, "hd_cardno", "hfe_date"]
    sums = receivable_sums(tables.fact("ar", from_date, to_date), keys)
    coarser = [k for k in keys if k != "hfe_invoiceno"]
    rows = resum(sums, coarser, RECEIVABLE_MEASURES)
    rows = rows.withColumns(
        {
            "receivable_date": F.expr("CAST(to_timestamp(hfe_date) AS DATE)"),
            "hfe_date": F.expr(date_text_strict("hfe_date")),
        }
    )
    return order_report(rows, ["hfe_date", "hfe_payment_method", "thungan"], ordered, coarser)
