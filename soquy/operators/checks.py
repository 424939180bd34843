"""Derived amounts and agreement checks on summed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from soquy.functions.nulls import or_zero

# Parts of a receivable: paid by the patient, paid by others, waived. Nulls count as 0 in each
# term, as they do in a sum, so summing the differences equals the difference of the sums.
SPLIT_PAID = {
    "patpaid": f"{or_zero('patpaid')} - {or_zero('freeamount')}",
    "otherpaid": f"{or_zero('revenue')} - {or_zero('patpaid')}",
    "exempt": or_zero("freeamount"),
}
INSURED = f"{or_zero('insurance')} + {or_zero('bqp')}"


def row_total(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Add the sum of the columns within a row; null counts as 0."""
    return row_totals(df, {name: columns})


def row_totals(df: DataFrame, totals: Mapping[str, Sequence[str]]) -> DataFrame:
    sums = [f"{' + '.join(map(or_zero, columns))} AS {name}" for name, columns in totals.items()]
    return df.selectExpr("*", *sums)


def within(a: str, b: str, tolerance: int) -> str:
    return f"abs(({a}) - ({b})) <= {tolerance}"


def reconcile_checks(df: DataFrame, tolerance: int) -> DataFrame:
    """The three agreement checks of a reconciliation and their conjunction."""
    checks = [
        "invoice_receipt_amount = revenue_by_receipt_patpaid",
        "refund_deduction_amount = deduction",
        within(
            "refund_after_payment_amount - invoice_advance_payment_amount",
            "advance_payment - revenue_by_refund_patpaid",
            tolerance,
        ),
    ]
    checks.append(" AND ".join(f"({c})" for c in checks))
    named = [f"{c} AS comparison_criteria_{i}" for i, c in enumerate(checks, 1)]
    return df.selectExpr("*", *named)
