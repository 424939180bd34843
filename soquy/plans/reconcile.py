"""Reconciliation of cash against receivables and deductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.nulls import invoice_key, ne_keep_null
from soquy.operators.checks import SPLIT_PAID, reconcile_checks
from soquy.operators.filters import filter_optional
from soquy.operators.joins import attach_coarse
from soquy.operators.present import TOTAL_FLAG, number_texts, order_report, with_grand_total
from soquy.operators.setops import union_padded
from soquy.operators.sums import (
    KIND,
    Measure,
    Source,
    aggregate,
    drop_null_keys,
    kind_rows,
    kinds_as_columns,
    sum_by,
    sum_kinds,
    total,
)

# The measures in report order.
RECEIPTS = ["invoice_receipt_amount", "invoice_advance_payment_amount", "deposit_amount"]
PAYMENTS = [
    "refund_deduction_amount",
    "refund_after_payment_amount",
    "return_amount",
    "other_paid_amount",
    "adjust_paid_amount",
]
REVENUES = [
    "revenue_by_receipt_patpaid",
    "revenue_by_receipt_otherpaid",
    "revenue_exemption_by_receipt_patpaid",
    "revenue_by_refund_patpaid",
    "revenue_by_refund_otherpaid",
    "revenue_exemption_by_refund_patpaid",
    "revenue_by_adjust_patpaid",
    "revenue_by_adjust_otherpaid",
]
LEDGER_MEASURES = [*RECEIPTS, *PAYMENTS, *REVENUES, "advance_payment", "deduction"]

# Sums shown at the end of a row.
LEDGER_TOTALS = {"total_receipts": RECEIPTS, "total_payments": PAYMENTS, "total_revenue": REVENUES}

SUMMARY_TOLERANCE = 300
DETAIL_TOLERANCE = 100


# Amounts of a receivable; the part paid by the patient is its main amount.
RECEIVABLE_AMOUNTS = {
    "amount": SPLIT_PAID["patpaid"],
    "otherpaid": SPLIT_PAID["otherpaid"],
    "exempt": SPLIT_PAID["exempt"],
    "advance": "deposit",
}

# Receivables without and with a deposit; those settled by adjustment are told apart or not.
BILLED, PREPAID, ADJUSTED = "billed", "prepaid", "adjusted"
RECEIVABLE_KIND = f"CASE WHEN deposit = 0 THEN '{BILLED}' WHEN deposit > 0 THEN '{PREPAID}' END"
LEDGER_RECEIVABLE_KIND = (
    f"CASE WHEN hfe_payment_method = 'RC' THEN '{ADJUSTED}' ELSE {RECEIVABLE_KIND} END"
)


def _paid_measures(name: str, kind: str) -> list[Measure]:
    return [
        Measure(f"revenue_by_{name}_patpaid", "amount", (kind,)),
        Measure(f"revenue_by_{name}_otherpaid", "otherpaid", (kind,)),
        Measure(f"revenue_exemption_by_{name}_patpaid", "exempt", (kind,)),
    ]


ADVANCE = Measure("advance_payment", "advance", (PREPAID,))
RECEIVABLE_MEASURES = [
    *_paid_measures("receipt", BILLED),
    *_paid_measures("refund", PREPAID),
    ADVANCE,
]

# source: (kind of a row, its amounts); the kind of a cash row is the measure it feeds
_LEDGER = {
    "receipt": (
        f"CASE WHEN {ne_keep_null('hfe_deposit', 0)} THEN 'invoice_advance_payment_amount' "
        "ELSE 'invoice_receipt_amount' END",
        {"amount": "hfe_payment"},
    ),
    "deposit": ("'deposit_amount'", {"amount": "hfe_amount"}),
    "refund": (
        "CASE WHEN refund_type = 1 THEN 'refund_deduction_amount' "
        f"WHEN refund_type = 2 AND {ne_keep_null('hfe_payment_calc_mode', 'M')} "
        "THEN 'refund_after_payment_amount' "
        "WHEN refund_type = 3 THEN 'return_amount' "
        "WHEN refund_type = 4 THEN 'other_paid_amount' "
        "WHEN refund_type IN (2, 5) THEN 'adjust_paid_amount' END",
        {"amount": "hfe_amount"},
    ),
    "ar": (LEDGER_RECEIVABLE_KIND, RECEIVABLE_AMOUNTS),
}

_LEDGER_MEASURES = [
    *[Measure(name, "amount", (name,)) for name in (*RECEIPTS, *PAYMENTS)],
    *_paid_measures("receipt", BILLED),
    *_paid_measures("refund", PREPAID),
    Measure("revenue_by_adjust_patpaid", "amount", (ADJUSTED,)),
    Measure("revenue_by_adjust_otherpaid", "otherpaid", (ADJUSTED,)),
    ADVANCE,
]
DEDUCTION = "deduction"
_MEASURES = [*_LEDGER_MEASURES, Measure("deduction", "amount", (DEDUCTION,))]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("hfe_invoiceno", F.expr(invoice_key("hfe_invoiceno")))


def ledger_sources(tables, from_date: str, to_date: str) -> list[Source]:
    """Receipts, deposits, refunds and receivables with the amounts each brings."""
    return [
        Source(_keyed(tables.fact(name, from_date, to_date)), kind, amounts)
        for name, (kind, amounts) in _LEDGER.items()
    ]


def ledger_keys(tables, from_date: str, to_date: str, keys: Sequence[str]) -> DataFrame:
    """Keys of the rows that feed any measure."""
    return kind_rows(ledger_sources(tables, from_date, to_date), keys).select(*keys)


def _reconcile(
    tables,
    from_date: str,
    to_date: str,
    keys: list[str],
    fine: list[str],
    coarse: list[str],
    mode: str,
) -> DataFrame:
    """Ledger measures and deductions at ``keys``.

    The measures are plain sums, so they go to ``keys`` at once. Only the deductions need the
    invoice: they are summed at ``coarse``, attached to the distinct ``fine`` keys and summed to
    ``keys``, then take their place beside the other kinds. No row with all measures is shuffled.
    """
    sources = ledger_sources(tables, from_date, to_date)
    wanted = [*coarse, "revenue"]
    deduction = _keyed(tables.fact("deduction", from_date, to_date, columns=wanted))
    per_invoice = sum_by(deduction, coarse, ["revenue"])
    owners = kind_rows(sources, fine).select(*fine)
    attached = attach_coarse(owners, per_invoice, coarse, mode, deduction)
    deducted = attached.selectExpr(*keys, f"'{DEDUCTION}' AS {KIND}", "revenue AS amount")
    sums = union_padded(
        sum_kinds(kind_rows(sources, keys), keys, list(RECEIVABLE_AMOUNTS)),
        sum_kinds(deducted, keys, ["amount"]),
    )
    return kinds_as_columns(sums, keys, [m.sql() for m in _MEASURES])


def _reconcile_once(
    tables,
    from_date: str,
    to_date: str,
    keys: list[str],
    fine: list[str],
    coarse: list[str],
) -> DataFrame:
    """As ``_reconcile`` with ``compat``, for keys nearly as fine as the rows: every fact is read once.

    The measures are summed at ``fine`` at once, the deductions meet these sums, and both are summed
    to ``keys``. Summing by kind first would hardly make fewer rows, and a second read of the facts
    for the keys alone costs more than the wider rows in the join.
    """
    wanted = [*coarse, "revenue"]
    deduction = _keyed(tables.fact("deduction", from_date, to_date, columns=wanted))
    per_invoice = sum_by(deduction, coarse, ["revenue"])
    rows = kind_rows(ledger_sources(tables, from_date, to_date), fine)
    sums = aggregate(rows, fine, [m.sql() for m in _LEDGER_MEASURES])
    both = sums.join(per_invoice, coarse, "full")
    totals = [total(m.name) for m in _LEDGER_MEASURES]
    return aggregate(both, keys, [*totals, "coalesce(sum(revenue), 0) AS deduction"])


def _reconcile_exactly(
    tables,
    from_date: str,
    to_date: str,
    keys: list[str],
    fine: list[str],
    coarse: list[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """As ``_reconcile`` with ``exact``, for keys nearly as fine as the rows: every fact is read once.

    The deductions are one more kind of rows, at ``coarse`` and with nulls for the rest of ``fine``.
    Rows are summed by kind, narrow as they are, and a deduction then goes to the smallest of the fine
    keys it meets, if any; there is no join, and the wide aggregate comes last. With ``order``, the
    keys in the order of the report, narrow rows are dealt by ranges of it, and the report is sorted
    where it is summed.
    """
    rest = [c for c in fine if c not in coarse]
    wanted = [*coarse, "revenue"]
    deduction = drop_null_keys(_keyed(tables.fact("deduction", from_date, to_date, columns=wanted)), coarse)
    keyless = deduction.selectExpr(*wanted, *(f"CAST(NULL AS STRING) AS {c}" for c in rest))
    owed = kind_rows([Source(keyless, f"'{DEDUCTION}'", {"amount": "revenue"})], fine, keep_null_keys=True)
    ledger = kind_rows(ledger_sources(tables, from_date, to_date), fine)
    sums = sum_kinds(union_padded(ledger, owed), fine, list(RECEIVABLE_AMOUNTS))
    is_owed = f"{KIND} = '{DEDUCTION}'"
    smallest = f"min(CASE WHEN NOT {is_owed} THEN struct({', '.join(rest)}) END)"
    met = sums.withColumn("smallest", F.expr(f"{smallest} OVER (PARTITION BY {', '.join(coarse)})"))
    placed = {c: F.expr(f"CASE WHEN {is_owed} THEN smallest.{c} ELSE {c} END") for c in rest}
    dealt = met.withColumns(placed).select(*keys, KIND, *RECEIVABLE_AMOUNTS)
    if order:
        dealt = dealt.repartitionByRange(*(F.asc_nulls_last(c) for c in order))
    return aggregate(dealt, keys, [m.sql() for m in _MEASURES])


def summary_reconciliation(
    tables,
    from_date: str,
    to_date: str,
    method: str | None = None,
    status: bool | None = None,
    mode: str = "compat",
    ordered: bool = True,
) -> DataFrame:
    """Per cashier and payment method. Filters act on the checked rows."""
    keys = ["hfe_staff", "thungan", "hfe_payment_method"]
    sums = _reconcile(
        tables, from_date, to_date, keys, ["hfe_invoiceno", *keys], ["hfe_invoiceno"], mode
    )
    checked = reconcile_checks(sums, SUMMARY_TOLERANCE)
    chosen = filter_optional(checked, hfe_payment_method=method, comparison_criteria_4=status)
    return order_report(chosen, ["hfe_payment_method", "hfe_staff", "thungan"], ordered)


def detail_reconciliation(
    tables,
    from_date: str,
    to_date: str,
    cashier: str | None = None,
    method: str | None = None,
    status: bool | None = None,
    mode: str = "compat",
    ordered: bool = True,
) -> DataFrame:
    """Per document, cashier and payment method."""
    keys = ["hfe_docno_1", "thungan", "hfe_payment_method"]
    coarse = ["hfe_docno_1", "hfe_invoiceno"]
    order = ["hfe_payment_method", "thungan"]
    period, fine = (from_date, to_date), [*coarse, *keys[1:]]
    if mode == "exact":
        ranges = dict.fromkeys([*order, *keys]) if ordered else ()
        sums = _reconcile_exactly(tables, *period, keys, fine, coarse, tuple(ranges))
    elif mode == "compat":
        sums = _reconcile_once(tables, *period, keys, fine, coarse)
    else:
        raise ValueError("mode must be compat or exact")
    checked = reconcile_checks(sums, DETAIL_TOLERANCE)
    chosen = filter_optional(
        checked, thungan=cashier, hfe_payment_method=method, comparison_criteria_4=status
    )
    return order_report(chosen, order, ordered, keys)


def summary_reconciliation_print(
    tables,
    from_date: str,
    to_date: str,
    method: str | None = None,
    status: bool | None = None,
) -> DataFrame:
    """The summary as printed: from the cashier on, with a total row, amounts as text."""
    rows = summary_reconciliation(tables, from_date, to_date, method, status, ordered=False)
    rows = rows.select("thungan", "hfe_payment_method", *LEDGER_MEASURES, "hfe_staff")
    order = [TOTAL_FLAG, "hfe_payment_method", "hfe_staff", "thungan"]
    printed = order_report(with_grand_total(rows, LEDGER_MEASURES, flag=True), order)
    return number_texts(printed.drop("hfe_staff", TOTAL_FLAG), LEDGER_MEASURES)
