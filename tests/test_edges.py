"""Reports over facts full of nulls, unknown codes and bad text, against the naive SQL cascade."""

import pytest
from compare import assert_same
from facts import PERIOD, duck, make, spark_frames

from soquy.oracle import statements as sql
from soquy.plans import deduction, exam, inventory, package, receivables, reconcile, retail, revenue
from soquy.registry import as_plain
from soquy.sources.schemas import FACTS
from soquy.sources.tables import FrameTables

SUMMARY, DETAIL = reconcile.summary_reconciliation, reconcile.detail_reconciliation
REPORTS = {
    "summary": (SUMMARY, {}, sql.reconciliation(False)),
    "summary_exact": (SUMMARY, {"mode": "exact"}, sql.reconciliation(False, mode="exact")),
    "summary_filtered": (
        SUMMARY,
        {"method": "TM", "status": False},
        sql.having(
            sql.reconciliation(False, "hfe_payment_method = 'TM'"), sql.status_is(False)
        ),
    ),
    "detail": (DETAIL, {}, sql.reconciliation(True)),
    "detail_exact": (DETAIL, {"mode": "exact"}, sql.reconciliation(True, mode="exact")),
    "detail_cashier": (
        DETAIL, {"cashier": "An"}, sql.reconciliation(True, "thungan = 'An'")
    ),
    "exemption": (receivables.detail_exemption, {}, sql.exemption()),
    "other_paid": (receivables.detail_other_paid, {}, sql.other_paid()),
    "receivables": (receivables.account_receivables, {}, sql.receivables()),
    "summary_revenue": (revenue.summary_revenue, {}, sql.summary_revenue()),
    "by_order": (revenue.revenue_by_order_dept, {}, sql.by_order("revenue")),
    "by_order_dept": (
        revenue.revenue_by_order_dept, {"dept": "K1"}, sql.by_order("revenue", "K1")
    ),
    "by_both": (revenue.revenue_by_order_and_perform_dept, {}, sql.by_both("revenue")),
    "items": (
        revenue.detail_revenue,
        {"category": "DT002", "order": "K1"},
        sql.items(
            "detail_revenue", "sd_makhoa_taichinh_order = 'K1'", base="hft_id2 = 'DT002'"
        ),
    ),
    "revenue_check": (revenue.revenue_reconciliation, {}, sql.revenue_check()),
    "summary_deduction": (
        deduction.summary_deduction, {}, sql.pivot(sql.CLASSES, "deduction")
    ),
    "deduction_both": (
        deduction.deduction_by_order_and_perform_dept, {}, sql.by_both("deduction")
    ),
    "deduction_items": (
        deduction.detail_deduction, {}, sql.items("detail_deduction", depts=True)
    ),
    "retail": (retail.retail_revenue, {}, sql.retail("revenue")),
    "retail_deduction": (retail.retail_deduction, {}, sql.retail("deduction")),
    "retail_no_cogs": (retail.retail_revenue, {"cogs": False}, sql.retail_no_cogs()),
    "food": (retail.functional_food_revenue, {}, sql.functional_food()),
    "package": (package.package_cost_by_dept, {}, sql.package()),
    "exam": (exam.exam_revenue, {}, sql.exam()),
    "exam_patient": (exam.exam_revenue_by_patient, {}, sql.exam(True)),
    "imports": (inventory.inventory_import, {}, sql.imports()),
    "imports_of": (
        inventory.inventory_import, {"storage_ids": [7]}, sql.imports("stock_import = 7")
    ),
    "exports": (inventory.inventory_export, {}, sql.exports()),
    "requisitions": (
        inventory.inventory_export_requisition, {"storage_ids": []}, sql.requisitions()
    ),
}

# A third of all rows under one invoice, document, cashier and class.
HOT = {
    "hfe_invoiceno": None, "hfe_docno_1": "D1", "hfe_staff": 1, "thungan": "An",
    "hfe_payment_method": "TM", "kcb_class": 1, "price_type": 1, "object_type": 1,
    "drug_retail": "N", "hft_id2": "DT005",
}


def scenario(kind):
    if kind == "hot":
        return {n: make(n, "hot", 150, HOT) for n in FACTS}
    facts = {n: make(n, kind) for n in FACTS}
    if kind == "no_cash":
        facts |= {"receipt": [], "deposit": [], "refund": []}
    if kind == "no_receivables":
        facts |= {"ar": []}
    if kind == "no_lines":
        facts |= {"revenue": [], "deduction": []}
    return facts


@pytest.fixture(scope="module", params=["a", "b", "hot", "no_cash", "no_receivables", "no_lines"])
def both(request, spark):
    facts = scenario(request.param)
    frames = {n: df.cache() for n, df in spark_frames(spark, facts).items()}
    yield FrameTables(spark, frames, missing="empty"), duck(facts)
    for df in frames.values():
        df.unpersist()


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_equals_cascade(both, name):
    tables, con = both
    plan, filters, statement = REPORTS[name]
    assert_same(as_plain(plan(tables, *PERIOD, **filters)), con.sql(statement))


@pytest.mark.parametrize("name", list(REPORTS))
def test_empty_input_gives_empty_report(spark, name):
    plan, filters, _ = REPORTS[name]
    assert plan(FrameTables(spark, {}, missing="empty"), *PERIOD, **filters).collect() == []
