"""Shape of the physical plans, and properties that hold between reports."""

import re

import pytest
from conftest import DATA
from facts import make

from soquy.operators.shape import CATEGORIES
from soquy.plans import deduction, exam, reconcile, receivables, revenue
from soquy.registry import ALWAYS, QUERIES
from soquy.sources.schemas import FACTS
from soquy.sources.sinks import write_fact
from soquy.sources.star import StarTables
from soquy.sources.tables import FrameTables, ParquetTables


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", initial_plan(df)))


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return StarTables(spark, DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    """No pairs of rows, no Python per row, no broadcast that Spark did not size itself."""
    df = QUERIES[name].run(spark, DATA)
    plan = initial_plan(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "InPandas"):
        assert node not in plan
    assert "strategy=broadcast" not in logical(df)


def test_pivot_scans_once_and_never_joins(tables):
    df = revenue.pivot_by(tables, *ALWAYS, "revenue", [], ordered=False)
    plan = initial_plan(df)
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert exchanges(df) == 2


def test_unneeded_dimensions_are_not_joined(tables):
    plan = initial_plan(deduction.summary_deduction(tables, *ALWAYS))
    assert "Join" not in plan and "o_orderkey" not in plan


def test_receivables_need_no_join_of_their_own(tables):
    plan = initial_plan(receivables.account_receivables(tables, *ALWAYS))
    assert plan.count("Join") == initial_plan(tables.fact("ar", *ALWAYS)).count("Join")


def test_reconciliation_shuffles_only_keys_for_the_deductions(tables):
    """The join sees keys and one amount; the measures go around it."""
    df = reconcile.summary_reconciliation(tables, *ALWAYS, ordered=False)
    joins = [n for n in logical(df).splitlines() if "Join LeftOuter" in n]
    assert len(joins) == 1
    assert "invoice_receipt_amount" not in joins[0]


def test_categories_and_retail_add_up(tables):
    df = revenue.summary_revenue(tables, *ALWAYS)
    parts = df.selectExpr(*[f"sum({c}) AS {c}" for c in [*CATEGORIES, "drug_retail"]]).first()
    rows = tables.fact("revenue", *ALWAYS).where(
        "kcb_class IS NOT NULL AND price_type IS NOT NULL AND object_type IS NOT NULL"
    )
    assert sum(parts) == rows.selectExpr("sum(revenue)").first()[0]


def test_statuses_partition_the_report(tables):
    whole = reconcile.detail_reconciliation(tables, *ALWAYS, ordered=False).count()
    parts = [
        reconcile.detail_reconciliation(tables, *ALWAYS, status=s, ordered=False).count()
        for s in (True, False)
    ]
    assert whole == sum(parts) and all(parts)


def test_known_figures(tables):
    if not DATA.endswith("sf0.01"):
        pytest.skip("figures of sf0.01")
    checked = revenue.revenue_reconciliation(tables, *ALWAYS).groupBy("comparison_criteria")
    assert dict(checked.count().collect()) == {True: 1000, False: 500}
    for mode, expected in (("exact", "1065841923.13"), ("compat", "1092223719.75")):
        df = reconcile.summary_reconciliation(tables, *ALWAYS, mode=mode)
        assert df.count() == 41
        assert str(df.selectExpr("CAST(sum(deduction) AS DECIMAL(28,2))").first()[0]) == expected
    detail = reconcile.detail_reconciliation(tables, *ALWAYS, ordered=False)
    assert detail.count() == 13402
    assert detail.where("comparison_criteria_4").count() == 12961


def test_reports_come_in_their_order(tables):
    rows = reconcile.summary_reconciliation(tables, *ALWAYS).collect()

    def last(value):
        return (value is None, value)

    keys = [(last(r.hfe_payment_method), last(r.hfe_staff), last(r.thungan)) for r in rows]
    assert keys == sorted(keys)
    dates = [r.hfe_date for r in receivables.account_receivables(tables, *ALWAYS).collect()]
    assert dates == sorted(dates)


def test_print_puts_the_total_last(tables):
    rows = reconcile.summary_reconciliation_print(tables, *ALWAYS).collect()
    assert rows[-1].thungan == "Tổng cộng" and len(rows) == 42
    assert rows[-1].deduction == "1.092.223.720"


@pytest.mark.parametrize(
    "plan, key",
    [
        (reconcile.detail_reconciliation, "hfe_docno_1"),
        (receivables.detail_other_paid, "hfe_docno_1"),
        (receivables.account_receivables, "hfe_docno_1"),
        (deduction.detail_deduction, "hfe_itemid"),
    ],
)
def test_order_goes_on_to_the_fine_key(tables, plan, key):
    """Otherwise all rows of one cashier or class would be sorted in one task."""
    shuffled = re.findall(r"rangepartitioning\(([^)]*)\)", initial_plan(plan(tables, *ALWAYS)))
    assert len(shuffled) == 1 and key in shuffled[0]


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ledger"))
    for name in ("receipt", "deposit", "refund", "ar", "deduction", "exam_revenue"):
        day = spark.createDataFrame(make(name, "plans", 40), FACTS[name]).selectExpr(
            "*", "DATE'2024-03-01' AS report_date"
        )
        write_fact(day, root, name)
    return ParquetTables(spark, root)


def test_detail_reconciliation_reads_each_landed_fact_once(ledger):
    for mode in ("compat", "exact"):
        df = reconcile.detail_reconciliation(ledger, "2024-03-01", "2024-03-31", mode=mode, ordered=False)
        assert initial_plan(df).count("FileScan parquet") == 5


def test_exact_detail_reconciliation_shuffles_its_wide_rows_never(ledger):
    """Neither a join nor an order brings rows with all measures to another task."""
    plan = initial_plan(reconcile.detail_reconciliation(ledger, "2024-03-01", "2024-03-31", mode="exact"))
    assert "Join" not in plan and plan.count("Exchange ") == 3
    assert plan.count("rangepartitioning") == 1


def test_exact_detail_reconciliation_gives_a_deduction_to_one_row(spark):
    """The smallest cashier and method of its invoice; without any, a row without both."""
    owner = {"hfe_docno_1": "D", "hfe_invoiceno": "1", "hfe_amount": 5}
    deposits = [{**owner, "thungan": c, "hfe_payment_method": m} for c, m in (("B", "CK"), ("A", "TM"), ("A", "CK"), ("A", "CK"), (None, "TM"))]
    deductions = [("D", "1", 7), ("D", "1", None), ("D", "2", 3), (None, "1", 9), ("E", "3", None)]
    fields = ["receipt", "refund", "ar"]
    frames = {n: spark.createDataFrame([], FACTS[n]) for n in fields}
    frames["deposit"] = spark.createDataFrame(deposits, "hfe_docno_1 string, hfe_invoiceno string, hfe_amount int, thungan string, hfe_payment_method string")
    frames["deposit"] = frames["deposit"].withColumn("hfe_amount", frames["deposit"].hfe_amount.cast("decimal(28,6)"))
    owed = spark.createDataFrame(deductions, "hfe_docno_1 string, hfe_invoiceno string, revenue int")
    frames["deduction"] = owed.withColumn("revenue", owed.revenue.cast("decimal(28,6)"))
    rows = reconcile.detail_reconciliation(FrameTables(spark, frames), *ALWAYS, mode="exact").collect()
    found = [(r.hfe_docno_1, r.thungan, r.hfe_payment_method, int(r.deposit_amount), int(r.deduction)) for r in rows]
    assert found == [
        ("D", "A", "CK", 10, 7), ("D", "B", "CK", 5, 0), ("D", "A", "TM", 5, 0), ("D", None, None, 0, 3), ("E", None, None, 0, 0),
    ]


def test_exam_revenue_by_patient_shuffles_once(ledger):
    df = exam.exam_revenue_by_patient(ledger, "2024-03-01", "2024-03-31", ordered=False)
    assert initial_plan(df).count("Exchange hashpartitioning") == 1
