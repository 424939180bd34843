"""Every query by name: the DataFrame plan over a data folder, and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.functions.nulls import ensure_columns, is_blank
from soquy.functions.text import (
    comma_thousands,
    date_text,
    date_text_strict,
    dot_thousands,
    to_int_or_null,
)
from soquy.operators.checks import row_totals
from soquy.operators.filters import search_rows
from soquy.operators.dims import new_members, storage_changes
from soquy.operators.present import option_list, page, page_after, store_pages, with_grand_total
from soquy.operators.setops import union_members, union_padded
from soquy.operators.shape import CATEGORIES, CLASS_KEYS
from soquy.operators.sums import distinct_members
from soquy.oracle import statements as sql
from soquy.oracle.views import with_views
from soquy.plans import deduction, exam, inventory, members, package, receivables, reconcile
from soquy.plans import retail, revenue
from soquy.sources.schemas import DIMENSIONS, FACTS, PERIOD_COLUMN
from soquy.sources.sinks import store_dim, work_dir, write_dim, write_fact, write_report
from soquy.sources.snapshots import SnapshotTables, land_fact, stage_fact
from soquy.sources.star import StarTables
from soquy.sources.tables import (
    ALL_DAYS,
    EnvelopeTables,
    FrameTables,
    ParquetTables,
    read_envelope,
)
from soquy.sources.versions import StaleVersion, append_members, append_version, read_members

# A period that holds every row.
ALWAYS = (ALL_DAYS, ALL_DAYS)
YEAR = ("1997-01-01", "1997-12-31")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def as_plain(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles and days as text, at the very end."""
    shown = {T.DecimalType: "DOUBLE", T.DateType: "STRING"}
    casts = {
        f.name: F.expr(f"CAST({f.name} AS {shown[type(f.dataType)]})")
        for f in df.schema.fields
        if type(f.dataType) in shown
    }
    return df.withColumns(casts) if casts else df


def report(plan, oracle: str, period: tuple[str, str] = ALWAYS, **filters) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_plain(plan(StarTables(spark, folder), *period, **filters))

    return Query(run, with_views(oracle, None if period is ALWAYS else period))


def shown(make: Callable[[StarTables], DataFrame], oracle: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_plain(make(StarTables(spark, folder)))

    return Query(run, with_views(oracle))


# ---- stored dimensions of the stand-in ------------------------------------------------------


def _dim_cashier(t: StarTables) -> DataFrame:
    name = F.concat(F.lit("Cashier_"), F.col("n_nationkey").cast("string")).alias("name")
    return t.table("nation").where("n_regionkey < 2").select(name)


def _dim_method(t: StarTables) -> DataFrame:
    """Two methods of the facts and two that no fact has; one member per region."""
    codes = "element_at(map(0, 'TM', 1, 'QR', 2, 'VISA', 3, 'JCB'), CAST(r_regionkey AS INT))"
    return t.table("region").where("r_regionkey < 4").selectExpr(f"{codes} AS method")


def _dim_department(t: StarTables) -> DataFrame:
    dept = F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("dept")
    stored = t.table("nation").where("n_regionkey < 3")
    return stored.select(dept, F.col("n_name").alias("dept_name"))


def _dim_storage(t: StarTables) -> DataFrame:
    name = F.when(F.col("n_regionkey") == 1, "  ").when(F.col("n_regionkey") != 2, F.col("n_name"))
    stored = t.table("nation").where("n_regionkey < 4")
    return stored.select(
        F.col("n_nationkey").cast("int").alias("storage_id"), name.alias("storage_name")
    )


# ---- queries over more than one report ------------------------------------------------------


class _SharedKeys(StarTables):
    """Waived receivables of payer 1 are owed by payer 3 too, under the same key."""

    def fact(self, name, from_date, to_date, **narrowing) -> DataFrame:
        df = super().fact(name, from_date, to_date, **narrowing)
        copies = df.where((F.col("receipt_object") == 1) & (F.col("freeamount") > 0))
        return union_padded(df, copies.withColumn("receipt_object", F.lit(3)))


def _shared_receivables(spark: SparkSession, folder: str) -> DataFrame:
    return as_plain(receivables.account_receivables(_SharedKeys(spark, folder), *ALWAYS))


def _with_report_date(t: StarTables, name: str, day: str) -> DataFrame:
    """A line fact to be landed under the first day of the month of one of its dates."""
    return t.fact(name, *ALWAYS).withColumn(PERIOD_COLUMN, F.expr(f"trunc({day}, 'MM')"))


def _landed_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Slips landed by month of expiry, then read back for a year."""
    root = work_dir(spark)
    slips = _with_report_date(StarTables(spark, folder), "inv_export", "expdate")
    write_fact(slips, root, "inv_export")
    return as_plain(inventory.inventory_export(ParquetTables(spark, root), *YEAR))


def _envelopes(df: DataFrame) -> DataFrame:
    """One envelope per row of a fact."""
    record = F.struct(*[c for c in df.columns if c != PERIOD_COLUMN])
    kept = [PERIOD_COLUMN] if PERIOD_COLUMN in df.columns else []
    return df.select(F.to_json(F.struct(F.array(record).alias("data"))).alias("value"), *kept)


def _store_envelopes(lines: DataFrame, path: str) -> None:
    """Envelopes of one line each as compressed text: every record repeats the names of its columns."""
    kept = [PERIOD_COLUMN] if PERIOD_COLUMN in lines.columns else []
    lines.write.partitionBy(*kept).option("compression", "gzip").text(path)


def _envelope_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Receivables written as envelopes, one document per line, and summed from there."""
    root = work_dir(spark)
    _store_envelopes(_envelopes(StarTables(spark, folder).fact("ar", *ALWAYS)), root)
    rows = read_envelope(spark, root, FACTS["ar"], multi_line=False)
    tables = FrameTables(spark, {"ar": rows})
    return as_plain(receivables.detail_exemption(tables, *ALWAYS))


def _landed_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Slips landed as envelopes by month of receipt, then read for a year."""
    root = work_dir(spark)
    t = StarTables(spark, folder)
    slips = _envelopes(_with_report_date(t, "inv_export_pdt", "receiptdate"))
    _store_envelopes(slips.hint("rebalance", PERIOD_COLUMN), f"{root}/inv_export_pdt")
    tables = EnvelopeTables(spark, root, multi_line=False)
    return as_plain(inventory.inventory_export_requisition(tables, *YEAR))


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as CSV and read back."""
    path = work_dir(spark)
    df = as_plain(revenue.revenue_by_order_dept(StarTables(spark, folder), *ALWAYS))
    write_report(df, path, "csv")
    return spark.read.schema(df.schema).csv(path, header=True)


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    """A stored dimension, and the departments it lacks appended to the same table."""
    path = work_dir(spark)
    t = StarTables(spark, folder)
    write_dim(_dim_department(t), path)
    dept = revenue.PERFORM_DEPT
    rows = t.fact("detail_deduction", *ALWAYS, columns=[dept])
    seen = distinct_members(rows, dept).withColumnRenamed(dept, "dept")
    write_dim(new_members(spark.read.parquet(path), seen), path)
    # once more: nothing is missing now
    write_dim(new_members(spark.read.parquet(path), seen), path)
    return spark.read.parquet(path)


def _stored_storages(spark: SparkSession, folder: str) -> DataFrame:
    """A storage dimension stored twice, each time at a new path, from the one before."""
    t = StarTables(spark, folder)
    dim = _dim_storage(t)
    for _ in range(2):
        path = work_dir(spark)
        store_dim(members.upsert_storages(t, *ALWAYS, dim), path)
        dim = spark.read.parquet(path)
    return dim


def _landed_slips(spark: SparkSession, folder: str) -> ParquetTables:
    """Slips of all days landed, with and without a date, then two years once more."""
    root = work_dir(spark)
    slips = _with_report_date(StarTables(spark, folder), "inv_export", "expdate")
    write_fact(slips, root, "inv_export")
    for year in (1996, 1997):
        write_fact(slips.where(F.year(PERIOD_COLUMN) == year), root, "inv_export")
    return ParquetTables(spark, root)


def _landed_periods(spark: SparkSession, folder: str) -> DataFrame:
    """All slips landed, two years of them twice, then these two read."""
    return as_plain(inventory.inventory_export(_landed_slips(spark, folder), "1996-01-01", "1997-12-31"))


def _snapshot_periods(spark: SparkSession, folder: str) -> DataFrame:
    """All slips landed by snapshots, two years of them once more, then a landing that is lost before
    its commit; these two years read."""
    root = work_dir(spark)
    slips = _with_report_date(StarTables(spark, folder), "inv_export", "expdate")
    land_fact(slips.withColumn("stock_name", F.lit("old")), root, "inv_export")
    land_fact(slips.where(F.year(PERIOD_COLUMN).isin(1996, 1997)), root, "inv_export")
    stage_fact(slips.where(F.year(PERIOD_COLUMN) == 1996).limit(10), root, "inv_export")
    return as_plain(inventory.inventory_export(SnapshotTables(spark, root), "1996-01-01", "1997-12-31"))


def _department_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Departments appended twice from one base: one attempt is run again, the other one is refused,
    made anew, and finds nothing missing."""
    path, schema = work_dir(spark), DIMENSIONS["dim_department"]
    t = StarTables(spark, folder)
    base = append_version(_dim_department(t), path, 0)
    dept = revenue.PERFORM_DEPT
    rows = t.fact("detail_deduction", *ALWAYS, columns=[dept])
    seen = distinct_members(rows, dept).withColumnRenamed(dept, "dept")
    lacking = new_members(read_members(spark, path, schema, "dept", base), seen)
    for attempt in ("first", "first", "second"):
        try:
            append_version(lacking, path, base, attempt)
        except StaleVersion:
            append_members(spark, path, schema, "dept", lambda dim: new_members(dim, seen))
    return read_members(spark, path, schema, "dept")


def _storage_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A storage dimension by versions: stored, then what it lacked, twice."""
    path, schema = work_dir(spark), DIMENSIONS["dim_storage"]
    t = StarTables(spark, folder)
    append_version(_dim_storage(t), path, 0)
    pairs = members.storage_pairs(t, *ALWAYS)
    for _ in range(2):
        append_members(spark, path, schema, "storage_id", lambda dim: storage_changes(dim, pairs))
    return read_members(spark, path, schema, "storage_id")


class _Renamed(StarTables):
    """Storages that are renamed each year."""

    def fact(self, name, from_date, to_date, **narrowing) -> DataFrame:
        df = super().fact(name, from_date, to_date, **narrowing)
        if name == "inv_import" and PERIOD_COLUMN in df.columns:
            df = df.withColumn("stock_name", F.expr(f"concat(stock_name, ' of ', 3000 - year({PERIOD_COLUMN}))"))
        return df


def _renamed_storages(spark: SparkSession, folder: str) -> DataFrame:
    return members.storage_pairs(_Renamed(spark, folder), *ALWAYS)


def _stored_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of 50 documents, from a report kept for paging."""
    df = as_plain(revenue.revenue_reconciliation(StarTables(spark, folder), *ALWAYS, ordered=False))
    return store_pages(df, ["hfe_docno_1"], work_dir(spark), ranges=16).page(2, 50)


def _stored_page_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Items without a class come last; a page that begins before and ends among them."""
    keys = [*CLASS_KEYS, *revenue.ITEM_KEYS, "hfe_unit"]
    df = as_plain(revenue.detail_revenue(StarTables(spark, folder), *ALWAYS, category="DT005", ordered=False))
    return store_pages(df.select(*keys), ["hfe_unit", *CLASS_KEYS], work_dir(spark)).page(17, 100)


WHOLE_DOCUMENT_RECORDS = 20_000
_EVIL = ' }{"]' + chr(92)


def _whole_documents(rows: DataFrame, path: str, per_document: int = WHOLE_DOCUMENT_RECORDS) -> None:
    """Rows as documents of many records, one a file and a record a line; their number grows with the
    rows."""
    n = max(1, -(-rows.count() // per_document))
    dealt = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).alias("d"), F.to_json(F.struct(*rows.columns)).alias("record"))
    of_document = "OVER (PARTITION BY d ORDER BY record)"
    # the ends come with the first and the last record, so that nothing has to be brought beside them
    lines = dealt.selectExpr("*", f"row_number() {of_document} AS place", f"lead(record) {of_document} IS NULL AS last")
    text = """concat(if(place = 1, '{"status": "{", "data": [\\n', ','), record, if(last, '\\n]}', '')) AS value"""
    lines.sortWithinPartitions("d", "place").selectExpr("d", text).write.partitionBy("d").text(path)


def _whole_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Receivables as whole documents of many records, with braces and quotes in their texts, each
    read by many tasks, and summed from there."""
    root = work_dir(spark)
    rows = StarTables(spark, folder).fact("ar", *ALWAYS)
    _whole_documents(rows.withColumn("hd_cardno", F.concat("hd_cardno", F.lit(_EVIL))), root)
    back = read_envelope(spark, root, FACTS["ar"], multi_line=True)
    whole = F.col("hd_cardno").isNull() | F.endswith("hd_cardno", F.lit(_EVIL))
    back = back.withColumn("thungan", F.when(whole, F.col("thungan")).otherwise("a card number was cut"))
    return as_plain(receivables.detail_exemption(FrameTables(spark, {"ar": back}), *ALWAYS))


def _retail_without_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Retail lines of an answer without the cost column, which then counts as 0."""
    lines = StarTables(spark, folder).fact("revenue", *ALWAYS).drop("cogs_drug_retail")
    lines = ensure_columns(lines, {"cogs_drug_retail": "decimal(18,2)", "revenue": "decimal(18,2)"}, 0)
    return as_plain(retail.retail_revenue(FrameTables(spark, {"revenue": lines}), *ALWAYS))


def _all_departments(t: StarTables) -> DataFrame:
    dept = F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("dept")
    return t.table("nation").select(dept, F.col("n_name").alias("dept_name"))


def _documents_of_many(rows: DataFrame, per_document: int = 100) -> DataFrame:
    """Rows as documents of about ``per_document`` records: their number grows with the rows. They are
    dealt by a hash of the whole row, so that no value of one column makes a document large."""
    n = max(1, -(-rows.count() // per_document))
    dealt = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).alias("d"))
    return dealt.agg(F.collect_list(F.struct(*rows.columns)).alias("data")).select("data")


def _fine_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Receivables as documents of many records each, with amounts of four decimals and codes
    written as ``1.0``, read back and summed."""
    root = work_dir(spark)
    fields = [c for c in FACTS["ar"].names]
    rows = StarTables(spark, folder).fact("ar", *ALWAYS)
    fine = rows.withColumn("patpaid", F.expr("CAST(patpaid + 0.0125 AS STRING)"))
    fine = fine.withColumn("kcb_class", F.expr("concat(kcb_class, '.0')"))
    documents = _documents_of_many(fine.select(*fields))
    _store_envelopes(documents.select(F.to_json(F.struct("data")).alias("value")), root)
    back = read_envelope(spark, root, FACTS["ar"])
    sums = back.groupBy("kcb_class").agg(F.sum("patpaid").alias("patpaid"), F.count("*").alias("n"))
    return as_plain(sums)


def _fine_details(t: StarTables) -> DataFrame:
    """Item lines with quantities of three and prices of four decimals."""
    rows = t.fact("detail_deduction", *ALWAYS)
    fine = rows.withColumns(
        {c: F.expr(f"CAST({c} / 8 AS DECIMAL(28,6))") for c in ("hfe_quantity", "revenue")}
    )
    tables = FrameTables(t.spark, {"detail_deduction": fine})
    return deduction.detail_deduction(tables, *ALWAYS, ordered=False)


def _one_sided(t: StarTables) -> DataFrame:
    """Revenue lines against no receivable at all."""
    frames = {"revenue": t.fact("revenue", *ALWAYS)}
    tables = FrameTables(t.spark, frames, missing="empty")
    return revenue.revenue_reconciliation(tables, *ALWAYS)


def _mixed_texts(t: StarTables) -> DataFrame:
    """Dates in several forms and numbers with and without a fraction."""
    rows = t.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE l_linenumber % 4 WHEN 0 THEN date_format(l_shipdate, 'yyyy-MM-dd') "
        "WHEN 1 THEN date_format(l_shipdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(l_shipdate, 'dd-MM-yyyy') "
        "ELSE date_format(l_shipdate, 'MM.yyyy') END AS day",
        "CASE l_linenumber % 3 WHEN 0 THEN concat(l_orderkey, '.0000001') WHEN 1 THEN concat(l_orderkey, '.000') "
        "ELSE CAST(l_orderkey AS STRING) END AS number",
    )
    return rows.selectExpr(
        "l_orderkey", "l_linenumber", f"{date_text('day')} AS day", f"{to_int_or_null('number')} AS number"
    )


def _number_texts(t: StarTables) -> DataFrame:
    rows = t.fact("ar", *ALWAYS, columns=["hfe_invoiceno", "deposit", "insurance"])
    rows = rows.selectExpr("*", "CAST(insurance / 8 AS DECIMAL(20,3)) AS half")
    return rows.selectExpr(
        "hfe_invoiceno",
        f"{dot_thousands('half')} AS even",
        f"{dot_thousands('-half', null_as_zero=True)} AS cut",
        f"{dot_thousands('deposit', null_as_zero=True)} AS deposit_or_zero",
        f"{comma_thousands('half')} AS half_up",
    )


def _text_parsing(t: StarTables) -> DataFrame:
    columns = ["documentno", "orderno", "transaction_date", "expdate", "docno", "stock_name"]
    return t.fact("inv_export", *ALWAYS, columns=columns).selectExpr(
        "documentno",
        "orderno",
        f"{date_text('transaction_date')} AS lenient",
        f"{date_text_strict('expdate')} AS strict",
        f"{to_int_or_null('docno')} AS docno",
        f"{is_blank('stock_name')} AS nameless",
    )


def _departments(t: StarTables) -> DataFrame:
    columns = [revenue.ORDER_DEPT, revenue.PERFORM_DEPT]
    rows = t.fact("revenue", *ALWAYS, columns=columns)
    order, perform = (
        distinct_members(rows, c).withColumnRenamed(c, "dept") for c in columns
    )
    return union_members(order, perform)


def _searched_total(t: StarTables) -> DataFrame:
    df = revenue.summary_revenue(t, *ALWAYS, ordered=False)
    amounts = [*CATEGORIES, "drug_retail", "revenue"]
    return with_grand_total(search_rows(df, "nội BHYT", CLASS_KEYS), amounts)


def _receivable_text(t: StarTables) -> DataFrame:
    df = receivables.account_receivables(t, *ALWAYS, ordered=False)
    return search_rows(df, "cashier_2 qr", ["thungan", "hfe_payment_method"])


_METHOD = "hfe_payment_method = 'CK'"
_CASHIER = "thungan = 'Cashier_3'"
_FIFTH = "hft_id2 = 'DT005'"
_ITEM_ORDER = ["hfe_unit", *CLASS_KEYS, *revenue.ITEM_KEYS]
_ITEM = ", ".join(_ITEM_ORDER)
_AFTER = ["Nội trú", "Theo yêu cầu", "BHYT"]
_SEARCHED = "lower(concat_ws(' ', kcb_class, price_type, object_type))"


def _queries() -> dict[str, Query]:
    summary, detail = reconcile.summary_reconciliation, reconcile.detail_reconciliation
    order, perform = revenue.ORDER_DEPT, revenue.PERFORM_DEPT
    no_rows = "TRY_CAST(transaction_date AS DATE)"
    year = "BETWEEN DATE '%s' AND DATE '%s'" % YEAR
    nine, ten = {"total": sql.NAMES}, {"total": [*sql.NAMES, "drug_retail"]}
    return {
        # reconciliation
        "summary_reconciliation": report(summary, sql.reconciliation(False)),
        "summary_reconciliation_method": report(
            summary, sql.reconciliation(False, _METHOD), method="CK"
        ),
        "summary_reconciliation_agreeing": report(
            summary, sql.having(sql.reconciliation(False), sql.status_is(True)), status=True
        ),
        "summary_reconciliation_differing": report(
            summary, sql.having(sql.reconciliation(False), sql.status_is(False)), status=False
        ),
        "summary_reconciliation_method_differing": report(
            summary,
            sql.having(sql.reconciliation(False, _METHOD), sql.status_is(False)),
            method="CK",
            status=False,
        ),
        "summary_reconciliation_exact": report(
            summary, sql.reconciliation(False, mode="exact"), mode="exact"
        ),
        "summary_reconciliation_year": report(summary, sql.reconciliation(False), YEAR),
        "summary_reconciliation_row_totals": shown(
            lambda t: row_totals(summary(t, *ALWAYS), reconcile.LEDGER_TOTALS),
            sql.totals(sql.reconciliation(False), **sql.LEDGER_TOTALS),
        ),
        "summary_reconciliation_print": report(
            reconcile.summary_reconciliation_print, sql.printed()
        ),
        "detail_reconciliation": report(detail, sql.reconciliation(True)),
        "detail_reconciliation_cashier": report(
            detail, sql.reconciliation(True, _CASHIER), cashier="Cashier_3"
        ),
        "detail_reconciliation_method": report(
            detail, sql.reconciliation(True, _METHOD), method="CK"
        ),
        "detail_reconciliation_agreeing": report(
            detail, sql.having(sql.reconciliation(True), sql.status_is(True)), status=True
        ),
        "detail_reconciliation_differing": report(
            detail, sql.having(sql.reconciliation(True), sql.status_is(False)), status=False
        ),
        "detail_reconciliation_all_filters": report(
            detail,
            sql.having(sql.reconciliation(True, f"{_METHOD} AND {_CASHIER}"), sql.status_is(True)),
            cashier="Cashier_3",
            method="CK",
            status=True,
        ),
        "detail_reconciliation_exact": report(
            detail, sql.reconciliation(True, mode="exact"), mode="exact"
        ),
        "detail_reconciliation_row_totals": shown(
            lambda t: row_totals(detail(t, *ALWAYS), reconcile.LEDGER_TOTALS),
            sql.totals(sql.reconciliation(True), **sql.LEDGER_TOTALS),
        ),
        # waivers, other payments, receivables
        "detail_exemption": report(receivables.detail_exemption, sql.exemption()),
        "detail_exemption_row_totals": shown(
            lambda t: row_totals(
                receivables.detail_exemption(t, *ALWAYS), receivables.EXEMPTION_TOTALS
            ),
            sql.totals(sql.exemption(), total=sql.EXEMPTION_TOTAL),
        ),
        "detail_other_paid": report(receivables.detail_other_paid, sql.other_paid()),
        "detail_other_paid_cashier": report(
            receivables.detail_other_paid, sql.other_paid(_CASHIER), cashier="Cashier_3"
        ),
        "account_receivables": report(receivables.account_receivables, sql.receivables()),
        "account_receivables_shared_keys": Query(
            _shared_receivables, with_views(sql.receivables(sql.SHARED_AR))
        ),
        "account_receivables_row_totals": shown(
            lambda t: row_totals(
                receivables.account_receivables(t, *ALWAYS), receivables.RECEIVABLE_TOTALS
            ),
            sql.totals(sql.receivables(), total=sql.RECEIVABLES),
        ),
        # revenue
        "summary_revenue": report(revenue.summary_revenue, sql.summary_revenue()),
        "summary_revenue_year": report(revenue.summary_revenue, sql.summary_revenue(), YEAR),
        "summary_revenue_row_totals": shown(
            lambda t: row_totals(
                revenue.summary_revenue(t, *ALWAYS), revenue.CATEGORY_RETAIL_TOTALS
            ),
            sql.totals(sql.summary_revenue(), **ten),
        ),
        "revenue_by_order_dept": report(revenue.revenue_by_order_dept, sql.by_order("revenue")),
        "revenue_by_order_dept_filtered": report(
            revenue.revenue_by_order_dept, sql.by_order("revenue", "K7"), dept="K7"
        ),
        "revenue_by_order_and_perform_dept": report(
            revenue.revenue_by_order_and_perform_dept, sql.by_both("revenue")
        ),
        "revenue_by_order_and_perform_dept_filtered": report(
            revenue.revenue_by_order_and_perform_dept, sql.by_both("revenue", "K7"), dept="K7"
        ),
        "detail_revenue": report(
            revenue.detail_revenue,
            sql.items("detail_revenue", base="hft_id2 = 'DT005'"),
            category="DT005",
        ),
        "detail_revenue_order_dept": report(
            revenue.detail_revenue,
            sql.items("detail_revenue", f"{order} = 'K7'", base="hft_id2 = 'DT005'"),
            category="DT005",
            order="K7",
        ),
        "detail_revenue_perform_dept": report(
            revenue.detail_revenue,
            sql.items("detail_revenue", f"{perform} = 'K9'", base="hft_id2 = 'DT001'"),
            category="DT001",
            perform="K9",
        ),
        "detail_revenue_both_depts": report(
            revenue.detail_revenue,
            sql.items(
                "detail_revenue", f"{order} = 'K7' AND {perform} = 'K9'", base="hft_id2 = 'DT009'"
            ),
            category="DT009",
            order="K7",
            perform="K9",
        ),
        "revenue_reconciliation": report(
            revenue.revenue_reconciliation, sql.revenue_check()
        ),
        "revenue_reconciliation_agreeing": report(
            revenue.revenue_reconciliation, sql.revenue_check("comparison_criteria"), status=True
        ),
        "revenue_reconciliation_differing": report(
            revenue.revenue_reconciliation,
            sql.revenue_check("NOT comparison_criteria"),
            status=False,
        ),
        "revenue_reconciliation_row_totals": shown(
            lambda t: row_totals(
                revenue.revenue_reconciliation(t, *ALWAYS), revenue.CATEGORY_TOTALS
            ),
            sql.totals(sql.revenue_check(), **nine),
        ),
        # deductions
        "summary_deduction": report(
            deduction.summary_deduction, sql.pivot(sql.CLASSES, "deduction")
        ),
        "deduction_by_order_dept": report(
            deduction.deduction_by_order_dept, sql.by_order("deduction")
        ),
        "deduction_by_order_dept_filtered": report(
            deduction.deduction_by_order_dept, sql.by_order("deduction", "K7"), dept="K7"
        ),
        "deduction_by_order_and_perform_dept": report(
            deduction.deduction_by_order_and_perform_dept, sql.by_both("deduction")
        ),
        "deduction_by_order_and_perform_dept_filtered": report(
            deduction.deduction_by_order_and_perform_dept,
            sql.by_both("deduction", "K7"),
            dept="K7",
        ),
        "detail_deduction": report(
            deduction.detail_deduction, sql.items("detail_deduction", depts=True)
        ),
        "detail_deduction_order_dept": report(
            deduction.detail_deduction,
            sql.items("detail_deduction", f"{order} = 'K7'", depts=True),
            order="K7",
        ),
        "detail_deduction_perform_dept": report(
            deduction.detail_deduction,
            sql.items("detail_deduction", f"{perform} = 'K9'", depts=True),
            perform="K9",
        ),
        "detail_deduction_both_depts": report(
            deduction.detail_deduction,
            sql.items("detail_deduction", f"{order} = 'K7' AND {perform} = 'K9'", depts=True),
            order="K7",
            perform="K9",
        ),
        # retail, functional food, packages, examinations
        "retail_revenue": report(retail.retail_revenue, sql.retail("revenue")),
        "retail_revenue_row_totals": shown(
            lambda t: row_totals(retail.retail_revenue(t, *ALWAYS), revenue.CATEGORY_TOTALS),
            sql.totals(sql.retail("revenue"), **nine),
        ),
        "retail_revenue_no_cogs": report(retail.retail_revenue, sql.retail_no_cogs(), cogs=False),
        "retail_deduction": report(retail.retail_deduction, sql.retail("deduction")),
        "functional_food_revenue": report(retail.functional_food_revenue, sql.functional_food()),
        "package_cost_by_dept": report(package.package_cost_by_dept, sql.package()),
        "package_cost_by_dept_filtered": report(
            package.package_cost_by_dept,
            sql.package(f"{perform} = 'Không xác định'"),
            dept="Không xác định",
        ),
        "exam_revenue": report(exam.exam_revenue, sql.exam()),
        "exam_revenue_by_patient": report(
            exam.exam_revenue_by_patient, sql.exam(True)
        ),
        # inventory
        "inventory_import": report(inventory.inventory_import, sql.imports()),
        "inventory_import_storages": report(
            inventory.inventory_import, sql.imports("stock_import IN (7, 13)"), storage_ids=[7, 13]
        ),
        "inventory_export": report(inventory.inventory_export, sql.exports()),
        "inventory_export_storages": report(
            inventory.inventory_export, sql.exports("storage_id IN (3, 7)"), storage_ids=[3, 7]
        ),
        "inventory_export_requisition": report(
            inventory.inventory_export_requisition, sql.requisitions()
        ),
        "inventory_export_requisition_storages": report(
            inventory.inventory_export_requisition,
            sql.requisitions("storage_id IN (3, 7)"),
            storage_ids=[3, 7],
        ),
        # sources and sinks
        "landed_parquet_year": Query(
            _landed_parquet, with_views(sql.exports(f"CAST(expdate AS DATE) {year}"))
        ),
        "landed_envelopes_year": Query(
            _landed_envelopes,
            with_views(sql.requisitions(f"CAST(receiptdate AS DATE) {year}")),
        ),
        "envelope_exemption": Query(_envelope_rows, with_views(sql.exemption())),
        "exported_revenue_by_order_dept": Query(_exported, with_views(sql.by_order("revenue"))),
        "appended_departments": Query(
            _appended,
            with_views(
                sql.upsert(
                    "dim_department", "dept", sql.perform_seen("detail_deduction"), "dept_name"
                )
            ),
        ),
        # dimensions
        "storage_pairs": report(members.storage_pairs, sql.PAIRS),
        "upsert_storages": shown(
            lambda t: members.upsert_storages(t, *ALWAYS, _dim_storage(t)), sql.STORAGES
        ),
        "upsert_cashiers": shown(
            lambda t: members.upsert_cashiers(t, *ALWAYS, _dim_cashier(t)),
            sql.upsert(
                "dim_cashier", "name",
                f"SELECT thungan AS name FROM ({sql.members_of_detail('thungan')}) d",
            ),
        ),
        "upsert_methods": shown(
            lambda t: members.upsert_methods(t, *ALWAYS, _dim_method(t)),
            sql.upsert(
                "dim_method", "method",
                "SELECT hfe_payment_method AS method "
                f"FROM ({sql.members_of_detail('hfe_payment_method')}) d",
            ),
        ),
        "upsert_order_departments": shown(
            lambda t: members.upsert_order_departments(t, *ALWAYS, _dim_department(t)),
            sql.upsert("dim_department", "dept", sql.ORDER_SEEN, "dept_name"),
        ),
        "upsert_perform_departments": shown(
            lambda t: members.upsert_perform_departments(
                t, *ALWAYS, _dim_department(t), category="DT005"
            ),
            sql.upsert(
                "dim_department", "dept",
                sql.perform_seen("detail_revenue", "hft_id2 = 'DT005'"), "dept_name",
            ),
        ),
        "department_options": shown(
            lambda t: option_list(_all_departments(t), "dept", "dept_name"),
            "SELECT 'K' || CAST(n_nationkey AS VARCHAR) AS dept, n_name AS dept_name FROM nation",
        ),
        "storage_options": shown(
            lambda t: option_list(members.upsert_storages(t, *ALWAYS, _dim_storage(t)), "storage_id", "storage_name"),
            sql.STORAGES,
        ),
        "stored_storages": Query(_stored_storages, with_views(sql.STORAGES)),
        "landed_two_periods": Query(
            _landed_periods,
            with_views(sql.exports("CAST(expdate AS DATE) BETWEEN '1996-01-01' AND '1997-12-31'")),
        ),
        "snapshot_landed_periods": Query(
            _snapshot_periods,
            with_views(sql.exports("CAST(expdate AS DATE) BETWEEN '1996-01-01' AND '1997-12-31'")),
        ),
        "department_versions": Query(
            _department_versions,
            with_views(
                sql.upsert("dim_department", "dept", sql.perform_seen("detail_deduction"), "dept_name")
            ),
        ),
        "storage_versions": Query(_storage_versions, with_views(sql.STORAGES)),
        "renamed_storages": Query(
            _renamed_storages,
            with_views(
                sql.pairs(
                    "(SELECT * REPLACE (stock_name || ' of ' || (3000 - year(report_date)) AS stock_name) FROM inv_import)"
                )
            ),
        ),
        "envelopes_in_whole_documents": Query(_whole_envelopes, with_views(sql.exemption())),
        "retail_revenue_without_cost_column": Query(
            _retail_without_cost,
            with_views(sql.retail("(SELECT * REPLACE (CAST(0 AS DECIMAL(18,2)) AS cogs_drug_retail) FROM revenue)")),
        ),
        "envelopes_of_many_records": Query(
            _fine_envelopes,
            with_views(
                "SELECT kcb_class, CAST(sum(patpaid + 0.0125) AS DOUBLE) AS patpaid, count(*) AS n FROM ar GROUP BY 1"
            ),
        ),
        "fine_quantities": shown(_fine_details, sql.items("detail_deduction", depts=True, divisor=8)),
        "revenue_without_receivables": shown(_one_sided, sql.revenue_check(receivables="(SELECT * FROM ar WHERE false)")),
        "text_forms": shown(
            _mixed_texts,
            "SELECT l_orderkey, l_linenumber, "
            "CASE WHEN l_linenumber % 4 < 3 THEN strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y') END AS day, "
            "CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey END AS number FROM lineitem",
        ),
        "departments_seen": shown(
            _departments,
            f"SELECT {order} AS dept FROM revenue WHERE {order} IS NOT NULL "
            f"UNION SELECT {perform} FROM revenue WHERE {perform} IS NOT NULL",
        ),
        # presentation
        "package_cost_grand_total": shown(
            lambda t: with_grand_total(
                package.package_cost_by_dept(t, *ALWAYS, ordered=False),
                [*CATEGORIES, "drug_retail", "revenue"],
            ),
            sql.grand_total(
                sql.package(), "kcb_class", [*sql.NAMES, "drug_retail", "revenue"]
            ),
        ),
        "summary_revenue_searched_total": shown(
            _searched_total,
            sql.grand_total(
                sql.summary_revenue(), "kcb_class", [*sql.NAMES, "drug_retail", "revenue"],
                f"contains({_SEARCHED}, 'nội') AND contains({_SEARCHED}, 'bhyt')",
            ),
        ),
        "account_receivables_searched": shown(
            _receivable_text,
            sql.having(
                sql.receivables(), "lower(thungan) = 'cashier_2' AND hfe_payment_method = 'QR'"
            ),
        ),
        "revenue_reconciliation_page": shown(
            lambda t: page(
                revenue.revenue_reconciliation(t, *ALWAYS, ordered=False), "hfe_docno_1", 2, 50
            ),
            f"{sql.revenue_check()} ORDER BY hfe_docno_1 LIMIT 50 OFFSET 100",
        ),
        "revenue_reconciliation_stored_page": Query(
            _stored_page, with_views(f"{sql.revenue_check()} ORDER BY hfe_docno_1 LIMIT 50 OFFSET 100")
        ),
        "detail_revenue_stored_page": Query(
            _stored_page_with_nulls,
            with_views(
                f"SELECT {_ITEM} FROM ({sql.items('detail_revenue', base=_FIFTH)}) i "
                f"ORDER BY {', '.join(f'{c} NULLS LAST' for c in _ITEM_ORDER)} LIMIT 100 OFFSET 1700"
            ),
        ),
        "retail_revenue_page_after": shown(
            lambda t: page_after(retail.retail_revenue(t, *ALWAYS, ordered=False), CLASS_KEYS, _AFTER, 10),
            f"SELECT * FROM ({sql.retail('revenue')}) r WHERE kcb_class > 'Nội trú' OR kcb_class IS NULL "
            "OR (kcb_class = 'Nội trú' AND (price_type > 'Theo yêu cầu' OR price_type IS NULL)) "
            "OR (kcb_class = 'Nội trú' AND price_type = 'Theo yêu cầu' AND (object_type > 'BHYT' OR object_type IS NULL)) "
            "ORDER BY kcb_class NULLS LAST, price_type NULLS LAST, object_type NULLS LAST LIMIT 10",
        ),
        "revenue_reconciliation_page_after": shown(
            lambda t: page_after(
                revenue.revenue_reconciliation(t, *ALWAYS, ordered=False), ["hfe_docno_1"], ["150"], 50
            ),
            f"SELECT * FROM ({sql.revenue_check()}) r WHERE hfe_docno_1 > '150' ORDER BY hfe_docno_1 LIMIT 50",
        ),
        "summary_reconciliation_grand_total": shown(
            lambda t: with_grand_total(
                reconcile.summary_reconciliation(t, *ALWAYS, ordered=False).select("hfe_staff", "thungan", "hfe_payment_method", *reconcile.LEDGER_MEASURES),
                reconcile.LEDGER_MEASURES,
            ),
            sql.grand_total(
                "SELECT CAST(hfe_staff AS VARCHAR) AS hfe_staff, thungan, hfe_payment_method, "
                f"{', '.join(reconcile.LEDGER_MEASURES)} FROM ({sql.reconciliation(False)}) q",
                "hfe_staff", reconcile.LEDGER_MEASURES,
            ),
        ),
        "number_texts": shown(
            _number_texts,
            "SELECT hfe_invoiceno, format('{:t.}', CAST(round_even(half, 0) AS BIGINT)) AS even, "
            "format('{:t.}', CAST(trunc(-half) AS BIGINT)) AS cut, "
            "format('{:t.}', CAST(trunc(coalesce(deposit, 0)) AS BIGINT)) AS deposit_or_zero, "
            "format('{:t,}', CAST(round(half, 0) AS BIGINT)) AS half_up "
            "FROM (SELECT *, CAST(insurance / 8 AS DECIMAL(20,3)) AS half FROM ar) h",
        ),
        "text_parsing": shown(
            _text_parsing,
            "SELECT documentno, orderno, "
            "strftime(TRY_CAST(transaction_date AS TIMESTAMP), '%d-%m-%Y') AS lenient, "
            "strftime(CAST(expdate AS TIMESTAMP), '%d/%m/%Y') AS strict, "
            "CAST(TRY_CAST(docno AS DECIMAL(38,6)) AS BIGINT) AS docno, "
            "coalesce(trim(stock_name), '') = '' AS nameless FROM inv_export",
        ),
    }


QUERIES = _queries()
