"""Facts derived from a star schema of orders, as a stand-in for landed ones.

Nulls, an unknown class code, bad dates, invoices with two methods and amounts that disagree are
there on purpose. Line facts name, per column, the dimension tables the column needs; a reader
joins those of the columns it was asked for. The joins keep every line, with nulls where it has no
partner, so the rows do not depend on the columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soquy.sources.schemas import FACTS, ORDER_FIELDS, PERIOD_COLUMN, PLACE_COLUMN
from soquy.sources.tables import ALL_DAYS, narrow, parse_period

_JOINS = {
    "orders": ("orders", "l_orderkey = o_orderkey"),
    "customer": ("customer", "o_custkey = c_custkey"),
    "supplier": ("supplier", "l_suppkey = s_suppkey"),
    "part": ("part", "l_partkey = p_partkey"),
}

# column: (expression, dimension tables it needs)
_LINE = {
    "hfe_invoiceno": ("CAST(l_orderkey AS STRING)", ""),
    "hfe_docno_1": ("CAST(o_custkey AS STRING)", "orders"),
    "hft_id2": ("'DT00' || CAST(1 + l_partkey % 9 AS STRING)", ""),
    "hft_id": ("CASE WHEN p_size <= 5 THEN 2002 ELSE 1000 + p_size END", "part"),
    "kcb_class": (
        "CASE WHEN l_quantity = 50 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 2 END",
        "",
    ),
    "price_type": ("CASE WHEN l_tax < 0.035 THEN 1 ELSE 2 END", ""),
    "object_type": (
        "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END",
        "",
    ),
    "drug_retail": ("CASE WHEN l_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END", ""),
    "sd_makhoa_taichinh_order": (
        "CASE WHEN c_nationkey <> 24 THEN 'K' || CAST(c_nationkey AS STRING) END",
        "orders customer",
    ),
    "sd_makhoa_taichinh": (
        "CASE WHEN s_nationkey <> 23 THEN 'K' || CAST(s_nationkey AS STRING) END",
        "supplier",
    ),
    "revenue": ("l_extendedprice", ""),
    "cogs_drug_retail": ("l_quantity * 100", ""),
    "cost_in_package": ("l_quantity * 1000", ""),
    "hft_name": ("p_type", "part"),
    "hfe_group": ("p_brand", "part"),
    "hfe_itemid": ("CAST(l_partkey AS STRING)", ""),
    "hfe_desc": ("p_name", "part"),
    "hfe_unit": (
        "CASE p_size % 3 WHEN 1 THEN 'box' WHEN 2 THEN 'unit' END",
        "part",
    ),
    "hfe_quantity": ("l_quantity", ""),
    "hfe_company2_id": ("c_nationkey", "orders customer"),
    "com_name": ("'Company ' || CAST(c_nationkey AS STRING)", "orders customer"),
    "hec_no": ("nullif(c_mktsegment, 'BUILDING')", "orders customer"),
    "hp_name": ("c_name", "orders customer"),
}

_SHIP_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_STORAGE = "CAST(l_suppkey % 20 AS INT)"
_STOCK = {
    "storage_id": (_STORAGE, ""),
    "stock_name": (
        f"CASE WHEN {_STORAGE} <> 3 THEN 'Store ' || CAST({_STORAGE} AS STRING) END",
        "",
    ),
    "documentno": ("CAST(l_orderkey AS STRING)", ""),
    "orderno": ("CAST(l_linenumber AS STRING)", ""),
    "doctype": ("l_linestatus", ""),
    "transaction_date": (f"CASE WHEN l_linenumber = 7 THEN 'bad' ELSE {_SHIP_DAY} END", ""),
    "receiptdate": (f"CASE WHEN l_returnflag <> 'N' THEN {_SHIP_DAY} END", ""),
    "expdate": (_SHIP_DAY, ""),
    "docno": (
        "CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_orderkey AS STRING) || '.0' END",
        "",
    ),
    "invoiceno": ("CASE WHEN l_linenumber <> 2 THEN CAST(l_orderkey AS STRING) END", ""),
    "mp_product_id": ("CAST(l_partkey AS STRING)", ""),
    "mp_name": ("p_name", "part"),
    "mp_producttype": ("p_type", "part"),
    "total_qty": ("l_quantity", ""),
    "unitprice": ("p_retailprice", "part"),
    "total_amount": ("l_extendedprice", ""),
}
_STOCK["saleprice"] = _STOCK["total_amount"]
_IMPORT = {
    **_STOCK,
    "stock_import": _STOCK["storage_id"],
    "invoicedate": _STOCK["receiptdate"],
    "signeddate": _STOCK["transaction_date"],
}

_PLACED = {PERIOD_COLUMN: ("CAST(l_shipdate AS DATE)", ""), PLACE_COLUMN: ("l_orderkey * 8 + l_linenumber", "")}

# fact: (columns, row condition)
_LINE_FACTS = {
    "revenue": (_LINE, None),
    "detail_revenue": (_LINE, None),
    "exam_revenue": (_LINE, None),
    "deduction": (_LINE, "l_returnflag = 'R'"),
    "detail_deduction": (_LINE, "l_returnflag = 'R'"),
    "inv_import": (_IMPORT, None),
    "inv_export": (_STOCK, None),
    "inv_export_pdt": (_STOCK, None),
}

_AR = """
SELECT CAST(o_orderkey AS STRING) AS hfe_invoiceno, CAST(o_custkey AS STRING) AS hfe_docno_1,
  o_orderkey AS k, CAST(o_orderkey % 8 AS INT) AS hfe_staff,
  'Cashier_' || CAST(o_orderkey % 8 AS STRING) AS thungan,
  CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN 'TM' WHEN '2' THEN 'CK' WHEN '3' THEN 'QR' WHEN '4' THEN 'TH' ELSE 'RC'
  END AS hfe_payment_method,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS kcb_class,
  CAST(1 + o_orderkey % 2 AS INT) AS price_type, CAST(1 + o_orderkey % 3 AS INT) AS object_type,
  CAST(1 + o_orderkey % 4 AS INT) AS receipt_object,
  CASE WHEN o_custkey % 50 <> 0 THEN 'C' || CAST(o_custkey AS STRING) END AS hd_cardno,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS hfe_date,
  CAST(amt + if(o_custkey % 3 = 0, 500, 0) AS DECIMAL(18,2)) AS revenue,
  CAST(floor(CAST(amt AS DOUBLE) / 2) AS DECIMAL(18,2)) AS patpaid,
  CAST(if(o_orderkey % 7 = 0, 100, 0) AS DECIMAL(18,2)) AS freeamount,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(CAST(amt AS DOUBLE) / 4)
            WHEN o_orderkey % 29 = 1 AND o_orderkey % 8 = 6 THEN NULL
            ELSE 0 END AS DECIMAL(18,2)) AS deposit,
  CAST(floor(CAST(amt AS DOUBLE) / 3) AS DECIMAL(18,2)) AS insurance,
  CAST(if(o_orderkey % 5 = 0, 250, 0) AS DECIMAL(18,2)) AS bqp, ded
FROM {orders} JOIN {inv} ON o_orderkey = inv_key
"""

_RECEIPT = """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan, hfe_payment_method,
  CASE WHEN k % 31 = 0 AND hfe_staff < 2 THEN NULL
       WHEN deposit > 0 THEN deposit ELSE CAST(0 AS DECIMAL(18,2)) END AS hfe_deposit,
  CAST(patpaid - freeamount - if(deposit > 0, deposit, 0)
    + if(k % 97 = 0 AND hfe_staff < 4, 1000, 0) AS DECIMAL(18,2)) AS hfe_payment
FROM {ar}
WHERE hfe_payment_method <> 'RC' AND (deposit = 0 OR deposit < patpaid - freeamount)
"""

_DEPOSIT = """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan,
  if(k % 11 = 0, 'TM', hfe_payment_method) AS hfe_payment_method, deposit AS hfe_amount
FROM {ar} WHERE deposit > 0
"""

# A receivable may have several refunds: all are tried on one pass over it.
_REFUND = """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan, hfe_payment_method,
  refund_type, hfe_payment_calc_mode, hfe_amount, 'Patient ' || hfe_docno_1 AS hp_name,
  CASE WHEN k % 5 <> 0 THEN 'reason ' || CAST(k % 3 AS STRING) END AS hfe_desc
FROM {ar} LATERAL VIEW inline(array(
  struct(1, CAST(NULL AS STRING), CAST(ded AS DECIMAL(18,2)), ded > 0 AND deposit IS NOT NULL),
  struct(2, CAST(NULL AS STRING), CAST(deposit - patpaid + freeamount AS DECIMAL(18,2)),
    deposit > 0 AND deposit >= patpaid - freeamount AND hfe_payment_method <> 'RC'),
  struct(2, 'M', CAST(300 AS DECIMAL(18,2)), k % 23 = 0),
  struct(2, CAST(NULL AS STRING), CAST(75 AS DECIMAL(18,2)), k % 41 = 0 AND hfe_staff = 5),
  struct(3, CAST(NULL AS STRING), CAST(200 AS DECIMAL(18,2)), k % 13 = 0),
  struct(4, CAST(NULL AS STRING), CAST(150 AS DECIMAL(18,2)), k % 17 = 0),
  struct(5, CAST(NULL AS STRING), CAST(50 AS DECIMAL(18,2)), k % 19 = 0)
)) r AS refund_type, hfe_payment_calc_mode, hfe_amount, paid
WHERE paid
"""

_CASH_FACTS = {"receipt": _RECEIPT, "deposit": _DEPOSIT, "refund": _REFUND}


class StarTables:
    """Facts over ``<root>/<table>.parquet``. The period is the day of shipment for lines and the
    day of the order for receivables and cash."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        self._ar: dict[tuple[str, str], DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._read[name]

    def fact(
        self, name, from_date, to_date, category=None, storage_ids=None, columns=None, placed=False
    ) -> DataFrame:
        """``placed`` is for line facts: the day of shipment, and the place by order and line."""
        names = [*(columns or FACTS[name].names), *(_PLACED if placed else ())]
        if name in _LINE_FACTS:
            df = self._lines(name, from_date, to_date, names, category, storage_ids)
        else:
            ar = self._receivables(from_date, to_date)
            df = self.spark.sql(_CASH_FACTS[name], ar=ar) if name in _CASH_FACTS else ar
        kinds = {f.name: f.dataType for f in FACTS[name]}
        return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in names))

    def _lines(
        self,
        name: str,
        from_date: str,
        to_date: str,
        names: Iterable[str],
        category: str | None,
        storage_ids: Iterable[int] | None,
    ) -> DataFrame:
        defined, condition = _LINE_FACTS[name]
        defined = {**defined, **_PLACED}
        wanted = {*names, *(["hft_id2"] if category else [])}
        if storage_ids:
            wanted.add("stock_import" if name == "inv_import" else "storage_id")
        df = _by_day(self.table("lineitem"), "l_shipdate", from_date, to_date)
        if condition:
            df = df.where(condition)
        needed = {t for c in wanted for t in defined.get(c, ("", ""))[1].split()}
        for table, on in (_JOINS[t] for t in _JOINS if t in needed):
            df = df.join(self.table(table), F.expr(on), "left")
        columns = []
        for field in [*FACTS[name].fields, *ORDER_FIELDS]:
            if field.name in wanted:
                expression = defined[field.name][0] if field.name in defined else "'-'"
                kind = field.dataType.simpleString()
                columns.append(f"CAST({expression} AS {kind}) AS {field.name}")
        return narrow(df.selectExpr(*columns), name, category, storage_ids)

    def _receivables(self, from_date: str, to_date: str) -> DataFrame:
        period = (from_date, to_date)
        if period not in self._ar:
            orders = _by_day(self.table("orders"), "o_orderdate", *period)
            self._ar[period] = self.spark.sql(_AR, orders=orders, inv=self._invoices)
        return self._ar[period]

    @cached_property
    def _invoices(self) -> DataFrame:
        # Prices are whole cents; the lines of one invoice add up well within a bigint.
        cents = "CAST(round(l_extendedprice * 100) AS BIGINT)"
        sums = [f"sum({cents}) AS amt", f"sum(if(l_returnflag = 'R', {cents}, 0L)) AS ded"]
        grouped = self.table("lineitem").groupBy("l_orderkey").agg(*map(F.expr, sums))
        money = "CAST(CAST({0} AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2)) AS {0}"
        return grouped.selectExpr(
            "l_orderkey AS inv_key", money.format("amt"), money.format("ded")
        )


def _by_day(df: DataFrame, column: str, from_date: str, to_date: str) -> DataFrame:
    if from_date == to_date == ALL_DAYS:
        return df
    first, last = parse_period(from_date, to_date)
    after = last + dt.timedelta(days=1)
    return df.where(f"{column} >= DATE'{first}' AND {column} < DATE'{after}'")
