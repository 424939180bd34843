"""Small made-up facts with every awkward value, for Spark and for DuckDB alike."""

import random
from decimal import Decimal

import duckdb

from soquy.sources.schemas import DIMENSIONS, FACTS

PERIOD = ("2024-01-01", "2024-12-31")

# Values a column takes; None is among nearly all of them.
POOLS = {
    "hfe_invoiceno": ["1", "2", "3", "4", "5", None, None],
    "hfe_docno_1": ["D1", "D2", "D3", None],
    "hfe_staff": [1, 2, None],
    "thungan": ["An", "Binh", None],
    "hfe_payment_method": ["TM", "CK", "RC", None],
    "refund_type": [1, 2, 3, 4, 5, 6, None],
    "hfe_payment_calc_mode": ["M", "X", None],
    "hfe_deposit": [Decimal("0.00"), Decimal("10.00"), Decimal("-5.00"), None],
    "deposit": [Decimal("0.00"), Decimal("40.00"), Decimal("-7.50"), None],
    "receipt_object": [1, 2, 3, 4, None],
    "hd_cardno": ["C1", "C2", None],
    "hfe_date": ["2024-01-25", "2024-02-03", None],
    "kcb_class": [1, 2, 3, None],
    "price_type": [1, 2, None],
    "object_type": [1, 2, 3, None],
    "hft_id2": [f"DT00{i}" for i in range(1, 10)] + ["DT010", None],
    "hft_id": [2002, 1001, None],
    "drug_retail": ["Y", "N", "N", "?", None],
    "sd_makhoa_taichinh_order": ["K1", "K2", None],
    "sd_makhoa_taichinh": ["K1", "K3", None],
    "hp_name": ["P1", "P2", None],
    "hfe_desc": ["why", None],
    "hft_name": ["lab", "ward"],
    "hfe_group": ["g", None],
    "hfe_itemid": ["7", None],
    "hfe_unit": ["box", None],
    "hfe_company2_id": [1, 2, None],
    "com_name": ["Acme", None],
    "hec_no": ["H1", None],
    "stock_import": [7, 53, None],
    "storage_id": [7, 53, None],
    "stock_name": ["Main", " ", None],
    "docno": ["12", "12.0", "12.7", "12x", "", "-3", None],
    "invoiceno": ["12", "12.0", "12.7", "12x", "", "-3", None],
    **dict.fromkeys(
        ["transaction_date", "receiptdate", "invoicedate", "signeddate", "expdate"],
        ["2024-03-09", "2024-03-09 10:20:30", "bad", "2024-02-31", "", None],
    ),
}
MONEY = [Decimal(c) / 100 for c in (0, 1, 1050, 99999, -2500, 123456789)] + [None]


def make(name, seed, rows=60, hot=None):
    """Rows of a fact. ``hot`` fixes columns of one third of the rows."""
    rng = random.Random(f"{name}-{seed}")
    fields = FACTS[name].fields
    made = []
    for i in range(rows):
        row = {}
        for f in fields:
            money = f.dataType.simpleString().startswith("decimal")
            row[f.name] = rng.choice(POOLS.get(f.name, MONEY if money else ["-", None]))
            if f.name == "stock_import" and f.dataType.simpleString() == "string":
                row[f.name] = "-"
        if hot and i % 3 == 0:
            row.update({k: v for k, v in hot.items() if k in row})
        made.append(tuple(row.values()))
    return made


def spark_frames(spark, facts):
    return {n: spark.createDataFrame(rows, FACTS[n]) for n, rows in facts.items()}


def duck(facts, dims=None):
    """The same rows as DuckDB tables; a fact not given is an empty table."""
    con = duckdb.connect()
    schemas = {**FACTS, **DIMENSIONS}
    tables = {**{n: [] for n in schemas}, **facts, **(dims or {})}
    for name, rows in tables.items():
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString().replace('string', 'varchar')}"
            for f in schemas[name].fields
        )
        con.execute(f"CREATE TABLE {name} ({columns}, report_date DATE)")
        marks = ", ".join("?" for _ in schemas[name].fields)
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({marks}, NULL)", rows)
    return con
