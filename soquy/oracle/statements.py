"""One SQL statement per query, over the fact views."""

from __future__ import annotations

CODES = ["DT001", "DT002", "DT003", "DT004", "DT005", "DT006", "DT007", "DT008", "DT009"]
NAMES = [
    "tien_kham", "tien_giuong", "tien_cls", "tien_pttt", "tien_thuoc", "tien_vattu",
    "tien_thuoc_pm", "tien_vattu_pm", "tien_khac",
]
CLASSES = "kcb_class, price_type, object_type"
LABELS = [
    ("kcb_class", "Ngoại trú", "Nội trú"),
    ("price_type", "Thông thường", "Theo yêu cầu"),
    ("object_type", "BHYT", "Dịch vụ"),
]
DECODED = ", ".join(
    f"CASE {c} WHEN 1 THEN '{one}' WHEN 2 THEN '{two}' ELSE CAST({c} AS VARCHAR) END AS {c}"
    for c, one, two in LABELS
)


def dbl(columns, inner="coalesce({0}, 0)") -> str:
    return ", ".join(f"CAST({inner.format(c)} AS DOUBLE) AS {c}" for c in columns)


def grouped(keys: str, fact: str, value: str, name: str, where: str = "true") -> str:
    """A pandas-like grouped sum: rows with a null key are left out."""
    kept = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return (
        f"(SELECT {keys}, coalesce(sum({value}), 0) AS {name} FROM {fact} "
        f"WHERE ({where}) AND {kept} GROUP BY {keys})"
    )


def chain(keys: str, parts: list[str]) -> str:
    """Full joins of tables that are unique by key."""
    text = f"{parts[0]} p0"
    for i, part in enumerate(parts[1:], 1):
        text += f"\n  FULL JOIN {part} p{i} USING ({keys})"
    return text


def pivot_parts(keys: str, fact: str, value: str = "revenue", where: str = "true") -> list[str]:
    return [
        grouped(keys, fact, value, name, f"({where}) AND hft_id2 = '{code}'")
        for code, name in zip(CODES, NAMES)
    ]


def pivot(keys: str, fact: str, retail=True, where="true", extra=(), names=(), filtered="true"):
    """The category cascade: one grouped table per code, retail and more beside it."""
    parts = pivot_parts(keys, fact, where="drug_retail = 'N'" if retail else where)
    if retail:
        parts.append(grouped(keys, fact, "revenue", "drug_retail", "drug_retail = 'Y'"))
    columns = [*NAMES, *(["drug_retail"] if retail else []), *names]
    others = [k for k in keys.split(", ") if k not in CLASSES.split(", ")]
    return (
        f"SELECT {', '.join([DECODED, *others])}, {dbl(columns)}\n"
        f"FROM {chain(keys, [*parts, *extra])} WHERE {filtered}"
    )


# ---- reconciliation -------------------------------------------------------------------------

BILLED, PREPAID = "deposit = 0", "deposit > 0"
NOT_RC = "hfe_payment_method IS DISTINCT FROM 'RC'"
PAID = "coalesce(patpaid,0) - coalesce(freeamount,0)"
OTHER = "coalesce(revenue,0) - coalesce(patpaid,0)"
LEDGER = [
    ("invoice_receipt_amount", "receipt", "hfe_payment", "hfe_deposit = 0"),
    ("invoice_advance_payment_amount", "receipt", "hfe_payment", "hfe_deposit IS DISTINCT FROM 0"),
    ("deposit_amount", "deposit", "hfe_amount", "true"),
    ("refund_deduction_amount", "refund", "hfe_amount", "refund_type = 1"),
    (
        "refund_after_payment_amount", "refund", "hfe_amount",
        "refund_type = 2 AND hfe_payment_calc_mode IS DISTINCT FROM 'M'",
    ),
    ("return_amount", "refund", "hfe_amount", "refund_type = 3"),
    ("other_paid_amount", "refund", "hfe_amount", "refund_type = 4"),
    (
        "adjust_paid_amount", "refund", "hfe_amount",
        "refund_type = 5 OR (refund_type = 2 AND hfe_payment_calc_mode = 'M')",
    ),
    ("revenue_by_receipt_patpaid", "ar", PAID, f"{BILLED} AND {NOT_RC}"),
    ("revenue_by_receipt_otherpaid", "ar", OTHER, f"{BILLED} AND {NOT_RC}"),
    ("revenue_exemption_by_receipt_patpaid", "ar", "freeamount", f"{BILLED} AND {NOT_RC}"),
    ("revenue_by_refund_patpaid", "ar", PAID, f"{PREPAID} AND {NOT_RC}"),
    ("revenue_by_refund_otherpaid", "ar", OTHER, f"{PREPAID} AND {NOT_RC}"),
    ("revenue_exemption_by_refund_patpaid", "ar", "freeamount", f"{PREPAID} AND {NOT_RC}"),
    ("revenue_by_adjust_patpaid", "ar", PAID, "hfe_payment_method = 'RC'"),
    ("revenue_by_adjust_otherpaid", "ar", OTHER, "hfe_payment_method = 'RC'"),
    ("advance_payment", "ar", "deposit", f"{PREPAID} AND {NOT_RC}"),
]
LEDGER_NAMES = [m[0] for m in LEDGER]


def reconciliation(detail: bool, where: str = "true", mode: str = "compat") -> str:
    """Cash cascade at the invoice, deductions joined at their coarser key, then summed."""
    if detail:
        fine, coarse = "hfe_docno_1, inv_no, thungan, hfe_payment_method", "hfe_docno_1, inv_no"
        keys, tolerance = "hfe_docno_1, thungan, hfe_payment_method", 100
    else:
        fine, coarse = "inv_no, hfe_staff, thungan, hfe_payment_method", "inv_no"
        keys, tolerance = "hfe_staff, thungan, hfe_payment_method", 300

    def keyed(fact):
        return f"(SELECT *, coalesce(CAST(hfe_invoiceno AS VARCHAR), 'None') AS inv_no FROM {fact})"

    parts = [grouped(fine, keyed(fact), value, name, cond) for name, fact, value, cond in LEDGER]
    deduction = grouped(coarse, keyed("deduction"), "revenue", "deduction")
    cash = f"SELECT {fine}, {', '.join(LEDGER_NAMES)} FROM {chain(fine, parts)}"
    if mode == "exact":
        rest = ", ".join(k for k in fine.split(", ") if k not in coarse.split(", "))
        order = f"PARTITION BY {coarse} ORDER BY {rest}"
        cash = f"SELECT *, row_number() OVER ({order}) AS rn FROM ({cash})"
        match = " AND ".join([f"cash.{k} = ded.{k}" for k in coarse.split(", ")] + ["rn = 1"])
        joined = f"({cash}) cash FULL JOIN {deduction} ded ON {match}"
    else:
        joined = f"({cash}) cash FULL JOIN {deduction} ded USING ({coarse})"
    group = ", ".join(f"cash.{k}" if mode == "exact" else k for k in keys.split(", "))
    if detail and mode == "exact":
        group = group.replace(
            "cash.hfe_docno_1", "coalesce(cash.hfe_docno_1, ded.hfe_docno_1) AS hfe_docno_1"
        )
    names = [*LEDGER_NAMES, "deduction"]
    sums = ", ".join(f"coalesce(sum({n}), 0) AS {n}" for n in names)
    c1 = "invoice_receipt_amount = revenue_by_receipt_patpaid"
    c2 = "refund_deduction_amount = deduction"
    c3 = (
        "abs((refund_after_payment_amount - invoice_advance_payment_amount) - "
        f"(advance_payment - revenue_by_refund_patpaid)) <= {tolerance}"
    )
    return (
        f"SELECT {keys}, {dbl(names)}, {c1} AS comparison_criteria_1, "
        f"{c2} AS comparison_criteria_2, {c3} AS comparison_criteria_3, "
        f"({c1}) AND ({c2}) AND ({c3}) AS comparison_criteria_4\n"
        f"FROM (SELECT {group}, {sums} FROM {joined} GROUP BY ALL) g WHERE {where}"
    )


def status_is(value: bool) -> str:
    return f"comparison_criteria_4 = {str(value).lower()}"


def having(statement: str, where: str) -> str:
    return f"SELECT * FROM ({statement}) f WHERE {where}"


def totals(statement: str, **sums: list[str]) -> str:
    added = ", ".join(
        f"{' + '.join(f'coalesce({c}, 0)' for c in cs)} AS {name}" for name, cs in sums.items()
    )
    return f"SELECT *, {added} FROM ({statement}) t"


LEDGER_TOTALS = dict(
    total_receipts=LEDGER_NAMES[0:3],
    total_payments=LEDGER_NAMES[3:8],
    total_revenue=LEDGER_NAMES[8:16],
)


def dotted(column: str) -> str:
    return f"format('{{:t.}}', CAST(round_even({column}, 0) AS BIGINT)) AS {column}"


def printed() -> str:
    names = [*LEDGER_NAMES, "deduction"]
    rows = reconciliation(False)
    sums = ", ".join(f"coalesce(sum({n}), 0)" for n in names)
    texts = ", ".join(map(dotted, names))
    return (
        f"SELECT thungan, hfe_payment_method, {texts} FROM ("
        f"SELECT thungan, hfe_payment_method, {', '.join(names)} FROM ({rows}) a UNION ALL "
        f"SELECT 'Tổng cộng', NULL, {sums} FROM ({rows}) b) u"
    )


# ---- receivables ----------------------------------------------------------------------------


def exemption() -> str:
    fine = "hfe_docno_1, hfe_invoiceno, thungan, hfe_payment_method"
    chosen = [
        (n, f, v, c.replace(f" AND {NOT_RC}", ""))
        for n, f, v, c in LEDGER
        if f == "ar" and "adjust" not in n
    ]
    parts = [grouped(fine, fact, value, name, cond) for name, fact, value, cond in chosen]
    names = [m[0] for m in chosen]
    return (
        "SELECT hfe_docno_1, thungan, hfe_payment_method, "
        f"{dbl(names, 'coalesce(sum({0}), 0)')} FROM {chain(fine, parts)} "
        "WHERE revenue_exemption_by_receipt_patpaid > 0 "
        "OR revenue_exemption_by_refund_patpaid > 0 GROUP BY ALL"
    )


EXEMPTION_TOTAL = [m[0] for m in LEDGER if m[1] == "ar" and "adjust" not in m[0]][:6]
RECEIVABLES = ["insurance_hn_receivable", "insurance_bqp_receivable", "cuctaichinh_bqp_receivable"]


def other_paid(where: str = "true") -> str:
    keys = "hfe_docno_1, hp_name, hfe_invoiceno, thungan, hfe_payment_method, hfe_desc"
    inner = grouped(keys, "refund", "hfe_amount", "other_paid_amount", "refund_type = 4")
    return f"SELECT {keys}, {dbl(['other_paid_amount'])} FROM {inner} g WHERE {where}"


def receivables(ar: str = "ar") -> str:
    keys = "hfe_docno_1, hfe_invoiceno, thungan, hfe_payment_method, hd_cardno, hfe_date"
    hn, bqp, ctc = RECEIVABLES
    both = "coalesce(insurance, 0) + coalesce(bqp, 0)"
    a = grouped(keys, ar, "bqp", ctc, "receipt_object = 1")
    b = (
        f"(SELECT {keys}, coalesce(sum({both}), 0) AS {ctc} FROM {ar} "
        f"WHERE receipt_object = 3 GROUP BY {keys})"
    )
    h = grouped(keys, ar, "insurance", hn, "receipt_object = 1")
    q = grouped(keys, ar, both, bqp, "receipt_object = 2")
    union = f"(SELECT * FROM {a} a UNION ALL SELECT * FROM {b} b)"
    return (
        "SELECT hfe_docno_1, thungan, hfe_payment_method, hd_cardno, "
        "strftime(CAST(hfe_date AS DATE), '%d/%m/%Y') AS hfe_date, "
        "CAST(CAST(hfe_date AS DATE) AS VARCHAR) AS receivable_date, "
        f"{dbl(RECEIVABLES, 'coalesce(sum({0}), 0)')} "
        f"FROM {chain(keys, [union, h, q])} GROUP BY ALL"
    )


SHARED_AR = (
    "(SELECT * FROM ar UNION ALL "
    "SELECT * REPLACE (3 AS receipt_object) FROM ar WHERE receipt_object = 1 AND freeamount > 0)"
)

# ---- revenue, deduction, retail, package, exam ----------------------------------------------


def summary_revenue() -> str:
    invoiced = grouped(CLASSES, "ar", "revenue", "revenue")
    return pivot(CLASSES, "revenue", extra=[invoiced], names=["revenue"])


ORDER, PERFORM = "sd_makhoa_taichinh_order", "sd_makhoa_taichinh"


def by_order(fact: str, dept: str = "") -> str:
    where = f"{ORDER} = '{dept}'" if dept else "true"
    return pivot(f"{CLASSES}, {ORDER}", fact, filtered=where)


def by_both(fact: str, dept: str = "") -> str:
    where = f"{ORDER} = '{dept}'" if dept else "true"
    return pivot(f"{CLASSES}, {ORDER}, {PERFORM}", fact, filtered=where)


def items(
    fact: str, where: str = "true", depts: bool = False, base: str = "true", divisor: int = 1
) -> str:
    """Ten keys first, then the department filter, then, unless wanted, the departments away."""
    keys = f"{CLASSES}, hft_name, hfe_group, hfe_itemid, hfe_desc, hfe_unit"
    both = f"{ORDER}, {PERFORM}"
    amounts = ["hfe_quantity", "revenue"]
    share = "{0}" if divisor == 1 else f"CAST({{0}} / {divisor} AS DECIMAL(28,6))"
    sums = ", ".join(f"coalesce(sum({share.format(a)}), 0) AS {a}" for a in amounts)
    rows = f"(SELECT {keys}, {both}, {sums} FROM {fact} WHERE {base} GROUP BY ALL)"
    shown = keys.replace(CLASSES, DECODED) + (f", {both}" if depts else "")
    return f"SELECT {shown}, {dbl(amounts, 'sum({0})')} FROM {rows} r WHERE {where} GROUP BY ALL"


def revenue_check(where: str = "true", receivables: str = "ar") -> str:
    def keyed(fact):
        return f"(SELECT *, coalesce(CAST(hfe_invoiceno AS VARCHAR), 'None') AS inv_no FROM {fact})"

    keys = "inv_no, hfe_docno_1"
    parts = pivot_parts(keys, keyed("revenue"))
    parts.append(grouped(keys, keyed("revenue"), "revenue", "revenue_by_detail"))
    parts.append(grouped(keys, keyed(receivables), "revenue", "revenue"))
    names = [*NAMES, "revenue_by_detail", "revenue"]
    sums = ", ".join(f"coalesce(sum({n}), 0) AS {n}" for n in names)
    return having(
        f"SELECT hfe_docno_1, {dbl(names)}, abs(revenue_by_detail - revenue) <= 100 "
        f"AS comparison_criteria FROM (SELECT hfe_docno_1, {sums} "
        f"FROM {chain(keys, parts)} GROUP BY hfe_docno_1) g",
        where,
    )


def retail(fact: str) -> str:
    """Cost keeps null classes, the pivot does not; unmatched cells stay null."""
    rows = f"(SELECT * FROM {fact} WHERE drug_retail = 'Y')"
    cogs = (
        f"(SELECT {CLASSES}, coalesce(sum(cogs_drug_retail), 0) AS cogs_drug_retail "
        f"FROM {rows} GROUP BY {CLASSES})"
    )
    pivoted = ", ".join(f"coalesce({n}, 0) AS {n}" for n in NAMES)
    cells = f"(SELECT {CLASSES}, {pivoted} FROM {chain(CLASSES, pivot_parts(CLASSES, rows))})"
    return (
        f"SELECT {DECODED}, 'Y' AS drug_retail, {dbl(['cogs_drug_retail', *NAMES], '{0}')} "
        f"FROM {cogs} c FULL JOIN {cells} v USING ({CLASSES})"
    )


def retail_no_cogs() -> str:
    keys = f"{CLASSES}, drug_retail"
    return pivot(keys, "revenue", retail=False, filtered="drug_retail = 'Y'")


def functional_food() -> str:
    keys = f"{CLASSES}, drug_retail, hft_id"
    return pivot(keys, "revenue", retail=False, filtered="drug_retail = 'Y' AND hft_id = 2002")


def package(where: str = "true") -> str:
    """Null-safe joins of one grouped table per code to all groups."""
    rows = f"(SELECT * REPLACE (coalesce({PERFORM}, 'Không xác định') AS {PERFORM}) FROM revenue)"
    keys = f"{CLASSES}, {PERFORM}"
    text = f"(SELECT {keys}, sum(revenue) AS revenue FROM {rows} GROUP BY {keys}) g"
    parts = [
        (name, "cost_in_package", f"drug_retail = 'N' AND hft_id2 = '{code}'")
        for code, name in zip(CODES, NAMES)
    ] + [("drug_retail", "revenue", "drug_retail = 'Y'")]
    for i, (name, value, cond) in enumerate(parts):
        on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p{i}.{k}" for k in keys.split(", "))
        text += (
            f"\n  LEFT JOIN (SELECT {keys}, sum({value}) AS {name} FROM {rows} WHERE {cond} "
            f"GROUP BY {keys}) p{i} ON {on}"
        )
    shown = ", ".join(f"g.{k}" for k in keys.split(", "))
    names = [*NAMES, "drug_retail"]
    return (
        f"SELECT {DECODED}, {PERFORM}, {dbl([*names, 'revenue'])} FROM "
        f"(SELECT {shown}, g.revenue, {', '.join(names)} FROM {text}) z WHERE {where}"
    )


def exam(patient: bool = False) -> str:
    rows = "(SELECT * REPLACE (coalesce(hec_no, 'NULL') AS hec_no) FROM exam_revenue)"
    keys = f"{CLASSES}, hfe_company2_id, com_name, hec_no"
    return pivot(keys + (", hfe_docno_1, hp_name" if patient else ""), rows)


# ---- inventory and dimensions ---------------------------------------------------------------


def movements(
    fact: str, dates: list[str], numbers: list[str], money: list[str], where: str = "true"
) -> str:
    texts = [f"strftime(TRY_CAST({c} AS TIMESTAMP), '%d-%m-%Y') AS {c}" for c in dates]
    whole = [
        f"CASE WHEN TRY_CAST({c} AS DECIMAL(38,6)) = floor(TRY_CAST({c} AS DECIMAL(38,6))) "
        f"THEN CAST(TRY_CAST({c} AS DECIMAL(38,6)) AS BIGINT) END AS {c}"
        for c in numbers
    ]
    amounts = [f"CAST({c} AS DOUBLE) AS {c}" for c in money]
    return (
        f"SELECT * EXCLUDE (report_date) REPLACE ({', '.join(texts + whole + amounts)}) "
        f"FROM {fact} WHERE {where}"
    )


def imports(where="true") -> str:
    dates = ["transaction_date", "invoicedate", "signeddate", "expdate"]
    return movements("inv_import", dates, [], ["total_qty", "unitprice", "total_amount"], where)


def exports(where="true") -> str:
    dates = ["transaction_date", "receiptdate", "expdate"]
    amounts = ["total_qty", "unitprice", "saleprice"]
    return movements("inv_export", dates, ["docno", "invoiceno"], amounts, where)


def requisitions(where="true") -> str:
    dates = ["transaction_date", "receiptdate"]
    amounts = ["total_qty", "unitprice", "saleprice"]
    return movements("inv_export_pdt", dates, ["docno", "invoiceno"], amounts, where)


_LAST = "report_date, CAST(documentno AS BIGINT), CAST(orderno AS BIGINT)"


def pairs(rows: str = "inv_import") -> str:
    """The name in the last row of each storage."""
    return (
        f"SELECT stock_import AS storage_id, last(stock_name ORDER BY {_LAST}) AS storage_name FROM {rows} "
        "WHERE stock_import IS NOT NULL AND stock_name IS NOT NULL GROUP BY stock_import"
    )


PAIRS = pairs()
STORAGES = f"""
SELECT storage_id, CASE
    WHEN NOT EXISTS (SELECT 1 FROM dim_storage d WHERE d.storage_id = u.storage_id) THEN new
    WHEN (old IS NULL OR trim(old) = '') AND new <> '' THEN new
    ELSE old END AS storage_name
FROM (SELECT storage_id, d.storage_name AS old, n.storage_name AS new
      FROM dim_storage d FULL JOIN ({PAIRS}) n USING (storage_id)) u"""


def members_of_detail(column: str) -> str:
    return f"SELECT DISTINCT {column} FROM ({reconciliation(True)}) r WHERE {column} IS NOT NULL"


def upsert(dim: str, key: str, seen: str, others: str = "") -> str:
    """Stored members, and each seen one that is not among them."""
    rest = f", {others}" if others else ""
    padding = f", NULL AS {others}" if others else ""
    return (
        f"SELECT {key}{rest} FROM {dim} UNION ALL SELECT m.{key}{padding} FROM ({seen}) m "
        f"WHERE m.{key} NOT IN (SELECT {key} FROM {dim})"
    )


ORDER_SEEN = (
    f"SELECT DISTINCT {ORDER} AS dept FROM ({by_order('revenue')}) r WHERE ("
    + " + ".join(f"CASE WHEN {n} <> 0 THEN 1 ELSE 0 END" for n in NAMES)
    + ") > 0"
)


def perform_seen(fact: str, base: str = "true") -> str:
    return f"SELECT DISTINCT {PERFORM} AS dept FROM {fact} WHERE {PERFORM} IS NOT NULL AND {base}"


# ---- presentation ---------------------------------------------------------------------------


def grand_total(statement: str, first: str, names: list[str], where: str = "true") -> str:
    sums = ", ".join(f"coalesce(sum({n}), 0) AS {n}" for n in names)
    rows = f"SELECT * FROM ({statement}) q WHERE {where}"
    return (
        f"{rows} UNION ALL BY NAME SELECT 'Tổng cộng' AS {first}, {sums} FROM ({rows}) s"
    )
