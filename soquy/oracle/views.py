"""The stand-in facts as SQL views over the star tables."""

# Order matters: a view may read the ones before it.
VIEWS = {
    "inv": """
SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt,
  sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2))
      ELSE CAST(0 AS DECIMAL(18,2)) END) AS ded
FROM lineitem GROUP BY l_orderkey""",
    "line": """
SELECT CAST(l_orderkey AS VARCHAR) AS hfe_invoiceno, CAST(o_custkey AS VARCHAR) AS hfe_docno_1,
  'DT00' || CAST(1 + l_partkey % 9 AS VARCHAR) AS hft_id2,
  CASE WHEN p_size <= 5 THEN 2002 ELSE 1000 + p_size END AS hft_id,
  CASE WHEN l_quantity = 50 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS kcb_class,
  CASE WHEN l_tax < 0.035 THEN 1 ELSE 2 END AS price_type,
  CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END AS object_type,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END AS drug_retail,
  CASE WHEN c_nationkey = 24 THEN NULL ELSE 'K' || CAST(c_nationkey AS VARCHAR) END
    AS sd_makhoa_taichinh_order,
  CASE WHEN s_nationkey = 23 THEN NULL ELSE 'K' || CAST(s_nationkey AS VARCHAR) END
    AS sd_makhoa_taichinh,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue,
  CAST(l_quantity * 100 AS DECIMAL(18,2)) AS cogs_drug_retail,
  CAST(l_quantity * 1000 AS DECIMAL(18,2)) AS cost_in_package,
  p_type AS hft_name, p_brand AS hfe_group, CAST(p_partkey AS VARCHAR) AS hfe_itemid,
  p_name AS hfe_desc,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'box' ELSE 'unit' END AS hfe_unit,
  CAST(l_quantity AS DECIMAL(18,2)) AS hfe_quantity,
  c_nationkey AS hfe_company2_id, 'Company ' || CAST(c_nationkey AS VARCHAR) AS com_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS hec_no,
  c_name AS hp_name, l_returnflag, CAST(l_shipdate AS DATE) AS report_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "revenue": "SELECT * FROM line",
    "detail_revenue": "SELECT * FROM line",
    "exam_revenue": "SELECT * FROM line",
    "deduction": "SELECT * FROM line WHERE l_returnflag = 'R'",
    "detail_deduction": "SELECT * FROM line WHERE l_returnflag = 'R'",
    "ar": """
SELECT CAST(o_orderkey AS VARCHAR) AS hfe_invoiceno, CAST(o_custkey AS VARCHAR) AS hfe_docno_1,
  o_orderkey AS k, CAST(o_orderkey % 8 AS INT) AS hfe_staff,
  'Cashier_' || CAST(o_orderkey % 8 AS VARCHAR) AS thungan,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'TM' WHEN '2' THEN 'CK' WHEN '3' THEN 'QR'
    WHEN '4' THEN 'TH' ELSE 'RC' END AS hfe_payment_method,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS kcb_class,
  CAST(1 + o_orderkey % 2 AS INT) AS price_type, CAST(1 + o_orderkey % 3 AS INT) AS object_type,
  CAST(1 + o_orderkey % 4 AS INT) AS receipt_object,
  CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE 'C' || CAST(o_custkey AS VARCHAR) END AS hd_cardno,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS hfe_date,
  CAST(amt + CASE WHEN o_custkey % 3 = 0 THEN 500 ELSE 0 END AS DECIMAL(18,2)) AS revenue,
  CAST(floor(CAST(amt AS DOUBLE) / 2) AS DECIMAL(18,2)) AS patpaid,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS freeamount,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(CAST(amt AS DOUBLE) / 4)
    WHEN o_orderkey % 29 = 1 AND o_orderkey % 8 = 6 THEN NULL ELSE 0 END AS DECIMAL(18,2))
    AS deposit,
  CAST(floor(CAST(amt AS DOUBLE) / 3) AS DECIMAL(18,2)) AS insurance,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 250 ELSE 0 END AS DECIMAL(18,2)) AS bqp, ded,
  CAST(o_orderdate AS DATE) AS report_date
FROM orders JOIN inv ON o_orderkey = k""",
    "receipt": """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan, hfe_payment_method,
  CAST(CASE WHEN k % 31 = 0 AND hfe_staff < 2 THEN NULL WHEN deposit > 0 THEN deposit ELSE 0 END
    AS DECIMAL(18,2)) AS hfe_deposit,
  CAST(CASE WHEN deposit > 0 THEN patpaid - freeamount - deposit ELSE patpaid - freeamount END
    + CASE WHEN k % 97 = 0 AND hfe_staff < 4 THEN 1000 ELSE 0 END AS DECIMAL(18,2))
    AS hfe_payment, report_date
FROM ar WHERE hfe_payment_method <> 'RC' AND deposit IS NOT NULL
  AND (deposit = 0 OR deposit < patpaid - freeamount)""",
    "deposit": """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan,
  CASE WHEN k % 11 = 0 THEN 'TM' ELSE hfe_payment_method END AS hfe_payment_method,
  deposit AS hfe_amount, report_date
FROM ar WHERE deposit > 0""",
    "refund": """
SELECT hfe_invoiceno, hfe_docno_1, hfe_staff, thungan, hfe_payment_method, t AS refund_type,
  m AS hfe_payment_calc_mode, CAST(a AS DECIMAL(18,2)) AS hfe_amount,
  'Patient ' || hfe_docno_1 AS hp_name,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'reason ' || CAST(k % 3 AS VARCHAR) END AS hfe_desc,
  report_date
FROM (
  SELECT *, 1 AS t, CAST(NULL AS VARCHAR) AS m, CAST(ded AS DECIMAL(18,2)) AS a FROM ar
    WHERE ded > 0 AND deposit IS NOT NULL
  UNION ALL SELECT *, 2, CAST(NULL AS VARCHAR),
    CAST(deposit - patpaid + freeamount AS DECIMAL(18,2)) FROM ar
    WHERE deposit > 0 AND deposit >= patpaid - freeamount AND hfe_payment_method <> 'RC'
  UNION ALL SELECT *, 2, 'M', CAST(300 AS DECIMAL(18,2)) FROM ar WHERE k % 23 = 0
  UNION ALL SELECT *, 2, CAST(NULL AS VARCHAR), CAST(75 AS DECIMAL(18,2)) FROM ar
    WHERE k % 41 = 0 AND hfe_staff = 5
  UNION ALL SELECT *, 3, CAST(NULL AS VARCHAR), CAST(200 AS DECIMAL(18,2)) FROM ar WHERE k % 13 = 0
  UNION ALL SELECT *, 4, CAST(NULL AS VARCHAR), CAST(150 AS DECIMAL(18,2)) FROM ar WHERE k % 17 = 0
  UNION ALL SELECT *, 5, CAST(NULL AS VARCHAR), CAST(50 AS DECIMAL(18,2)) FROM ar WHERE k % 19 = 0
) r""",
    "stock": """
SELECT CAST(l_suppkey % 20 AS INT) AS storage_id,
  CASE WHEN l_suppkey % 20 = 3 THEN NULL
    ELSE 'Store ' || CAST(l_suppkey % 20 AS VARCHAR) END AS stock_name,
  CAST(l_orderkey AS VARCHAR) AS documentno, CAST(l_linenumber AS VARCHAR) AS orderno,
  l_linestatus AS doctype,
  CASE WHEN l_linenumber = 7 THEN 'bad' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END
    AS transaction_date,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END
    AS receiptdate,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS expdate,
  CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_orderkey AS VARCHAR) || '.0' END AS docno,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS invoiceno,
  CAST(p_partkey AS VARCHAR) AS mp_product_id, p_name AS mp_name, p_type AS mp_producttype,
  CAST(l_quantity AS DECIMAL(18,2)) AS total_qty,
  CAST(p_retailprice AS DECIMAL(18,2)) AS unitprice,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount, CAST(l_shipdate AS DATE) AS report_date
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "inv_import": """
SELECT storage_id AS stock_import, stock_name, documentno, orderno, doctype, transaction_date,
  '-' AS partner_id, '-' AS partner_name, '-' AS taxcode, '-' AS contract_no,
  transaction_date AS signeddate, '-' AS contract_description, '-' AS decision_no, invoiceno,
  receiptdate AS invoicedate, '-' AS invoicecode, '-' AS product_category, mp_product_id, mp_name,
  '-' AS mpc_name, '-' AS manufacture_name, mp_producttype, '-' AS hft_name,
  '-' AS mp_country_id, '-' AS adu_name, '-' AS lotno, expdate, total_qty, unitprice,
  total_amount, report_date
FROM stock""",
    "inv_export": """
SELECT storage_id, stock_name, documentno, orderno, doctype, transaction_date,
  '-' AS department_receive, '-' AS makhoa_taichinh, '-' AS stock_import, mp_product_id, mp_name,
  '-' AS mpc_name, mp_producttype, '-' AS hft_name, '-' AS mp_country_id, '-' AS adu_name,
  '-' AS lotno, expdate, '-' AS stock_status, '-' AS payment_status, docno, invoiceno,
  receiptdate, '-' AS outpatient_order, '-' AS object_type, total_qty, unitprice,
  total_amount AS saleprice, report_date
FROM stock""",
    "inv_export_pdt": "SELECT * EXCLUDE (lotno, expdate) FROM inv_export",
    "dim_cashier": """
SELECT 'Cashier_' || CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_regionkey < 2""",
    "dim_method": """
SELECT CASE r_regionkey WHEN 0 THEN 'TM' WHEN 1 THEN 'QR' WHEN 2 THEN 'VISA' ELSE 'JCB' END AS method
FROM region WHERE r_regionkey < 4""",
    "dim_department": """
SELECT 'K' || CAST(n_nationkey AS VARCHAR) AS dept, n_name AS dept_name
FROM nation WHERE n_regionkey < 3""",
    "dim_storage": """
SELECT n_nationkey AS storage_id,
  CASE n_regionkey WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE n_name END AS storage_name
FROM nation WHERE n_regionkey < 4""",
}


def with_views(statement: str, period: tuple[str, str] | None = None) -> str:
    """The statement over the views. A period limits every fact, not the tables under it."""
    ctes = []
    for name, text in VIEWS.items():
        if period and name in ("line", "ar", "stock"):
            within = f"report_date BETWEEN '{period[0]}' AND '{period[1]}'"
            text = f"SELECT * FROM ({text}) w WHERE {within}"
        ctes.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(ctes) + "\n" + statement
