"""Fixed schemas of the facts and dimensions. Every column is nullable."""

from pyspark.sql import types as T

# Amounts, quantities and unit prices keep six decimals; sums widen further.
MONEY = T.DecimalType(28, 6)

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "money": MONEY,
    "date": T.DateType(),
}


def _struct(text: str) -> T.StructType:
    """``"a b:int c:money"`` as a StructType; a bare name is a string."""
    fields = []
    for word in text.split():
        name, _, kind = word.partition(":")
        fields.append(T.StructField(name, _TYPES[kind or "string"], True))
    return T.StructType(fields)


_LEDGER = "hfe_invoiceno hfe_docno_1 hfe_staff:int thungan hfe_payment_method"
_CLASSES = "kcb_class:int price_type:int object_type:int"
_REVENUE = (
    f"hfe_invoiceno hfe_docno_1 hft_id2 hft_id:int {_CLASSES} drug_retail "
    "sd_makhoa_taichinh_order sd_makhoa_taichinh "
    "revenue:money cogs_drug_retail:money cost_in_package:money"
)
_DETAIL = (
    f"hft_id2 {_CLASSES} hft_name hfe_group hfe_itemid hfe_desc "
    "sd_makhoa_taichinh_order sd_makhoa_taichinh hfe_unit hfe_quantity:money revenue:money"
)
_SLIP = (
    "storage_id:int stock_name documentno orderno doctype transaction_date "
    "department_receive makhoa_taichinh stock_import mp_product_id mp_name mpc_name "
    "mp_producttype hft_name mp_country_id adu_name {batch}stock_status payment_status "
    "docno invoiceno receiptdate outpatient_order object_type "
    "total_qty:money unitprice:money saleprice:money"
)

FACTS: dict[str, T.StructType] = {
    "receipt": _struct(f"{_LEDGER} hfe_deposit:money hfe_payment:money"),
    "deposit": _struct(f"{_LEDGER} hfe_amount:money"),
    "refund": _struct(
        f"{_LEDGER} refund_type:int hfe_payment_calc_mode hfe_amount:money hp_name hfe_desc"
    ),
    "ar": _struct(
        f"{_LEDGER} {_CLASSES} receipt_object:int hd_cardno hfe_date deposit:money "
        "revenue:money patpaid:money freeamount:money insurance:money bqp:money"
    ),
    "revenue": _struct(_REVENUE),
    "deduction": _struct(_REVENUE),
    "detail_revenue": _struct(_DETAIL),
    "detail_deduction": _struct(_DETAIL),
    "exam_revenue": _struct(f"{_REVENUE} hfe_company2_id:int com_name hec_no hp_name"),
    "inv_import": _struct(
        "stock_import:int stock_name documentno orderno doctype transaction_date partner_id "
        "partner_name taxcode contract_no signeddate contract_description decision_no invoiceno "
        "invoicedate invoicecode product_category mp_product_id mp_name mpc_name "
        "manufacture_name mp_producttype hft_name mp_country_id adu_name lotno expdate "
        "total_qty:money unitprice:money total_amount:money"
    ),
    "inv_export": _struct(_SLIP.format(batch="lotno expdate ")),
    "inv_export_pdt": _struct(_SLIP.format(batch="")),
}

# Fact column a storage filter applies to.
STORAGE_COLUMN = {
    "inv_import": "stock_import",
    "inv_export": "storage_id",
    "inv_export_pdt": "storage_id",
}

DIMENSIONS: dict[str, T.StructType] = {
    "dim_cashier": _struct("name"),
    "dim_method": _struct("method"),
    "dim_department": _struct("dept dept_name"),
    "dim_storage": _struct("storage_id:int storage_name"),
}

# Facts are stored by the day they were reported for, with their place in the answer where it is known.
PERIOD_COLUMN = "report_date"
PLACE_COLUMN = "answer_place"


def raw_schema(schema: T.StructType) -> T.StructType:
    """The same columns as text, the way a document has them."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])


def typed(schema: T.StructType) -> list[str]:
    """SQL for each column of a schema from its text. What would have to be cut or rounded to fit,
    or is no number, fails the query; ``1.0`` is a whole number."""
    return [f"{_exactly(f)} AS {f.name}" for f in schema]


def _exactly(field: T.StructField) -> str:
    name, kind = field.name, field.dataType
    if isinstance(kind, T.StringType):
        return name
    wide = f"try_cast({name} AS DECIMAL(38,12))"
    cast = f"try_cast({wide} AS {kind.simpleString()})"
    fault = f"raise_error(concat('{name} holds ', {name}, ', which does not fit {kind.simpleString()}'))"
    return (
        f"CASE WHEN {name} IS NULL OR trim({name}) = '' THEN NULL "
        f"WHEN CAST({cast} AS DECIMAL(38,12)) = {wide} AND {name} RLIKE '{_SHORT}' THEN {cast} ELSE {fault} END"
    )


# Numbers with at most 12 decimals, the most that are compared; zeros after them do not count.
_SHORT = "^[^.]*([.][0-9]{0,12}0*([eE].*)?)?$"


ORDER_FIELDS = [T.StructField(PLACE_COLUMN, T.LongType(), True), T.StructField(PERIOD_COLUMN, T.DateType(), True)]


def stored_schema(name: str) -> T.StructType:
    """Schema of a landed fact: its own columns, its place and the day it is stored under."""
    return T.StructType(FACTS[name].fields + ORDER_FIELDS)


BROKEN = "_broken"


def envelope_schema() -> T.StructType:
    """An envelope with its data as text, and the whole document where it cannot be read."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in ("data", BROKEN)])
