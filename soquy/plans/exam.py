"""Revenue of examination contracts with companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.labels import decode_classes
from soquy.functions.nulls import fill_text
from soquy.operators.present import order_report
from soquy.operators.shape import CLASS_KEYS, NO_CONTRACT
from soquy.operators.sums import (
    CATEGORY_OR_RETAIL_KIND,
    Source,
    category_measures,
    retail_measure,
    sum_sources,
)

_COMPANY = ["hfe_company2_id", "com_name", "hec_no"]
_PATIENT = ["hfe_docno_1", "hp_name"]


def _exam(tables, from_date: str, to_date: str, extra: list[str], ordered: bool) -> DataFrame:
    keys = [*CLASS_KEYS, *_COMPANY, *extra]
    columns = [*keys, "hft_id2", "drug_retail", "revenue"]
    rows = tables.fact("exam_revenue", from_date, to_date, columns=columns)
    rows = rows.withColumn("hec_no", F.expr(fill_text("hec_no", NO_CONTRACT)))
    source = Source(rows, CATEGORY_OR_RETAIL_KIND, {"revenue": "revenue"})
    measures = [*category_measures("revenue"), retail_measure("revenue")]
    # a patient has few lines of a kind: summing by kind first would only add a shuffle
    sums = sum_sources([source], keys, measures, fine=bool(extra))
    return decode_classes(order_report(sums, keys, ordered))


def exam_revenue(tables, from_date: str, to_date: str, ordered: bool = True) -> DataFrame:
    return _exam(tables, from_date, to_date, [], ordered)


def exam_revenue_by_patient(
    tables, from_date: str, to_date: str, ordered: bool = True
) -> DataFrame:
    return _exam(tables, from_date, to_date, _PATIENT, ordered)
