"""Operators on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from soquy.functions.labels import decode_classes
from soquy.functions.nulls import ensure_columns, invoice_key, is_blank, ne_keep_null
from soquy.functions.text import (
    comma_thousands,
    date_text,
    date_text_strict,
    dot_thousands,
    to_int_or_null,
)
from soquy.operators.checks import row_totals, within
from soquy.operators.dims import upsert_members, upsert_storage
from soquy.operators.filters import filter_optional, having_any_positive, search_rows, split_eq
from soquy.operators.joins import attach_coarse
from soquy.operators.present import option_list, order_report, page, with_grand_total
from soquy.operators.setops import union_members, union_padded
from soquy.operators.sums import category_pivot, pairs_by_id, sum_by


def values(df, *expressions):
    return [tuple(r) for r in df.selectExpr(*expressions).collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_keeping_inequality(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "x int")
    assert values(df, ne_keep_null("x", 0)) == [(False,), (True,), (True,)]
    text = spark.createDataFrame([("M",), ("it's",), (None,)], "x string")
    assert values(text, ne_keep_null("x", "M")) == [(False,), (True,), (True,)]
    assert values(text, ne_keep_null("x", "it's")) == [(True,), (False,), (True,)]


def test_invoice_key_keeps_null_as_text(spark):
    df = spark.createDataFrame([(12,), (None,)], "x int")
    assert values(df, invoice_key("x")) == [("12",), ("None",)]


def test_blank(spark):
    df = spark.createDataFrame([("",), ("  ",), ("a",), (None,)], "x string")
    assert values(df, is_blank("x")) == [(True,), (True,), (False,), (True,)]


def test_dates(spark):
    texts = ["2024-03-09", "2024-03-09 10:00:00", "2024-02-31", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert values(df, date_text("x")) == [
        ("09-03-2024",), ("09-03-2024",), (None,), (None,), (None,)
    ]
    good = df.where("x IS NULL OR x = '2024-03-09'")
    assert values(good, date_text_strict("x")) == [("09/03/2024",), (None,)]
    with pytest.raises(PySparkException):
        df.selectExpr(date_text_strict("x")).collect()


def test_integers(spark):
    texts = ["12", "12.0", "12.7", "12x", "", "-3", "99999999999999999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in values(df, to_int_or_null("x"))]
    assert got == [12, 12, None, None, None, -3, None, None]


def test_number_texts(spark):
    numbers = ["1234567.50", "0.50", "1.50", "-1234.50", None]
    df = spark.createDataFrame([(n and Decimal(n),) for n in numbers], "x decimal(18,2)")
    assert [r[0] for r in values(df, dot_thousands("x"))] == [
        "1.234.568", "0", "2", "-1.234", None
    ]
    assert [r[0] for r in values(df, dot_thousands("x", null_as_zero=True))] == [
        "1.234.567", "0", "1", "-1.234", "0"
    ]
    assert [r[0] for r in values(df, comma_thousands("x"))] == [
        "1,234,568", "1", "2", "-1,235", None
    ]


def test_labels_pass_unknown_codes_through(spark):
    df = spark.createDataFrame(
        [(1, 2, 3), (2, None, 1)], "kcb_class int, price_type int, object_type int"
    )
    assert rows(decode_classes(df)) == [
        ("Ngoại trú", "Theo yêu cầu", "3"),
        ("Nội trú", None, "BHYT"),
    ]


def test_ensure_columns(spark):
    df = ensure_columns(spark.range(1), {"id": "int", "a": "decimal(18,2)"}, 0)
    df = ensure_columns(df, {"b": "string"})
    assert df.dtypes == [("id", "bigint"), ("a", "decimal(18,2)"), ("b", "string")]
    assert rows(df) == [(0, Decimal("0.00"), None)]


def test_sums_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("b", None)], "k string, v int")
    assert rows(sum_by(df, ["k"], ["v"])) == [("a", 1), ("b", 0)]
    assert rows(sum_by(df, ["k"], ["v"], keep_null_keys=True)) == [
        ("a", 1), ("b", 0), (None, 5)
    ]


def test_pivot_drops_unknown_codes(spark):
    data = [("a", "DT001", 1), ("a", "DT010", 9), ("b", "DT010", 9), (None, "DT002", 3)]
    df = spark.createDataFrame(data, "k string, hft_id2 string, v int")
    got = category_pivot(df, ["k"], "v").collect()
    assert [(r.k, int(r.tien_kham), int(r.tien_giuong)) for r in got] == [("a", 1, 0)]
    kept = category_pivot(df, ["k"], "v", keep_null_keys=True)
    assert {(r.k, int(r.tien_giuong)) for r in kept.collect()} == {("a", 0), (None, 3)}


def test_attach_coarse_repeats_or_not(spark):
    fine = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "i int, m string")
    coarse = spark.createDataFrame([(1, 10), (3, 7)], "i int, v int")
    assert rows(attach_coarse(fine, coarse, ["i"])) == [(1, 10, "x"), (1, 10, "y"), (3, 7, None)]
    assert rows(attach_coarse(fine, coarse, ["i"], "exact")) == [(1, 10, "x"), (3, 7, None)]
    with pytest.raises(ValueError):
        attach_coarse(fine, coarse, ["i"], "once")


def test_filters(spark):
    df = spark.createDataFrame([("a", True), ("b", False), (None, True)], "k string, s boolean")
    assert filter_optional(df, k=None, s=None).count() == 3
    assert filter_optional(df, k="", s=False).collect() == [("b", False)]
    assert filter_optional(df, k="a", s=False).count() == 0
    assert filter_optional(df, k="x' OR '1'='1").count() == 0
    assert split_eq(df, "k", "a").count() == 1
    amounts = spark.createDataFrame([(1, None), (None, None), (0, 2), (0, 0)], "a int, b int")
    assert having_any_positive(amounts, ["a", "b"]).count() == 2


def test_search_takes_all_words_in_any_column(spark):
    df = spark.createDataFrame([("Nội trú", 12), ("Ngoại trú", 3), (None, 12)], "a string, n int")
    assert search_rows(df, "TRÚ 12").collect() == [("Nội trú", 12)]
    assert search_rows(df, " ").count() == 3
    assert search_rows(df, "12", ["a"]).count() == 0


def test_row_totals_and_tolerance(spark):
    df = spark.createDataFrame([(1, None, 100), (100, 100, 300)], "a int, b int, c int")
    assert rows(row_totals(df, {"t": ["a", "b"], "u": ["c", "a"]})) == [
        (1, None, 100, 1, 101), (100, 100, 300, 200, 400)
    ]
    assert values(df, within("a", "c", 100)) == [(True,), (False,)]


def test_grand_total_is_the_column_sums(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "k string, x int, y int")
    assert with_grand_total(df, ["x", "y"]).collect()[-1] == ("Tổng cộng", 4, 2)
    flagged = with_grand_total(df, ["x"], "all", flag=True)
    assert flagged.where("is_total = 1").select("k", "x", "y").collect() == [("all", 4, None)]
    none = with_grand_total(df.where("k = 'z'"), ["x", "y"])
    assert none.collect() == [("Tổng cộng", 0, 0)]


def test_order_and_page(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 1)], "k string, n int")
    assert [r.n for r in order_report(df, ["k", "n"]).collect()] == [1, 3, 1, 2]
    assert page(df, "k", 0, 2).collect() == [("a", 1), ("a", 3)]
    assert page(df, "k", 1, 2).collect() == [("b", 1), (None, 2)]
    assert page(df, "k", 2, 2).collect() == []
    assert [r.k for r in option_list(df, "k").collect()] == ["a", "a", "b", None]


def test_unions(spark):
    a = spark.createDataFrame([("a",), ("b",)], "k string")
    b = spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows(union_members(a, b)) == [("a",), ("b",), ("c",)]
    padded = union_padded(a, spark.createDataFrame([("c", 1)], "k string, n int"))
    assert rows(padded) == [("a", None), ("b", None), ("c", 1)]


def test_members_are_added_once(spark):
    dim = spark.createDataFrame([("K1", "One")], "dept string, dept_name string")
    seen = spark.createDataFrame([("K1",), ("K2",)], "dept string")
    once = upsert_members(dim, seen)
    assert rows(once) == [("K1", "One"), ("K2", None)]
    assert rows(upsert_members(once, seen)) == rows(once)


def test_storage_names_are_filled_never_replaced(spark):
    stored = [(1, "Set"), (2, ""), (3, None), (4, "  "), (5, " ")]
    dim = spark.createDataFrame(stored, "storage_id int, storage_name string")
    seen = [(1, "Other"), (2, "Two"), (3, "Three"), (4, ""), (6, "Six"), (6, "Aaa"), (7, None)]
    facts = spark.createDataFrame(seen, "storage_id int, storage_name string")
    pairs = pairs_by_id(facts, "storage_id", "storage_name")
    assert rows(pairs) == [(1, "Other"), (2, "Two"), (3, "Three"), (4, ""), (6, "Six")]
    once = upsert_storage(dim, pairs)
    assert rows(once) == [
        (1, "Set"), (2, "Two"), (3, "Three"), (4, "  "), (5, " "), (6, "Six")
    ]
    assert rows(upsert_storage(once, pairs)) == rows(once)

