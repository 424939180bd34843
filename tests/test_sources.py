"""Readers, landing and sinks."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from compare import assert_same
from conftest import DATA
from facts import make
from pyspark.sql import functions as F

from soquy import registry
from soquy.oracle import statements as sql
from soquy.oracle.views import with_views
from soquy.plans import inventory, reconcile, revenue
from soquy.registry import as_plain
from soquy.sources.schemas import FACTS
from soquy.sources.sinks import work_dir, write_dim, write_fact, write_report
from soquy.sources.star import StarTables
from soquy.sources.tables import (
    ALL_DAYS,
    EnvelopeTables,
    FrameTables,
    ParquetTables,
    read_envelope,
)

MARCH = ("2024-03-01", "2024-03-31")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landed"))
    for name in ("revenue", "detail_revenue", "inv_export"):
        df = spark.createDataFrame(make(name, "landed", 90), FACTS[name])
        day = F.expr("date_add(DATE'2024-02-28', CAST(monotonically_increasing_id() % 5 AS INT))")
        write_fact(df.coalesce(1).withColumn("report_date", day), root, name)
    return root


def test_period_is_required_and_inclusive(spark, landed):
    tables = ParquetTables(spark, landed)
    for wrong in [("", "2024-03-01"), ("2024-03-01", None), ("01-03-2024", "2024-03-01")]:
        with pytest.raises(ValueError):
            tables.fact("revenue", *wrong)
    assert tables.fact("revenue", "2024-02-28", "2024-03-03").count() == 90
    assert tables.fact("revenue", "2024-02-28", "2024-02-28").count() == 18
    assert tables.fact("revenue", "2024-03-01", "2024-03-03").count() == 54
    assert tables.fact("revenue", "2023-01-01", "2023-12-31").count() == 0


def test_predicates_reach_the_scan(spark, landed):
    tables = ParquetTables(spark, landed)
    plan = plan_of(revenue.detail_revenue(tables, *MARCH, category="DT005", order="K1"))
    assert "PartitionFilters: [isnotnull(report_date" in plan
    assert "EqualTo(hft_id2,DT005)" in plan
    assert "EqualTo(sd_makhoa_taichinh_order,K1)" in plan
    plan = plan_of(inventory.inventory_export(tables, *MARCH, storage_ids=[7, 53]))
    assert "In(storage_id, " in plan


def test_only_needed_columns_are_read(spark, landed):
    tables = ParquetTables(spark, landed)
    plan = plan_of(revenue.revenue_by_order_dept(tables, *MARCH))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} >= {"hft_id2", "drug_retail"}
    assert "hfe_invoiceno" not in schema and "cogs_drug_retail" not in schema


def test_category_must_be_known(spark, landed):
    with pytest.raises(ValueError):
        revenue.detail_revenue(ParquetTables(spark, landed), *MARCH, category="DT010")


def test_fact_never_landed_fails_unless_asked_for(spark, landed):
    with pytest.raises(AnalysisException):
        ParquetTables(spark, landed).fact("ar", *MARCH)
    with pytest.raises(KeyError):
        FrameTables(spark, {}).fact("ar", *MARCH)
    with pytest.raises(ValueError):
        ParquetTables(spark, landed, missing="none")
    tables = ParquetTables(spark, landed, missing="empty")
    assert tables.fact("ar", *MARCH).schema == FACTS["ar"]
    assert reconcile.summary_reconciliation(tables, *MARCH).count() == 0


def test_columns_missing_in_old_files_are_null(spark, tmp_path):
    old = spark.range(3).selectExpr("CAST(id AS STRING) AS hfe_docno_1", "'DT001' AS hft_id2")
    old.write.parquet(f"{tmp_path}/revenue/report_date=2024-03-02")
    got = ParquetTables(spark, str(tmp_path)).fact("revenue", *MARCH)
    assert got.columns == FACTS["revenue"].names
    assert got.where("hft_id2 = 'DT001' AND revenue IS NULL AND hft_id IS NULL").count() == 3


def test_envelopes(spark, tmp_path):
    """Anything but a list of records gives no rows; missing fields are null."""
    good = {"data": [{"hfe_invoiceno": 7, "hfe_amount": 12.5, "other": 1}, {"thungan": "An"}]}
    answers = [good, {"data": None}, {}, {"data": "x"}, {"data": []}, {"status": "down"}]
    for i, answer in enumerate(answers):
        (tmp_path / f"{i}.json").write_text(json.dumps(answer, indent=2))
    got = read_envelope(spark, str(tmp_path), FACTS["deposit"], multi_line=True)
    assert got.schema == FACTS["deposit"]
    got = got.selectExpr("hfe_invoiceno", "CAST(hfe_amount AS DOUBLE)", "thungan")
    found = {tuple(r) for r in got.collect()}
    assert found == {("7", 12.5, None), (None, None, "An")}


@pytest.mark.parametrize("broken", ['{"data": [{"hfe_amount": 1}, {"hfe_am', '{"data": [{"hfe_amount": 1]}', "no json"])
@pytest.mark.parametrize("multi_line", [False, True])
def test_broken_documents_fail(spark, tmp_path, broken, multi_line):
    (tmp_path / "good.json").write_text('{"data": [{"hfe_amount": 1}]}')
    (tmp_path / "bad.json").write_text(broken)
    with pytest.raises(PySparkException):
        read_envelope(spark, str(tmp_path), FACTS["deposit"], multi_line).collect()


def test_numbers_are_kept_or_refused(spark, tmp_path):
    answer = {"data": [{"refund_type": 1.0, "hfe_amount": 10.123456}, {"refund_type": "2", "hfe_amount": 1e3}, {"hfe_amount": ""}]}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    got = read_envelope(spark, str(tmp_path), FACTS["refund"]).select("refund_type", "hfe_amount").collect()
    assert [(r[0], r[1] and float(r[1])) for r in got] == [(1, 10.123456), (2, 1000.0), (None, None)]
    for wrong in ({"refund_type": 1.5}, {"hfe_amount": 0.1234567}, {"hfe_amount": "x"}, {"hfe_amount": 0.12345678901234567}, {"hfe_staff": 3_000_000_000}):
        (tmp_path / "a.json").write_text(json.dumps({"data": [wrong]}))
        spark.catalog.clearCache()
        with pytest.raises(PySparkException):
            read_envelope(spark, str(tmp_path), FACTS["refund"]).collect()


def test_landing_replaces_its_days_only(spark, tmp_path):
    rows = lambda day, *amounts: spark.createDataFrame([(a, dt.date(2024, 3, day)) for a in amounts], "hfe_amount int, report_date date")
    write_fact(rows(1, 1, 2), str(tmp_path), "deposit")
    write_fact(rows(2, 4), str(tmp_path), "deposit")
    write_fact(rows(2, 8), str(tmp_path), "deposit")
    back = spark.read.parquet(f"{tmp_path}/deposit")
    assert sorted(r["hfe_amount"] for r in back.collect()) == [1, 2, 8]


def test_all_days(spark):
    days = [(1, dt.date(2024, 3, 31)), (2, None), (3, dt.date(1800, 1, 1))]
    df = spark.createDataFrame(days, "hfe_amount int, report_date date")
    assert FrameTables(spark, {"deposit": df}).fact("deposit", ALL_DAYS, ALL_DAYS).count() == 3


def test_landed_envelopes_are_pruned_by_day(spark, tmp_path):
    for day, amount in [("2024-02-28", 1), ("2024-03-01", 2), ("2024-03-02", 4)]:
        folder = tmp_path / "deposit" / f"report_date={day}"
        folder.mkdir(parents=True)
        answer = {"data": [{"hfe_amount": amount}]}
        (folder / "answer.json").write_text(json.dumps(answer, indent=1))
    got = EnvelopeTables(spark, str(tmp_path), multi_line=True).fact("deposit", *MARCH)
    assert "PartitionFilters: [isnotnull(report_date" in plan_of(got)
    assert got.agg(F.sum("hfe_amount")).first()[0] == 6


def test_frames_with_a_day_are_limited_to_the_period(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 3, 31)), (2, dt.date(2024, 4, 1))], "hfe_amount int, report_date date"
    )
    assert FrameTables(spark, {"deposit": df}).fact("deposit", *MARCH).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("K1", "Một"), ("K2", None)], "dept string, dept_name string")
    write_report(df, f"{tmp_path}/csv")
    back = spark.read.schema(df.schema).csv(f"{tmp_path}/csv", header=True)
    assert sorted(back.collect()) == sorted(df.collect())
    write_report(df, f"{tmp_path}/parquet", "parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2
    write_dim(df, f"{tmp_path}/dim")
    write_dim(df.limit(1), f"{tmp_path}/dim")
    assert spark.read.parquet(f"{tmp_path}/dim").count() == 3
    with pytest.raises(ValueError):
        write_report(df, f"{tmp_path}/x", "xlsx")


def test_work_folder_is_the_shared_one(spark):
    assert work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_each_line_has_one_of_each_dimension(star):
    """What makes the left joins of a line fact equal to the inner joins of the views."""
    lines = star.sql("SELECT count(*) FROM lineitem").fetchall()
    joined = star.sql(
        "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
        "JOIN part ON l_partkey = p_partkey"
    ).fetchall()
    assert lines == joined


@pytest.mark.parametrize("name", list(FACTS))
def test_stand_in_facts_have_the_fixed_schema(spark, name):
    df = StarTables(spark, DATA).fact(name, "1900-01-01", "2199-12-31")
    assert df.schema.names == FACTS[name].names
    assert [f.dataType for f in df.schema] == [f.dataType for f in FACTS[name]]


@pytest.mark.parametrize("name", list(FACTS))
def test_stand_in_facts_equal_the_views(spark, star, name):
    df = StarTables(spark, DATA).fact(name, "1997-01-01", "1997-12-31")
    money = {f.name for f in FACTS[name] if f.dataType.simpleString().startswith("decimal")}
    columns = ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c in money else c for c in FACTS[name].names
    )
    view = with_views(f"SELECT {columns} FROM {name}", ("1997-01-01", "1997-12-31"))
    assert assert_same(as_plain(df), star.sql(view)) > 0


def test_documents_of_many_records_stay_small(spark):
    for n in (50, 5_000, 20_000):
        rows = spark.range(n).selectExpr("CAST(id AS STRING) AS hfe_invoiceno", "'7' AS hfe_docno_1")
        sizes = [r[0] for r in registry._documents_of_many(rows).selectExpr("size(data)").collect()]
        assert sum(sizes) == n and max(sizes) <= 200


def test_landed_slips_are_all_slips_once(spark, star):
    found = as_plain(inventory.inventory_export(registry._landed_slips(spark, DATA), "1900-01-01", "2100-01-01"))
    oracle = with_views(sql.exports("CAST(expdate AS DATE) BETWEEN '1900-01-01' AND '2100-01-01'"))
    assert assert_same(found, star.sql(oracle)) > 0
