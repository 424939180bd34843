"""Whole documents read by many tasks, snapshots of facts, versions of dimensions, stored pages."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import PySparkException

from soquy import registry
from soquy.operators.dims import new_members, storage_changes, upsert_storage
from soquy.operators.joins import attach_coarse, likely_among
from soquy.operators.present import page_after, store_pages
from soquy.operators.sums import pairs_by_id
from soquy.sources import documents, versions
from soquy.sources.schemas import DIMENSIONS, FACTS
from soquy.sources.snapshots import SnapshotTables, commit_fact, land_fact, replaced, stage_fact
from soquy.sources.tables import ALL_DAYS, EnvelopeTables, read_envelope

ALWAYS = (ALL_DAYS, ALL_DAYS)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def document(rng, n, indent):
    texts = ["a}b", '{"', 'q"}\\', "]}", "plain", "é\n}", "", None, "x" * 900]
    rows = [{"hfe_invoiceno": str(k), "thungan": rng.choice(texts), "hfe_amount": k % 7, "other": rng.choice([{"a": {}}, 1])} for k in range(n)]
    whole = {"sta{tus": 'o}k"', "data": rows, "pages": 1}
    return rows, json.dumps(whole, indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("listed", [documents.LISTED_STARTS, 0])
def test_a_whole_document_is_read_by_many_tasks(spark, tmp_path, small_splits, listed):
    rng, expected = random.Random(4), []
    for k, indent in enumerate([None, 2, 0]):
        rows, text = document(rng, 150, indent)
        (tmp_path / f"{k}.json").write_text(text + ("\n" if k else ""))
        expected += [(r["hfe_invoiceno"], r["thungan"], r["hfe_amount"]) for r in rows]
    got = documents.read_whole(spark, str(tmp_path), FACTS["deposit"], listed_starts=listed)
    found = [(r["hfe_invoiceno"], r["thungan"], int(r["hfe_amount"])) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    if listed:
        assert got.rdd.getNumPartitions() > 30
    raw = spark.read.text(str(tmp_path), lineSep="}")
    assert raw.rdd.getNumPartitions() > 20


BROKEN = [
    '{"data": [{"a": 1}, {"a": 2',
    '{"data": [{"a": 1}, {"a": 2}',
    '{"data": [{"a": 1}, {"a": 2}]',
    '{"data": [{"a": 1} {"a": 2}]}',
    '{"data": [{"a": 1},, {"a": 2}]}',
    '{"data": [{"a": 1},]}',
    '{"data": [{"a": 1}]} x',
    '{"data": [{"a": 1}], "more": [{"a": 1}]}',
    '{"meta": {"a": 1}, "data": [{"a": 1}]}',
    '[{"a": 1}]',
    '{"data": [1, 2]}',
    '{"data": {"a": 1}}',
    '{"data": [{"hfe_amount": 1]}',
    '{"data": [{"a": 1, "b"}]}',
    "no json",
]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_whole_documents_fail(spark, tmp_path, small_splits, text):
    (tmp_path / "a.json").write_text('{"data": [{"hfe_amount": 1}]}')
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(PySparkException):
        read_envelope(spark, str(tmp_path), FACTS["deposit"], multi_line=True).collect()


@pytest.mark.parametrize("text", ['{"data": null}', "{}", '{"data": "x}"}\n', '{"data": []}', '{"status": 1}', ' { "data" : [ ] } '])
def test_documents_without_records(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    assert read_envelope(spark, str(tmp_path), FACTS["deposit"], multi_line=True).collect() == []


def test_one_task_reads_documents_with_other_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": {"a": 1},\n "data": [{"hfe_amount": 1}]}')
    got = read_envelope(spark, str(tmp_path), FACTS["deposit"], multi_line=True, split=False)
    assert got.count() == 1


def test_any_cut_of_a_document_fails_and_any_split_gives_its_records():
    rng = random.Random(8)
    for _ in range(150):
        rows, text = document(rng, rng.randint(0, 5), rng.choice([None, 1]))
        raw = text.encode()
        bounds = sorted({0, *(rng.randrange(len(raw)) for _ in range(4))})
        assert [json.loads(r) for r in given(raw, bounds)] == rows
        with pytest.raises(ValueError):
            [json.loads(r) for r in given(raw[: rng.randrange(1, len(raw))], bounds)]


def given(raw, bounds):
    """The records of a document, cut into splits at ``bounds``, in plain Python."""
    pieces, at, splits = raw.split(b"}"), 0, {}
    cut = pieces[-1] != b""
    for piece in pieces if cut else pieces[:-1]:
        splits.setdefault(max(b for b in bounds if b <= at), []).append(piece)
        at += len(piece) + 1
    inside, depth, found, frame, part = False, 0, [], [], b""
    for block, own in sorted(splits.items()):
        split = documents.Split(block == 0, inside, depth)
        for piece in own:
            split.add(piece)
        inside, depth = split.inside, split.depth
        for k, (kind, whole, text) in enumerate(split.end()):
            if kind == documents.FRAME:
                frame.append({"file": "f", "block": block, "part": k, "whole": whole, "text": text, "cut": cut})
            else:
                part = text if kind in (documents.RECORD, documents.HEAD) else part + text
                found += [part] if whole else []
    documents.checked_frame(documents.pa.Table.from_pylist(frame or [{"file": "f", "block": 0, "part": 0, "whole": False, "text": b"", "cut": False}]))
    return found


def facts(spark, *rows):
    return spark.createDataFrame([(a, d and dt.date(2024, 3, d)) for a, d in rows], "hfe_amount int, report_date date")


def amounts(spark, root, *period):
    rows = SnapshotTables(spark, root).fact("deposit", *(period or ALWAYS)).collect()
    return sorted(int(r["hfe_amount"]) for r in rows)


def test_a_landing_shows_once_it_is_committed(spark, tmp_path):
    root = str(tmp_path)
    land_fact(facts(spark, (1, 1), (2, 2), (4, None)), root, "deposit")
    before = SnapshotTables(spark, root).fact("deposit", *ALWAYS)
    batch = stage_fact(facts(spark, (8, 2), (16, 3), (32, None)), root, "deposit")  # and the job ends here
    assert amounts(spark, root) == [1, 2, 4]
    commit_fact(spark, root, "deposit", batch)
    assert amounts(spark, root) == [1, 8, 16, 32]
    assert sorted(int(r["hfe_amount"]) for r in before.collect()) == [1, 2, 4]  # a reader that has begun
    assert amounts(spark, root, "2024-03-01", "2024-03-02") == [1, 8]
    land_fact(facts(spark, (64, 1)), root, "deposit", days=["2024-03-02"])
    assert amounts(spark, root) == [16, 32, 64]
    assert amounts(spark, root, "2024-03-02", "2024-03-02") == []
    assert len(replaced(spark, root, "deposit")) == 1
    land_fact(facts(spark), root, "deposit", days=["2024-03-01"])
    assert amounts(spark, root) == [16, 32]


def test_landings_at_the_same_time_are_seen_alike(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    a, b = (stage_fact(facts(spark, (n, 1), (n, n)), root, "deposit") for n in (2, 3))
    commit_fact(spark, root, "deposit", a)
    other = tmp_path / "other"
    commit_fact(spark, root, "deposit", b)
    # both commits as of version 1
    rows = spark.read.parquet(f"{root}/deposit/commits").selectExpr("report_date", "batch", "1L AS version", "has_rows")
    rows.write.parquet(f"{other}/deposit/commits")
    (other / "deposit" / "data").symlink_to(tmp_path / "deposit" / "data")
    winner = 2 if a > b else 3
    assert amounts(spark, str(other)) == sorted([winner, 2, 3])


def test_snapshots_prune_days_and_columns(spark, tmp_path):
    land_fact(facts(spark, *((n, n) for n in range(1, 6))), str(tmp_path), "deposit")
    df = SnapshotTables(spark, str(tmp_path)).fact("deposit", "2024-03-02", "2024-03-03").select("hfe_amount")
    assert len(df.inputFiles()) == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hfe_amount:" in plan and "thungan" not in plan


def test_snapshot_of_nothing(spark, tmp_path):
    with pytest.raises(PySparkException):
        SnapshotTables(spark, str(tmp_path)).fact("deposit", *ALWAYS)
    assert SnapshotTables(spark, str(tmp_path), missing="empty").fact("deposit", *ALWAYS).count() == 0


DEPT = DIMENSIONS["dim_department"]


def depts(spark, *rows):
    return spark.createDataFrame(rows, DEPT)


def test_appends_from_one_base_give_each_member_once(spark, tmp_path):
    path = f"{tmp_path}/dim"
    assert versions.read_members(spark, path, DEPT, "dept").collect() == []
    assert versions.append_version(depts(spark, ("K1", "One"), ("K2", None)), path, 0) == 1
    seen = spark.createDataFrame([("K2",), ("K3",)], "dept string")
    lacking = new_members(versions.read_members(spark, path, DEPT, "dept", 1), seen)
    assert versions.append_version(lacking, path, 1, "a") == 2
    assert versions.append_version(lacking, path, 1, "a") == 2  # the same attempt again
    with pytest.raises(versions.StaleVersion):
        versions.append_version(lacking, path, 1, "b")
    # two that cross: both have looked before either writes
    now = versions.current_version
    try:
        versions.current_version = lambda *_: 1
        assert versions.append_version(depts(spark, ("K3", None), ("K4", None), ("K2", "Two")), path, 1, "c") == 2
    finally:
        versions.current_version = now
    found = sorted(versions.read_members(spark, path, DEPT, "dept").collect())
    assert found == [("K1", "One"), ("K2", "Two"), ("K3", None), ("K4", None)]
    assert sorted(versions.read_members(spark, path, DEPT, "dept", 1).collect()) == [("K1", "One"), ("K2", None)]


def test_an_overtaken_append_is_made_anew(spark, tmp_path):
    path, calls = f"{tmp_path}/dim", []
    versions.append_version(depts(spark, ("K1", None)), path, 0)

    def lacking(dim):
        calls.append(1)
        if len(calls) == 1:  # another writer is faster
            versions.append_version(depts(spark, ("K2", "Two")), path, 1)
        return new_members(dim, spark.createDataFrame([("K2",), ("K3",)], "dept string"))

    assert versions.append_members(spark, path, DEPT, "dept", lacking) == 3
    assert len(calls) == 2
    found = versions.read_members(spark, path, DEPT, "dept").collect()
    assert sorted(found) == [("K1", None), ("K2", "Two"), ("K3", None)]
    assert versions.append_members(spark, path, DEPT, "dept", lambda dim: dim.limit(0)) == 3


def test_storage_versions_equal_the_whole_upsert(spark, tmp_path):
    path, schema = f"{tmp_path}/dim", DIMENSIONS["dim_storage"]
    dim = spark.createDataFrame([(1, "Set"), (2, ""), (3, None), (4, "  ")], schema)
    pairs = spark.createDataFrame([(1, "Other"), (2, "Two"), (3, "Three"), (4, ""), (6, "Six")], schema)
    versions.append_version(dim, path, 0)
    for _ in range(2):
        versions.append_members(spark, path, schema, "storage_id", lambda d: storage_changes(d, pairs))
    assert sorted(versions.read_members(spark, path, schema, "storage_id").collect()) == sorted(upsert_storage(dim, pairs).collect())
    assert versions.current_version(spark, path) == 2


def test_the_last_name_of_a_storage_counts(spark):
    day = dt.date(2024, 3, 1)
    rows = [(1, "Zeta", day, 1), (1, "Alpha", day, 2), (2, "Old", day, 9), (2, "New", dt.date(2024, 3, 2), 1), (3, "B", None, None), (3, "A", None, None)]
    rows += [(4, "A", day, None), (4, "B", None, 5), (5, None, day, 9), (5, "kept", day, 1), (None, "x", day, 1)]
    df = spark.createDataFrame(rows, "storage_id int, storage_name string, day date, place long")
    found = dict(pairs_by_id(df, "storage_id", "storage_name", "day", "place").collect())
    assert found == {1: "Alpha", 2: "New", 3: "B", 4: "A", 5: "kept"}


def test_places_of_landed_answers(spark, tmp_path):
    folder = tmp_path / "inv_import" / "report_date=2024-03-01"
    folder.mkdir(parents=True)
    rows = [{"stock_import": 7, "stock_name": n} for n in ("Zeta", "Alpha")]
    (folder / "a.json").write_text(json.dumps({"data": rows}))
    fact = EnvelopeTables(spark, str(tmp_path)).fact("inv_import", *ALWAYS, placed=True)
    assert dict(pairs_by_id(fact, "stock_import", "stock_name", "report_date", "answer_place").collect()) == {7: "Alpha"}


def test_pages_of_a_stored_report(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), k % 50) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(7)
    pages = store_pages(df, ["k", "n"], f"{tmp_path}/pages", ranges=9)
    last = lambda x: (x is None, x or 0 if not isinstance(x, str) else x)
    ordered = sorted(rows, key=lambda r: tuple(map(last, r)))
    assert len(pages) == 500 and len([c for c in pages.counts if c]) > 3
    for number, size in ((0, 10), (3, 60), (7, 70), (1, 400), (0, 500), (9, 60), (50, 10)):
        found = [tuple(r) for r in pages.page(number, size).collect()]
        assert found == ordered[number * size : (number + 1) * size]
    plan = pages.page(3, 60)._jdf.queryExecution().executedPlan().toString()
    assert "page_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    none = store_pages(df.limit(0), ["k"], f"{tmp_path}/none")
    assert none.page(0, 10).collect() == [] and len(none) == 0


def test_pages_behind_a_key_with_nulls(spark):
    rows = [(a, b) for a in ("x", "y", None) for b in (1, 2, None)]
    df = spark.createDataFrame(rows, "a string, b int")
    found, after = [], None
    while len(found) < 20:
        page = [tuple(r) for r in page_after(df, ["a", "b"], after, 2).collect()]
        if not page:
            break
        found += page
        after = page[-1]
    assert found == rows


def test_only_keys_with_an_amount_are_shuffled(spark):
    fine = spark.range(20_000).selectExpr("CAST(id % 10000 AS STRING) AS invoice", "id % 3 AS cashier")
    fine = fine.union(spark.sql("SELECT 'None', 7L"))
    coarse = spark.range(0, 10_000, 100).selectExpr("CAST(id AS STRING) AS invoice", "id AS v")
    coarse = coarse.union(spark.sql("SELECT 'None', 1L"))
    kept = likely_among(fine, coarse, ["invoice"])
    true = {r[0] for r in coarse.select("invoice").collect()}
    rows = kept.collect()
    assert {r["invoice"] for r in rows} >= true
    assert len([r for r in rows if r["invoice"] not in true]) < 20
    few = likely_among(fine, coarse, ["invoice"], bits=64)  # a filter that is full only passes more
    assert {r["invoice"] for r in few.collect()} >= true
    out = attach_coarse(fine, coarse, ["invoice"])
    assert out.count() == fine.join(coarse.select("invoice"), "invoice").distinct().count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter") :]
    assert below.index("Aggregate") < below.index("getbit")  # rows are passed over before the distinct
    none = likely_among(fine, coarse.limit(0), ["invoice"])
    assert none.count() == 0


def test_each_written_document_is_one_file(spark, tmp_path):
    """Its first and last line must not end up in files of their own, however tasks are put together."""
    rows = spark.range(2_000).selectExpr("CAST(id AS STRING) AS hfe_invoiceno", "concat(sha2(id || 'a', 512), sha2(id || 'b', 512)) AS thungan")
    rows = rows.union(rows.limit(100)).union(rows.selectExpr("CAST(NULL AS STRING)", "thungan").limit(3))
    options = {"coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1k", "advisoryPartitionSizeInBytes": "64k"}
    options = {f"spark.sql.adaptive.{name}": value for name, value in options.items()}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        registry._whole_documents(rows, str(tmp_path / "w"), per_document=300)
    finally:
        for name in options:
            spark.conf.unset(name)
    found = []
    for folder in (tmp_path / "w").glob("d=*"):
        (file,) = folder.glob("*.txt")
        assert file.read_text().startswith('{"status": "{", "data": [\n{')
        found += [(r.get("hfe_invoiceno"), r["thungan"]) for r in json.loads(file.read_text())["data"]]
    assert sorted(found, key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_envelopes_are_landed_compressed(spark, tmp_path):
    """Rows without a day too; what is written is far less than the text, and reads as before."""
    rows = spark.range(3_000).selectExpr("CAST(id AS STRING) AS hfe_invoiceno", "if(id % 3 = 0, NULL, DATE'2024-03-01') AS report_date")
    lines = registry._envelopes(rows)
    registry._store_envelopes(lines, str(tmp_path / "deposit"))
    size = sum(f.stat().st_size for f in (tmp_path / "deposit").glob("*/part-*"))
    assert size * 3 < lines.selectExpr("sum(length(value) + 1)").first()[0]
    got = EnvelopeTables(spark, str(tmp_path)).fact("deposit", *ALWAYS)
    assert sorted(r[0] for r in got.select("hfe_invoiceno").collect()) == sorted(map(str, range(3_000)))
