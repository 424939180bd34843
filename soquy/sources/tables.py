"""Readers that hand the reports their facts, limited to a period.

A fact lives under ``<root>/<fact>/report_date=YYYY-MM-DD/``, as Parquet or as the JSON envelopes
``{"data": [...]}`` the source system answers with. The period is a predicate on the partition
column, so days outside it are never listed; category and storage predicates reach the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.functions.nulls import ensure_columns
from soquy.operators.shape import CATEGORY_COLUMNS
from soquy.sources.documents import read_whole
from soquy.sources.schemas import (
    BROKEN,
    FACTS,
    PERIOD_COLUMN,
    PLACE_COLUMN,
    STORAGE_COLUMN,
    envelope_schema,
    raw_schema,
    stored_schema,
    typed,
)


# Both ends of a period that holds every row, those without a day too.
ALL_DAYS = "*"
ORDER = (PERIOD_COLUMN, PLACE_COLUMN)


def parse_period(from_date: str, to_date: str) -> tuple[dt.date, dt.date]:
    """Both ends are required, written ``YYYY-MM-DD``, and belong to the period."""
    if not from_date or not to_date:
        raise ValueError("a report needs both from_date and to_date")
    return tuple(dt.datetime.strptime(d, "%Y-%m-%d").date() for d in (from_date, to_date))


def check_category(category: str) -> str:
    if category not in CATEGORY_COLUMNS:
        raise ValueError(f"category must be one of {', '.join(CATEGORY_COLUMNS)}")
    return category


def in_period(
    df: DataFrame, from_date: str, to_date: str, column: str = PERIOD_COLUMN
) -> DataFrame:
    if from_date == to_date == ALL_DAYS:
        return df
    first, last = parse_period(from_date, to_date)
    return df.where(f"{column} BETWEEN DATE'{first}' AND DATE'{last}'")


def narrow(
    df: DataFrame, name: str, category: str | None, storage_ids: Iterable[int] | None
) -> DataFrame:
    """Category and storage predicates; an empty storage list means every storage."""
    if category is not None:
        df = df.where(F.col("hft_id2") == check_category(category))
    ids = [int(i) for i in storage_ids or ()]
    if ids:
        df = df.where(F.col(STORAGE_COLUMN[name]).isin(ids))
    return df


def records(docs: DataFrame, schema: T.StructType, *others: str) -> DataFrame:
    """The records of read documents, typed, and their place in the document. A broken document
    fails the query."""
    text = T.ArrayType(raw_schema(schema)).simpleString()
    data = (
        f"CASE WHEN {BROKEN} IS NOT NULL THEN raise_error(concat('broken document: ', left({BROKEN}, 200))) "
        f"WHEN ltrim(data) LIKE '[%' THEN from_json(data, '{text}', map('mode', 'FAILFAST')) END"
    )
    listed = docs.selectExpr(f"posexplode({data}) AS ({PLACE_COLUMN}, record)", *others)
    listed = listed.where("record IS NOT NULL").selectExpr("record.*", f"CAST({PLACE_COLUMN} AS BIGINT) AS {PLACE_COLUMN}", *others)
    return listed.selectExpr(*typed(schema), PLACE_COLUMN, *others)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line, columnNameOfCorruptRecord=BROKEN)


def read_envelope(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, split: bool = True
) -> DataFrame:
    """Records under ``data``. A null, absent or non-list ``data`` gives no rows; a document that is
    cut off or no JSON, and a number that does not fit its column, fail the query.

    One document per line is the form to land answers in. With ``multi_line`` a file is one document,
    which many tasks read; ``split=False`` leaves it to one task, for documents with other objects
    beside their data.
    """
    if multi_line and split:
        return read_whole(spark, path, schema).select(*schema.names)
    return records(read_documents(spark, path, envelope_schema(), multi_line), schema).select(*schema.names)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def check_missing(missing: str) -> str:
    if missing not in ("raise", "empty"):
        raise ValueError("missing must be raise or empty")
    return missing


class ParquetTables:
    """Facts landed as Parquet, one directory per reported day.

    A fact that was never landed fails the report, as a mistyped folder would otherwise read as a
    period without rows; ``missing="empty"`` asks for the empty fact.
    """

    def __init__(self, spark: SparkSession, root: str, missing: str = "raise"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.missing = check_missing(missing)

    def _stored(self, name: str, from_date: str, to_date: str) -> DataFrame:
        stored = self.spark.read.schema(stored_schema(name)).parquet(f"{self.root}/{name}")
        return in_period(stored, from_date, to_date)

    def fact(
        self,
        name: str,
        from_date: str,
        to_date: str,
        category: str | None = None,
        storage_ids: Iterable[int] | None = None,
        columns: Iterable[str] | None = None,
        placed: bool = False,
    ) -> DataFrame:
        """``columns`` is a hint for readers that build a fact; here Catalyst prunes the scan.
        ``placed`` adds the day and the place in the answer."""
        if from_date != ALL_DAYS:
            parse_period(from_date, to_date)
        try:
            stored = self._stored(name, from_date, to_date)
        except AnalysisException as error:
            if self.missing == "raise" or error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = empty(self.spark, stored_schema(name))
        df = narrow(stored, name, category, storage_ids)
        return df.select(*FACTS[name].names, *(ORDER if placed else ()))


class EnvelopeTables(ParquetTables):
    """Facts landed as JSON envelopes, one directory per reported day; ``multi_line`` and ``split`` as
    for ``read_envelope``."""

    def __init__(
        self, spark: SparkSession, root: str, multi_line: bool = False, missing: str = "raise", split: bool = True
    ):
        super().__init__(spark, root, missing)
        self.multi_line = multi_line
        self.split = split

    def _stored(self, name: str, from_date: str, to_date: str) -> DataFrame:
        path, day = f"{self.root}/{name}", T.StructField(PERIOD_COLUMN, T.DateType())
        if self.multi_line and self.split:
            wanted = lambda df: in_period(df, from_date, to_date)
            return read_whole(self.spark, path, FACTS[name], [day], wanted)
        docs = read_documents(self.spark, path, envelope_schema().add(day), self.multi_line)
        return records(in_period(docs, from_date, to_date), FACTS[name], PERIOD_COLUMN)


class FrameTables:
    """Facts already at hand as DataFrames. An absent one fails, or is empty if that is asked for.

    A frame without the period column is taken to be the period asked for.
    """

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], missing: str = "raise"):
        self.spark = spark
        self.frames = dict(frames)
        self.missing = check_missing(missing)

    def fact(
        self, name, from_date, to_date, category=None, storage_ids=None, columns=None, placed=False
    ) -> DataFrame:
        if from_date != ALL_DAYS:
            parse_period(from_date, to_date)
        df = self.frames.get(name)
        if df is None:
            if self.missing == "raise":
                raise KeyError(f"no frame for {name}")
            df = empty(self.spark, FACTS[name])
        if PERIOD_COLUMN in df.columns:
            df = in_period(df, from_date, to_date)
        if placed:
            df = ensure_columns(df, {PLACE_COLUMN: "bigint", PERIOD_COLUMN: "date"})
        return narrow(df, name, category, storage_ids)
