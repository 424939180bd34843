"""Dimensions stored by versions, so that repeated and concurrent appends keep every member once.

``<path>/version=<n>/attempt=<id>/`` holds what one append added. An append names the version it was
made from; if another one has been stored since, it is refused, and the caller makes it anew from the
present members. The same attempt is stored once, however often it is run. Two appends that still
cross (both looked before either wrote) do no harm: a reader takes each member once, and of its
other columns the first value that was set, by version and attempt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.functions.nulls import is_blank

VERSION, ATTEMPT = "version", "attempt"


class StaleVersion(RuntimeError):
    """The dimension has moved on since the members were read that an append was made from."""


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    order = [T.StructField(VERSION, T.LongType()), T.StructField(ATTEMPT, T.StringType())]
    try:
        return spark.read.schema(T.StructType([*schema, *order])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, path: str) -> int:
    """The version to append to; 0 where nothing is stored."""
    stored = _stored(spark, path, T.StructType([]))
    return 0 if stored is None else stored.agg(F.max(VERSION)).first()[0] or 0


def append_version(df: DataFrame, path: str, base: int, attempt: str | None = None) -> int:
    """Store members made from version ``base`` as the next version, which is returned.

    With the id of an ``attempt`` that is stored already, nothing is written and its version returned.
    """
    spark = df.sparkSession
    if attempt is not None and (stored := _stored(spark, path, T.StructType([]))) is not None:
        done = stored.where(F.col(ATTEMPT) == attempt).agg(F.max(VERSION)).first()[0]
        if done is not None:
            return done
    now = current_version(spark, path)
    if now != base:
        raise StaleVersion(f"{path} is at version {now}, not {base}")
    rows = df.withColumns({VERSION: F.lit(base + 1).cast("long"), ATTEMPT: F.lit(attempt or uuid.uuid4().hex)})
    rows.write.mode("append").partitionBy(VERSION, ATTEMPT).parquet(path)
    return base + 1


def read_members(
    spark: SparkSession, path: str, schema: T.StructType, key: str, version: int | None = None
) -> DataFrame:
    """Each member once, as of ``version`` (None: now). A text that is blank counts as not set."""
    stored = _stored(spark, path, schema)
    if stored is None:
        return spark.createDataFrame([], schema)
    if version is not None:
        stored = stored.where(F.col(VERSION) <= version)
    first = f"struct({VERSION}, {ATTEMPT})"
    values = []
    for field in schema:
        if field.name != key:
            blank = is_blank(field.name) if isinstance(field.dataType, T.StringType) else f"{field.name} IS NULL"
            set_ = f"min_by({field.name}, {first}) FILTER (WHERE NOT ({blank}))"
            values.append(F.expr(f"coalesce({set_}, min_by({field.name}, {first})) AS {field.name}"))
    if not values:
        return stored.select(key).distinct()
    return stored.groupBy(key).agg(*values).select(*schema.names)


def append_members(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    lacking: Callable[[DataFrame], DataFrame],
    tries: int = 5,
) -> int:
    """Append what ``lacking`` finds missing in the present members; made anew where another append
    was faster. Returns the version that holds them, which is the present one if nothing is missing."""
    for _ in range(tries):
        base = current_version(spark, path)
        rows = lacking(read_members(spark, path, schema, key, base))
        if base and rows.isEmpty():
            return base
        try:
            return append_version(rows, path, base)
        except StaleVersion:
            continue
    raise StaleVersion(f"{path}: {tries} appends in a row were overtaken")
