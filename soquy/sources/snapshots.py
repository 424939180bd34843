"""Facts landed by snapshots: new files first, then one record that names them.

``<root>/<fact>/data/batch=<id>/report_date=<day>/`` holds the rows, ``<root>/<fact>/commits/`` one
small file for each landing: the days it brought, the batch that holds them, and its version. A reader
takes for each day the batch of the highest version. So a landing that is lost before its record is
written leaves every day as it was, a reader never sees half of a landing, and one that has begun
reads on, because nothing is overwritten.

Two landings at the same time have the same version; of days that both bring, all readers take those
of the batch with the larger id. Batches that no day points to any more are named by ``replaced``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.sources.schemas import PERIOD_COLUMN, stored_schema
from soquy.sources.tables import ParquetTables, empty, in_period

BATCH = "batch"
_COMMITS = T.StructType(
    [
        T.StructField(PERIOD_COLUMN, T.DateType()),
        T.StructField(BATCH, T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("has_rows", T.BooleanType()),
    ]
)
# Fixed value: how a partition folder names a missing day.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def stage_fact(df: DataFrame, root: str, name: str) -> str:
    """Write the rows as a batch of its own, which no reader sees yet; returns its id.

    Rows of a day are spread over tasks by the writer's own rebalance.
    """
    batch = uuid.uuid4().hex
    rows = df.hint("rebalance", PERIOD_COLUMN).write.mode("errorifexists")
    rows.partitionBy(PERIOD_COLUMN).parquet(f"{root}/{name}/data/{BATCH}={batch}")
    return batch


def commits(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The records of all landings; fails with PATH_NOT_FOUND where there is none."""
    return spark.read.schema(_COMMITS).parquet(f"{root}/{name}/commits")


def commit_fact(spark: SparkSession, root: str, name: str, batch: str, days: Iterable[str] = ()) -> None:
    """Make a staged batch the state of the days it brings, and of ``days`` (``YYYY-MM-DD``), which are
    left without rows where it has none. One file is written, which is there as a whole or not at all."""
    path = f"{root}/{name}/data/{BATCH}={batch}"
    given = empty(spark, T.StructType([_COMMITS[PERIOD_COLUMN]]))
    for day in days:
        given = given.union(spark.sql(f"SELECT DATE'{day}'"))
    brought = spark.read.schema(given.schema).parquet(path).distinct()
    try:
        version = (commits(spark, root, name).agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        version = 1
    record = brought.withColumn("has_rows", F.lit(True)).union(given.withColumn("has_rows", F.lit(False)))
    record = record.groupBy(PERIOD_COLUMN).agg(F.max("has_rows").alias("has_rows"))
    record = record.select(PERIOD_COLUMN, F.lit(batch).alias(BATCH), F.lit(version).cast("long").alias("version"), "has_rows")
    record.coalesce(1).write.mode("append").parquet(f"{root}/{name}/commits")


def land_fact(df: DataFrame, root: str, name: str, days: Iterable[str] = ()) -> str:
    """Land a fact by reported day: the days it brings, and ``days``, replace those landed before;
    the others stay."""
    batch = stage_fact(df, root, name)
    commit_fact(df.sparkSession, root, name, batch, days)
    return batch


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(report_date, batch, has_rows): the batch that holds each landed day."""
    last = F.max_by(F.struct(BATCH, "has_rows"), F.struct("version", BATCH)).alias("last")
    return commits(spark, root, name).groupBy(PERIOD_COLUMN).agg(last).select(PERIOD_COLUMN, "last.*")


def replaced(spark: SparkSession, root: str, name: str) -> list[str]:
    """Batches that were committed once and hold no day any more."""
    held = current(spark, root, name).where("has_rows").select(BATCH)
    rows = commits(spark, root, name).select(BATCH).distinct().join(held, BATCH, "left_anti").collect()
    return sorted(r[0] for r in rows)


class SnapshotTables(ParquetTables):
    """Facts landed by ``land_fact``. A table reads the state of the moment it is asked for a fact."""

    def _stored(self, name: str, from_date: str, to_date: str) -> DataFrame:
        days = in_period(current(self.spark, self.root, name), from_date, to_date).where("has_rows").collect()
        base = f"{self.root}/{name}/data"
        folders = [f"{base}/{BATCH}={r[BATCH]}/{PERIOD_COLUMN}={r[PERIOD_COLUMN] or _NO_DAY}" for r in days]  # one a day
        if not folders:
            return empty(self.spark, stored_schema(name))
        fields = [*stored_schema(name), T.StructField(BATCH, T.StringType())]
        stored = self.spark.read.schema(T.StructType(fields)).option("basePath", base).parquet(*folders)
        return in_period(stored.drop(BATCH), from_date, to_date)
