"""Writers for report results, facts and dimension members, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from soquy.sources.schemas import PERIOD_COLUMN


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export a result table. The row order of the report is the order of the part files."""
    if fmt == "csv":
        df.write.csv(path, header=True)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError("fmt must be csv or parquet")


def write_dim(df: DataFrame, path: str) -> None:
    """Append new dimension members, those of ``new_members``."""
    df.write.mode("append").parquet(path)


def store_dim(df: DataFrame, path: str) -> None:
    """Store a whole dimension, such as one with filled names, at a new path; fails if there is
    anything. The caller then reads from there, so a lost job leaves the old one as it was."""
    df.write.mode("errorifexists").parquet(path)


def write_fact(df: DataFrame, root: str, name: str) -> None:
    """Land a fact by reported day: the days it brings replace those landed before, the others stay.

    Rows of a day are spread over tasks by the writer's own rebalance, which also splits a day that
    is far larger than the others.
    """
    rows = df.hint("rebalance", PERIOD_COLUMN).write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD_COLUMN).parquet(f"{root}/{name}")


def work_dir(spark: SparkSession) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``; where that
    is unset, below the warehouse, which is shared as well."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/soquy-{uuid.uuid4().hex}"
