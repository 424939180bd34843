"""What a reader of a report does with it: order, page, total row, number text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.functions.nulls import constant
from soquy.functions.text import dot_thousands
from soquy.operators.setops import union_padded
from soquy.operators.shape import TOTAL_LABEL
from soquy.operators.sums import total

TOTAL_FLAG = "is_total"


def order_report(
    df: DataFrame, columns: Sequence[str], ordered: bool = True, ties: Sequence[str] = ()
) -> DataFrame:
    """Ascending, nulls last. A caller that sums, filters or stores the rows passes
    ``ordered=False`` and saves the range shuffle.

    ``ties`` is the rest of the key. Rows with equal order columns can only be spread over tasks
    if the order goes on, and few cashiers or classes may share most of the rows.
    """
    if not ordered:
        return df
    order = dict.fromkeys([*columns, *ties])
    return df.orderBy(*[F.asc_nulls_last(c) for c in order])


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of the rows in ascending order; the other columns break ties."""
    rest = [c for c in df.columns if c != order]
    return order_report(df, [order, *rest]).offset(number * size).limit(size)


PART_COLUMN = "page_part"


@dataclass(frozen=True)
class Pages:
    """A report kept for paging: ranges of its order, stored apart, and the rows of each.

    A page reads and sorts only the ranges it lies in, and every page shows the same state of the
    report. Nulls come last; the other columns break ties.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[str, ...]
    counts: tuple[int, ...]

    def __len__(self) -> int:
        return sum(self.counts)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 0; empty behind the last."""
        first, before, chosen, skipped = number * size, 0, [], 0
        for part, rows in enumerate(self.counts):
            if before < first + size and before + rows > first:
                if not chosen:
                    skipped = before
                chosen.append(part)
            before += rows
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        rows = stored.where(F.col(PART_COLUMN).isin(chosen)).drop(PART_COLUMN)
        return order_report(rows, self.order).offset(max(0, first - skipped)).limit(size)


def store_pages(df: DataFrame, order: Sequence[str], path: str, ranges: int | None = None) -> Pages:
    """Bring the rows into ranges of their order, store these at a new path and count each.

    The rows are not sorted here: the ranges hold about equally many, and a page sorts its own.
    ``ranges`` is left to Spark by default.
    """
    columns = tuple(dict.fromkeys([*order, *df.columns]))
    dealt = [] if ranges is None else [ranges]
    ranged = df.repartitionByRange(*dealt, *[F.asc_nulls_last(c) for c in columns])
    ranged = ranged.withColumn(PART_COLUMN, F.spark_partition_id())
    ranged.write.mode("errorifexists").partitionBy(PART_COLUMN).parquet(path)
    stored = df.sparkSession.read.schema(ranged.schema).parquet(path)
    found = dict(stored.groupBy(PART_COLUMN).count().collect())  # a number for each range
    counts = tuple(found.get(k, 0) for k in range(max(found, default=-1) + 1))
    return Pages(df.sparkSession, path, ranged.schema, columns, counts)


def page_after(df: DataFrame, order: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The next ``size`` rows in ascending order, nulls last, behind the row whose order columns are
    ``after`` (None: the first page). The order columns tell rows apart; the cost does not grow with
    the number of pages before."""
    if after is not None:
        behind = [
            " AND ".join([*(f"{c} <=> {constant(v)}" for c, v in zip(order[:k], after[:k], strict=True)), _later(order[k], after[k])])
            for k in range(len(order))
        ]
        df = df.where(" OR ".join(f"({b})" for b in behind))
    return order_report(df, order).limit(size)


def _later(column: str, value) -> str:
    return "false" if value is None else f"({column} > {constant(value)} OR {column} IS NULL)"


def with_grand_total(
    df: DataFrame, measures: Sequence[str], label: str = TOTAL_LABEL, flag: bool = False
) -> DataFrame:
    """Append a row with the sums of the measures and the label in the first column, which becomes
    text if it is not.

    The rows and the total come from the same aggregate, whose shuffle is computed once. With
    ``flag`` the total row is marked, to keep it last in an order.
    """
    first = df.columns[0]
    label = f"{constant(label)} AS {first}"
    last = df.agg(*[F.expr(total(m)) for m in measures]).selectExpr(label, "*")
    df = df.withColumn(first, F.col(first).cast("string"))
    if flag:
        df = df.selectExpr("*", f"0 AS {TOTAL_FLAG}")
        last = last.selectExpr("*", f"1 AS {TOTAL_FLAG}")
    return union_padded(df, last)


def number_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expr(dot_thousands(c)) for c in columns})


def option_list(dim: DataFrame, column: str, *shown: str) -> DataFrame:
    """Choices for a filter, with the columns that are shown for them."""
    return order_report(dim.select(column, *shown), [column, *shown])
