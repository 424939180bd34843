"""Grouped sums.

Every sum is a partial-then-final aggregate, so a key that holds a large share of the rows is
reduced on each mapper before it is shuffled. A report with many measures first gives each row a
kind (its category, its cash movement) and sums by key and kind: one or few running sums per row
instead of one per measure, and narrow rows in the shuffle. What is left, at most one row per key
and kind, then becomes columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.nulls import constant, or_zero
from soquy.operators.shape import CATEGORY_COLUMNS
from soquy.sources.schemas import MONEY

KIND = "kind"


@dataclass(frozen=True)
class Source:
    """Rows, the kind of each as SQL (null: the row takes no part) and the amounts it brings."""

    df: DataFrame
    kind: str
    amounts: Mapping[str, str]


@dataclass(frozen=True)
class Measure:
    """Sum of an amount over the rows of some kinds, or of every kind."""

    name: str
    amount: str
    kinds: tuple[str, ...] = ()

    def sql(self) -> str:
        value = self.amount
        if self.kinds:
            kinds = ", ".join(map(constant, self.kinds))
            value = f"CASE WHEN {KIND} IN ({kinds}) THEN {value} END"
        return f"coalesce(sum({value}), 0) AS {self.name}"


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))


def total(column: str) -> str:
    """Sum that is 0 where there is nothing to add.

    The addend is made non-null as well: the engine would otherwise evaluate it a second time to
    see whether it is null.
    """
    return f"{or_zero(f'sum({or_zero(column)})')} AS {column}"


def aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*map(F.expr, columns))


def sum_by(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], keep_null_keys: bool = False
) -> DataFrame:
    """Sums by key; rows with a null key are dropped unless kept on purpose."""
    rows = df if keep_null_keys else drop_null_keys(df, keys)
    return aggregate(rows, keys, [total(c) for c in columns])


def resum(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums at a coarser key, null keys kept."""
    return sum_by(df, keys, columns, keep_null_keys=True)


def _money(amount: str) -> str:
    return f"CAST({amount} AS {MONEY.simpleString()})"


def kind_rows(
    sources: Sequence[Source], keys: Sequence[str], keep_null_keys: bool = False
) -> DataFrame:
    """Keys, kind and amounts of the rows that take part, from all sources."""
    names = list(dict.fromkeys(a for s in sources for a in s.amounts))
    parts = []
    for s in sources:
        own = {a: or_zero(_money(amount)) for a, amount in s.amounts.items()}
        amounts = [f"{own.get(a, _money('NULL'))} AS {a}" for a in names]
        rows = s.df.selectExpr(*keys, f"{s.kind} AS {KIND}", *amounts)
        parts.append(drop_null_keys(rows, [KIND, *([] if keep_null_keys else keys)]))
    return reduce(DataFrame.union, parts)


def sum_kinds(rows: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """One row per key and kind."""
    return aggregate(rows, [*keys, KIND], [f"sum({a}) AS {a}" for a in amounts])


def kinds_as_columns(
    sums: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Kinds side by side. Rows are brought together by key before the wide aggregate, so what
    is shuffled is one narrow row per key and kind."""
    return aggregate(sums.repartition(*keys), keys, columns)


def sum_sources(
    sources: Sequence[Source],
    keys: Sequence[str],
    measures: Sequence[Measure],
    keep_null_keys: bool = False,
    fine: bool = False,
) -> DataFrame:
    """Measures of several sources side by side at one key.

    Takes the place of a chain of full outer joins between tables summed at that key: a union of
    the rows, whatever the number of sources, and no join. ``fine`` is for keys nearly as many as
    the rows, where summing by kind first would not make them fewer.
    """
    rows = kind_rows(sources, keys, keep_null_keys)
    columns = [m.sql() for m in measures]
    if fine:
        return aggregate(rows, keys, columns)
    amounts = list(dict.fromkeys(m.amount for m in measures))
    return kinds_as_columns(sum_kinds(rows, keys, amounts), keys, columns)


# ---- categories -----------------------------------------------------------------------------

RETAIL = "retail"
_CODES = ", ".join(map(constant, CATEGORY_COLUMNS))

# Kind of a line by category alone, by category or retail, and with a kind for every other line.
CATEGORY_KIND = f"CASE WHEN hft_id2 IN ({_CODES}) THEN hft_id2 END"
CATEGORY_OR_RETAIL_KIND = (
    f"CASE WHEN drug_retail = 'Y' THEN '{RETAIL}' "
    f"WHEN drug_retail = 'N' AND hft_id2 IN ({_CODES}) THEN hft_id2 END"
)
ANY_CATEGORY_KIND = f"coalesce({CATEGORY_KIND}, '')"
ANY_CATEGORY_OR_RETAIL_KIND = f"coalesce({CATEGORY_OR_RETAIL_KIND}, '')"


def category_measures(amount: str) -> list[Measure]:
    return [Measure(name, amount, (code,)) for code, name in CATEGORY_COLUMNS.items()]


def retail_measure(amount: str) -> Measure:
    return Measure("drug_retail", amount, (RETAIL,))


def category_pivot(
    df: DataFrame, keys: Sequence[str], value: str = "revenue", keep_null_keys: bool = False
) -> DataFrame:
    """Category codes as columns; lines with an unknown code make no group."""
    source = Source(df, CATEGORY_KIND, {value: value})
    return sum_sources([source], keys, category_measures(value), keep_null_keys)


# ---- members --------------------------------------------------------------------------------


def distinct_members(df: DataFrame, column: str) -> DataFrame:
    return drop_null_keys(df.select(column), [column]).distinct()


def pairs_by_id(
    df: DataFrame, id_column: str, name_column: str, day: str | None = None, place: str | None = None
) -> DataFrame:
    """One name per id: the one of the last row by ``day`` (a date) and ``place`` (a whole number),
    nulls first. Without an order a table has no last row, and the largest name is taken; so it is
    among rows of one day and place.

    A name needs a sort aggregate; pairs come together first, by hash, with the last time each was
    seen as one number, so that few rows are sorted.
    """
    if day is None and place is None:
        seen = "0"
    else:
        days = f"coalesce(datediff({day}, DATE'0001-01-01'), -1)" if day else "0"
        seen = f"CAST({days} AS DECIMAL(18,0)) * {1 << 64}BD + coalesce({place or '0'}, {-(1 << 63) + 1})"
    rows = drop_null_keys(df, [id_column, name_column])
    rows = rows.selectExpr(id_column, name_column, f"CAST({seen} AS DECIMAL(38,0)) AS seen")
    pairs = aggregate(rows, [id_column, name_column], ["max(seen) AS seen"])
    last = f"max_by({name_column}, struct(seen, {name_column})) AS {name_column}"
    return aggregate(pairs, [id_column], [last])
