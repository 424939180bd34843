"""Joins and the aggregates that take the place of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.nulls import or_zero
from soquy.operators.checks import INSURED
from soquy.operators.shape import CATEGORIES
from soquy.operators.sums import (
    ANY_CATEGORY_KIND,
    KIND,
    Source,
    aggregate,
    category_measures,
    kind_rows,
    kinds_as_columns,
    sum_kinds,
)


FILTER_BITS = 1 << 22
"""Bits of the filter that stands for a set of keys; its size does not depend on their number."""


def likely_among(
    rows: DataFrame, members: DataFrame, keys: Sequence[str], bits: int = FILTER_BITS
) -> DataFrame:
    """The rows whose keys are among those of ``members``, and a few others.

    A runtime filter: every key of ``members`` sets one bit, by its hash. The bits are the value of
    one scalar subquery, 512 KB whatever the number of keys, so rows are passed over where they are
    read, before anything of them is shuffled. With as many keys as bits it lets most rows pass and
    saves little; results never depend on it.
    """
    words = bits // 64
    hashed = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = members.select(hashed.alias("place")).selectExpr(
        "place DIV 64 AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS mark"
    )
    none = rows.sparkSession.range(0, words, 1, 1).selectExpr("id AS word", "0L AS mark")
    table = marks.union(none).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    table = table.agg(F.array_sort(F.collect_list(F.struct("word", "mark"))).alias("table"))
    value = table.selectExpr("transform(table, x -> x.mark) AS marks").scalar()
    bit = F.getbit(F.get(value, F.shiftright(hashed, 6).cast("int")), (hashed % 64).cast("int"))
    return rows.where(bit == 1)


def attach_coarse(
    fine: DataFrame,
    coarse: DataFrame,
    keys: Sequence[str],
    mode: str = "compat",
    rows: DataFrame | None = None,
) -> DataFrame:
    """Put amounts known at a coarse key on the finer keys that share it.

    ``fine`` is rows of finer keys, ``coarse`` one row per ``keys``. ``compat`` repeats an amount
    on every finer key, ``exact`` puts it on the smallest one only. An amount without a finer key
    stays, with nulls. Only keys are shuffled, and of these only such as have an amount: the caller
    adds the result to its own measures as one more source, so no wide row takes part in the join.
    ``rows`` are those ``coarse`` was summed from, whose keys can be told before they are summed.
    """
    if mode not in ("compat", "exact"):
        raise ValueError("mode must be compat or exact")
    owners = likely_among(fine, coarse if rows is None else rows, keys).distinct()
    if mode == "exact":
        rest = [c for c in fine.columns if c not in keys]
        smallest = aggregate(owners, keys, [f"min(struct({', '.join(rest)})) AS smallest"])
        owners = smallest.select(*keys, "smallest.*")
    return coarse.join(owners, list(keys), "left")


def receivable_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receivables per payer at the full key, in one aggregate.

    A key of payer 1 and a key of payer 3 make one line each. Amounts owed by the insurance
    (payer 1) and by the second fund (payer 2) are attached to every line of their key, so a key
    with two lines carries them twice. Keys with a null belong to payer 3 alone.
    """
    keyed = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    rows = rows.where(f"receipt_object = 3 OR (receipt_object IN (1, 2) AND {keyed})")

    def owed(payer: int, amount: str, other: str = "0") -> str:
        return f"if(receipt_object = {payer}, {amount}, {other})"

    lines = " + ".join(f"max({owed(n, '1')})" for n in (1, 3))
    payable = owed(1, or_zero("bqp"), owed(3, INSURED))
    sums = aggregate(
        rows,
        keys,
        [
            f"{lines} AS lines",
            f"sum({owed(1, or_zero('insurance'))}) AS hn",
            f"sum({owed(2, INSURED)}) AS bqp",
            f"sum({payable}) AS cuctaichinh",
        ],
    )
    return sums.selectExpr(
        *keys,
        "if(lines = 2, hn * 2, hn) AS insurance_hn_receivable",
        "if(lines = 2, bqp * 2, bqp) AS insurance_bqp_receivable",
        "cuctaichinh AS cuctaichinh_bqp_receivable",
    )


def cogs_with_pivot(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost of goods for every key, null keys included, beside the category pivot.

    The pivot knows neither null keys nor unknown codes; where it has no line its columns are
    null, not 0. The same aggregate decides both.
    """
    amounts = {"revenue": "revenue", "cogs_drug_retail": "cogs_drug_retail"}
    lines = kind_rows([Source(rows, ANY_CATEGORY_KIND, amounts)], keys, keep_null_keys=True)
    columns = [m.sql() for m in category_measures("revenue")]
    coded = f"count_if({KIND} <> '') AS coded"
    cogs = "coalesce(sum(cogs_drug_retail), 0) AS cogs_drug_retail"
    sums = kinds_as_columns(
        sum_kinds(lines, keys, list(amounts)), keys, [cogs, coded, *columns]
    )
    has_line = " AND ".join([*(f"{k} IS NOT NULL" for k in keys), "coded > 0"])
    cells = [f"CASE WHEN {has_line} THEN {c} END AS {c}" for c in CATEGORIES]
    return sums.selectExpr(*keys, "cogs_drug_retail", *cells)


def missing_members(new: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """New members the dimension does not hold yet."""
    return new.join(dim, key, "left_anti")
