"""Dimension maintenance. Nothing is written as a side effect: ``new_members`` are rows to append,
the upserts are whole dimensions to store at a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soquy.functions.nulls import is_blank
from soquy.operators.joins import missing_members
from soquy.operators.setops import union_padded


def new_members(dim: DataFrame, values: DataFrame) -> DataFrame:
    """The members the dimension lacks, with nulls in its other columns. ``values`` has the key
    column, distinct."""
    (key,) = values.columns
    return union_padded(dim.limit(0), missing_members(values, dim, key)).select(*dim.columns)


def upsert_members(dim: DataFrame, values: DataFrame) -> DataFrame:
    """The whole dimension with the members it lacked."""
    return dim.union(new_members(dim, values))


def upsert_storage(dim: DataFrame, pairs: DataFrame) -> DataFrame:
    """New storages inserted and blank names filled; a name that is set is never replaced."""
    stored = dim.selectExpr("storage_id", "storage_name AS old", "true AS known")
    merged = stored.join(pairs.withColumnRenamed("storage_name", "new"), "storage_id", "full")
    fill = f"known IS NULL OR ({is_blank('old')} AND new <> '')"
    return merged.selectExpr("storage_id", f"if({fill}, new, old) AS storage_name")


def storage_changes(dim: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``upsert_storage`` that are new or have got a name: what is appended to a dimension
    stored by versions."""
    merged = upsert_storage(dim, pairs).withColumnRenamed("storage_name", "name")
    stored = dim.selectExpr("storage_id AS stored_id", "storage_name AS old")
    both = merged.join(stored, merged.storage_id == stored.stored_id, "left")
    changed = both.where("stored_id IS NULL OR NOT (name <=> old)")
    return changed.selectExpr("storage_id", "name AS storage_name")
