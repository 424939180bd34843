"""Unions."""

from functools import reduce

from pyspark.sql import DataFrame


def union_padded(*frames: DataFrame) -> DataFrame:
    """Union all; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of either side, once each."""
    return a.unionByName(b).distinct()
