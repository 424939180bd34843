"""Code to label decoding."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soquy.functions.nulls import constant
from soquy.operators.shape import CLASS_LABELS


def label_of(column: str) -> str:
    """Label of a class code; an unknown code stays as its own text, null stays null."""
    cases = " ".join(f"WHEN {code} THEN {constant(t)}" for code, t in CLASS_LABELS[column].items())
    return f"CASE {column} {cases} ELSE CAST({column} AS STRING) END"


def decode_classes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(label_of(c)) for c in CLASS_LABELS})
