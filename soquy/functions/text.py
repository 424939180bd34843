"""Dates and numbers from and to text."""

from __future__ import annotations

from soquy.functions.nulls import or_zero


# Forms of a date besides ISO text, by third character and length; days come before months.
DATE_FORMS = {
    "/": {19: "dd/MM/yyyy HH:mm:ss", 16: "dd/MM/yyyy HH:mm", 10: "dd/MM/yyyy"},
    "-": {10: "dd-MM-yyyy"},
}
DIGITS_FORM = "yyyyMMdd"


def date_text(col: str, fmt: str = "dd-MM-yyyy") -> str:
    """Date text in ``fmt`` from ISO text or one of ``DATE_FORMS``; any other text becomes null.

    The shape of a text chooses the one form it is parsed by: a failed parse by a format costs
    many times a good one.
    """
    shapes = ""
    for mark, forms in DATE_FORMS.items():
        by_length = " ".join(f"WHEN {n} THEN try_to_timestamp({col}, '{form}')" for n, form in forms.items())
        shapes += f"WHEN substr({col}, 3, 1) = '{mark}' THEN CASE length({col}) {by_length} END "
    digits = f"length({col}) = 8 AND {col} RLIKE '^[0-9]+$'"
    shapes += f"WHEN {digits} THEN try_to_timestamp({col}, '{DIGITS_FORM}')"
    return f"date_format(CASE {shapes} ELSE try_to_timestamp({col}) END, '{fmt}')"


def date_text_strict(col: str, fmt: str = "dd/MM/yyyy") -> str:
    """Date text in ``fmt``; text that is no date fails the query."""
    return f"date_format(to_timestamp({col}), '{fmt}')"


def to_int_or_null(col: str) -> str:
    """Whole number in a text (``12``, ``12.0``) as bigint; anything else is null."""
    whole = f"split_part(trim(CAST({col} AS STRING)), '.', 1)"
    return f"CASE WHEN trim(CAST({col} AS STRING)) RLIKE '^[+-]?[0-9]+([.]0*)?$' THEN try_cast({whole} AS BIGINT) END"


def dot_thousands(col: str, null_as_zero: bool = False) -> str:
    """Number text without decimals and with ``.`` between thousands.

    Rounds half to even and keeps null; with ``null_as_zero`` null is ``0`` and decimals are cut.
    """
    if null_as_zero:
        n = or_zero(col)
        col = f"CASE WHEN {n} < 0 THEN ceil({n}) ELSE floor({n}) END"
    return f"translate(format_number({col}, 0), ',', '.')"


def comma_thousands(col: str) -> str:
    """Number text without decimals, rounded half up, with ``,`` between thousands."""
    return f"format_number(round({col}, 0), 0)"
