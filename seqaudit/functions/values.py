"""Column expressions that turn raw text cells into typed, validated values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words that mean "no value".
MISSING_WORDS = ("na", "nan", "none", "null", "n/a")
# Encoder sentinels.
MISSING = "__missing__"
UNKNOWN = "__unknown__"
# Labels preferred as the positive class, most preferred first.
POSITIVE_LABELS = ("1", "true", "yes", "positive", "pos", "active", "hit")
# Label encoding used when every observed label is listed here.
LABEL_CODES = {
    "low": 0, "inactive": 0, "false": 0, "no": 0, "0": 0,
    "high": 1, "active": 1, "true": 1, "yes": 1, "1": 1,
}

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")


def is_missing(c) -> Column:
    text = strip(c)
    return col(c).isNull() | (text == "") | F.lower(text).isin(*MISSING_WORDS)


def non_blank(c) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def first_non_blank(*cols) -> Column:
    return F.coalesce(*[F.when(non_blank(c), col(c)) for c in cols])


def parse_float(c) -> Column:
    """Finite double or NULL; accepts exactly the plain and grouped decimal notations."""
    text = strip(c)
    value = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def class_label(c) -> Column:
    """``1.0`` -> ``1``; other numbers keep their decimals; text is trimmed lower case."""
    number = parse_float(c)
    whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
    label = (
        F.when(whole, number.cast("bigint").cast("string"))
        .when(number.isNotNull(), number.cast("string"))
        .otherwise(F.lower(strip(c)))
    )
    return F.when(~is_missing(c), label)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    items = [
        F.when(F.coalesce(cond, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
        for cond, text in pairs
    ]
    return F.array_compact(F.array(*items))


def fixed(c, digits: int) -> Column:
    """Number with a fixed number of decimals, rounded from its exact binary value."""
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")
