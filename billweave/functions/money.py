"""Decimals: locale-tolerant parsing, money rounding and the strict number grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = "decimal(20,6)"
MONEY = "decimal(20,4)"

_BLANK = "[ \\t\\u00A0\\u202F]*"
_CURRENCY = "(?:[$€£]|[A-Z]{3})?"
_GROUPS = "|".join(f"[0-9]{{1,3}}(?:{mark}[0-9]{{3}})+" for mark in (",", "\\.", "[ \\u00A0\\u202F]", "'"))

#: One number: sign, currency, plain or grouped digits, a decimal part of 1 to 4 digits, currency.
NUMBER_GRAMMAR = (
    f"^{_BLANK}[+-]?{_BLANK}{_CURRENCY}{_BLANK}(?:[0-9]+|{_GROUPS})"
    f"(?:{_BLANK}[.,][0-9]{{1,4}})?{_BLANK}{_CURRENCY}{_BLANK}$"
)

#: The same grammar with the sign, the whole part and the decimal part as groups.
_NUMBER_PARTS = (
    f"^{_BLANK}([+-]?){_BLANK}{_CURRENCY}{_BLANK}([0-9]+|{_GROUPS})"
    f"(?:{_BLANK}[.,]([0-9]{{1,4}}))?{_BLANK}{_CURRENCY}{_BLANK}$"
)


def is_missing(value: Column) -> Column:
    """Null or blank text: a missing number, not a failure."""
    return value.isNull() | (F.regexp_replace(value, "[\\s\\u00A0\\u202F]+", "") == "")


def is_number(value: Column) -> Column:
    """Whether the text is one number of the strict grammar (null in, null out)."""
    return value.rlike(NUMBER_GRAMMAR)


def number_text(value: Column) -> Column:
    """Plain decimal text of a number of the strict grammar, of any length; null for all else.

    A mark that repeats groups the digits; a last mark, of the same kind too, is the decimal mark
    where the digits before it can stand alone. So ``1,234`` is one and a fraction, ``1,234,567`` whole.
    """
    parts = F.regexp_replace(F.regexp_replace(value, _NUMBER_PARTS, "$1$2;$3"), "[^0-9;-]", "")
    plain = F.regexp_replace(F.replace(parts, F.lit(";"), F.lit(".")), "\\.$", "")
    return F.when(is_number(value), F.regexp_replace(plain, "^(-?)0+(?=[0-9])", "$1"))


def typed_number(text: Column, dtype: str) -> Column:
    """Text of :func:`number_text` as a decimal; null where its whole part is too long for ``dtype``."""
    precision, scale = map(int, dtype[len("decimal(") : -1].split(","))
    whole = F.char_length(F.regexp_replace(text, "^-|[.].*", ""))
    return F.when(whole <= precision - scale, text).try_cast(dtype)


def parse_decimal(value: Column, dtype: str = QUANTITY) -> Column:
    """Locale-tolerant decimal; blank or unusable text gives null, never an error.

    Everything but digits, signs and the two marks is dropped. With both marks present the
    right-most is the decimal mark; a single kind is a thousands mark only when two or more
    groups of three follow each other.
    """
    kept = F.regexp_replace(value, "[^0-9,.+\\-]", "")
    comma, dot = F.instr(kept, ",") > 0, F.instr(kept, ".") > 0
    last_comma = F.length(kept) - F.instr(F.reverse(kept), ",")
    last_dot = F.length(kept) - F.instr(F.reverse(kept), ".")
    grouped_commas = kept.rlike("^[-+]?[0-9]{1,3}(,[0-9]{3}){2,}$")
    grouped_dots = kept.rlike("^[-+]?[0-9]{1,3}(\\.[0-9]{3}){2,}$")
    no_dots = F.replace(kept, F.lit("."), F.lit(""))
    no_commas = F.replace(kept, F.lit(","), F.lit(""))
    text = (
        F.when(comma & dot & (last_comma > last_dot), F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(comma & dot, no_commas)
        .when(comma & grouped_commas, no_commas)
        .when(comma, F.replace(kept, F.lit(","), F.lit(".")))
        .when(dot & grouped_dots, no_dots)
        .otherwise(kept)
    )
    usable = text.rlike("^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)$")
    return F.when(usable, text).try_cast(dtype)


def to_decimal(value: Column, dtype: str = MONEY, default: Column | None = None) -> Column:
    """Plain decimal text to a decimal; blank or unusable text takes ``default`` (null)."""
    parsed = F.trim(value.cast("string")).try_cast(dtype)
    return parsed if default is None else F.coalesce(parsed, default)


def money(value: Column) -> Column:
    """Two decimals, half away from zero; null counts as zero."""
    return F.round(F.coalesce(value, F.lit(0).cast(MONEY)), 2).cast("decimal(20,2)")


def decimal_text(value: Column, scale: int = 2) -> Column:
    """Fixed-point text without exponent."""
    return value.cast(f"decimal(38,{scale})").cast("string")
