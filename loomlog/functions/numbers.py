"""Number coercion and rates. Spark 4 runs in ANSI mode, so nothing here may raise on bad input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomlog.functions.text import col, is_blank, strip

MAX_LONG = 9223372036854775807


def long_or_null(value: Column | str) -> Column:
    """Signed decimal text to BIGINT; anything else is null (Spark alone would accept '1.5')."""
    text = strip(value)
    return F.when(F.regexp_like(text, F.lit("^[+-]?[0-9]+$")), text.try_cast("bigint"))


def hex_or_null(value: Column | str) -> Column:
    """Up to 16 hex digits to BIGINT (two's complement). ``conv`` is lenient, so the shape is checked."""
    text = strip(value)
    return F.when(
        F.regexp_like(text, F.lit("^[0-9A-Fa-f]{1,16}$")),
        F.conv(text, 16, -10).try_cast("bigint"),
    )


def flex_long(value: Column | str, mode: str = "decimal_then_hex") -> Column:
    """Number, decimal text or (in the default mode) hex text to BIGINT."""
    text = col(value).cast("string")
    if mode == "decimal":
        return long_or_null(text)
    if mode == "decimal_then_hex":
        return F.coalesce(long_or_null(text), hex_or_null(text))
    raise ValueError(f"unknown mode {mode!r}")


def effective_hint(value: Column | str) -> Column:
    return F.when(col(value) >= 0, col(value))


def meta_number(value: Column | str) -> Column:
    """Unix-time hint: hex when it has a letter a-f or at most 8 characters, else decimal; 0 is null."""
    text = col(value)
    as_hex = F.regexp_like(text, F.lit("[a-fA-F]")) | (F.char_length(text) <= 8)
    number = F.when(as_hex, hex_or_null(text)).otherwise(long_or_null(text))
    return F.when(~is_blank(text) & (number != 0), number)


def rate(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as a double, null when there is nothing to divide by."""
    total = col(whole)
    return F.when(total > 0, col(part).cast("double") / total.cast("double"))


def per_second(total: Column | str, seconds: Column, confidence: Column) -> Column:
    return F.when(
        (confidence != "unknown") & (seconds > 0),
        col(total).cast("double") / F.when(seconds > 0, seconds),
    )


def per_hour(total: Column | str, seconds: Column, confidence: Column) -> Column:
    return F.when(
        (confidence != "unknown") & (seconds > 0),
        col(total).cast("double") * 3600.0 / F.when(seconds > 0, seconds),
    )
