"""Clock-time expressions. A message time is seconds since midnight plus a precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import col, strip


def _clock(text: Column, pattern: str) -> Column:
    hour, minute, second = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    ok = (
        (hour != "")
        & (hour.try_cast("int") <= 23)
        & (minute.try_cast("int") <= 59)
        & ((second == "") | (second.try_cast("int") <= 59))
    )
    seconds = (
        hour.try_cast("int") * 3600
        + minute.try_cast("int") * 60
        + F.coalesce(second.try_cast("int"), F.lit(0))
    )
    return F.when(
        ok,
        F.struct(
            seconds.cast("bigint").alias("seconds"),
            F.when(second == "", "minute").otherwise("second").alias("precision"),
        ),
    )


def parse_message_time(value: Column | str, accept_unbracketed: bool = False) -> Column:
    """``[hh:mm]`` or ``[hh:mm:ss]`` as the whole value -> struct(seconds, precision), else null.

    Freshly collected sessions store the time without brackets; ``accept_unbracketed`` reads those too.
    """
    return _clock(strip(value), fixed.TIME_BARE if accept_unbracketed else fixed.TIME_BRACKETED)


def extract_message_time(value: Column | str) -> Column:
    """First valid ``[h:mm]`` / ``[h:mm:ss]`` anywhere in a line -> struct(text, precision), else null."""
    text = col(value)
    found = F.regexp_extract_all(text, F.lit(fixed.TIME_ANYWHERE), F.lit(1))
    parts = lambda t: F.split(t, ":")
    valid = F.filter(
        found,
        lambda t: (parts(t)[0].try_cast("int") <= 23)
        & (parts(t)[1].try_cast("int") <= 59)
        & (F.coalesce(F.try_element_at(parts(t), F.lit(3)).try_cast("int"), F.lit(0)) <= 59),
    )
    first = F.try_element_at(valid, F.lit(1))
    return F.when(
        text.contains("[") & first.isNotNull(),
        F.struct(
            first.alias("text"),
            F.when(F.size(F.split(first, ":")) == 3, "second").otherwise("minute").alias("precision"),
        ),
    )


def elapsed_text(seconds: Column | str) -> Column:
    """``h時間m分s秒``, leaving out leading zero units; '-' when unknown or not positive."""
    total = F.floor(col(seconds)).cast("bigint")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    digits = lambda n: n.cast("bigint").cast("string")
    tail = F.concat(digits(rest), F.lit("秒"))
    return (
        F.when(col(seconds).isNull() | (col(seconds) <= 0), "-")
        .when(total >= 3600, F.concat(digits(hours), F.lit("時間"), digits(minutes), F.lit("分"), tail))
        .when(total >= 60, F.concat(digits(minutes), F.lit("分"), tail))
        .otherwise(tail)
    )
