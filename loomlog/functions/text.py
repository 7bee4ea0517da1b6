"""String expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomlog.functions import fixed_values as fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, the ideographic space included."""
    return F.trim(col(value), F.lit(fixed.SPACE_CHARS))


def is_blank(value: Column | str) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def null_if_blank(value: Column | str) -> Column:
    return F.when(~is_blank(value), col(value))


def capture(value: Column | str, pattern: str, group: int = 1, needs: str | tuple[str, ...] = ()) -> Column:
    """One regex group, null when the pattern does not match.

    ``needs`` names literals the pattern cannot match without; testing them first keeps the regex
    engine away from the bulk of the lines.
    """
    text = col(value)
    words = (needs,) if isinstance(needs, str) else needs
    found = F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 0)
    return F.when(contains_any(text, words), found) if words else found


def contains_any(value: Column | str, words: tuple[str, ...]) -> Column:
    text = col(value)
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def matches_any(value: Column | str, patterns: tuple[tuple[str, str], ...]) -> Column:
    """True when one of ``(required literal, pattern)`` matches."""
    text = col(value)
    return reduce(
        lambda a, b: a | b,
        [text.contains(word) & F.regexp_like(text, F.lit(pattern)) for word, pattern in patterns],
    )


def contains_ignoring_case(value: Column | str, needle: str) -> Column:
    return F.contains(F.upper(col(value)), F.upper(F.lit(needle)))


def normalize_text(value: Column | str) -> Column:
    """Drop NUL, collapse runs of white space to one blank, trim."""
    text = F.translate(col(value), "\u0000", "")
    return F.trim(F.regexp_replace(text, fixed.SPACE + "+", " "))


def normalize_name(value: Column | str) -> Column:
    """First letter upper, the rest lower (unlike ``initcap``, later words stay lower)."""
    name = strip(value)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 2_000_000_000)))


def alias_problem(value: Column | str) -> Column:
    """Why an alias is refused, or null when it is fine."""
    alias = F.coalesce(col(value), F.lit(""))
    return (
        F.when(F.regexp_like(alias, F.lit("[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]")), "control_character")
        .when(F.char_length(strip(alias)) > 100, "too_long")
    )


def normalize_alias(value: Column | str) -> Column:
    """Trimmed alias; a refused alias becomes null and :func:`alias_problem` says why."""
    return F.when(alias_problem(value).isNull(), strip(F.coalesce(col(value), F.lit(""))))


def detect_marker(value: Column | str, prefix: str | None = fixed.MARKER_PREFIX) -> Column:
    """Keyword after the marker prefix anywhere in the line, else null. A blank prefix turns it off."""
    if prefix is None or not prefix.strip(fixed.SPACE_CHARS):
        return F.lit(None).cast("string")
    pattern = "(?d)\\Q" + prefix + "\\E" + fixed.SPACE + "*" + fixed.MARKER_KEYWORD
    return capture(value, pattern, 1, prefix)


def area_name(value: Column | str) -> Column:
    """Name inside ``=== name ===``, else null."""
    text = col(value)
    return F.when(
        text.contains("==="),
        null_if_blank(strip(F.regexp_extract(strip(text), fixed.AREA_CHANGE, 1))),
    )


def session_label(session_id: Column | str, alias: Column | str) -> Column:
    sid, name = col(session_id), col(alias)
    return F.when(is_blank(name), sid).otherwise(F.concat(name, F.lit("（"), sid, F.lit("）")))


def css_color(code: Column | str) -> Column:
    """Colour of a replayed line: the last six digits of eight, all of six, else inherit."""
    text = strip(F.coalesce(col(code), F.lit("")))
    return (
        F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{8}$")), F.concat(F.lit("#"), F.substring(text, 3, 6)))
        .when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{6}$")), F.concat(F.lit("#"), text))
        .otherwise(F.lit("inherit"))
    )
