"""CSV export of result tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.display import table_columns

BOM = "\ufeff"
EXPORT_PREFIX = "loomlog"
NAME_LIMIT = 40


def layout(df: DataFrame, name: str) -> DataFrame:
    """The columns of a named layout, formatted for reading, under their headings."""
    shown = table_columns(name)
    return df.select(*[shown[column].alias(heading) for column, heading in fixed.CSV_LAYOUTS[name]])


def export_csv(df: DataFrame, path: str, layout_name: str | None = None) -> None:
    """Write CSV as spreadsheets expect it: byte-order mark, CRLF, quotes only where needed and doubled.

    Each output file carries the heading line. Sort the table first if its order matters.
    """
    shown = layout(df, layout_name) if layout_name else df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
    first, *rest = shown.columns
    shown = shown.toDF(BOM + first, *rest)
    (
        shown.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def safe_part(value: str | None, fallback: str) -> str:
    """A piece of a file name: no control or reserved characters, at most 40 long."""
    text = re.sub(r'[\x00-\x1f<>:"/\\|?*]', "_", (value or "").strip()).strip(" .")
    text = text or fallback
    return text if len(text) <= NAME_LIMIT else text[:NAME_LIMIT].rstrip(" .")


def export_name(
    kind: str,
    start: datetime | None,
    end: datetime | None,
    fallback: datetime | None,
    range_name: str,
    prefix: str = EXPORT_PREFIX,
) -> str:
    """File name of an export: kind, time span (one day, two days, one end, or a date), range name."""
    if not kind.strip():
        raise ValueError("an export needs a kind")
    parts = [prefix, safe_part(kind, "分析結果")]
    one = start or end
    if start and end:
        if start.date() == end.date():
            parts.append(f"{start:%Y%m%d}_{start:%H%M%S}-{end:%H%M%S}")
        else:
            parts.append(f"{start:%Y%m%d-%H%M%S}_{end:%Y%m%d-%H%M%S}")
    elif one:
        parts.append(f"{one:%Y%m%d_%H%M%S}")
    elif fallback:
        parts.append(f"{fallback:%Y%m%d}")
    parts.append(safe_part(range_name, "指定範囲"))
    return "_".join(parts) + ".csv"
