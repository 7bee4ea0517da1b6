r"""Lenient JSON: keys in any case, comments and trailing commas, unknown keys kept.

A text is parsed once as VARIANT. Texts that are not plain JSON are parsed again without comments and trailing commas;
texts whose keys differ in case are written anew with lower-case keys. What types a text holds is read from the variant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A quoted text, which stays as it is, or what is taken out.
_QUOTED = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
_COMMENT = _QUOTED + r"|//[^\r\n]*+|/\*(?s:.*?)\*/"
_LAST_COMMA = _QUOTED + r"|,(?=\s*[}\]])"

DOCUMENT = "MAP<STRING, VARIANT>"


def tidied(text: Column) -> Column:
    """JSON text without comments and trailing commas."""
    return F.regexp_replace(F.regexp_replace(text, _COMMENT, "$1"), _LAST_COMMA, "$1")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spelled_document(text: Column | str) -> Column:
    """The keys and values of a JSON object, with keys as they are spelled; null for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.coalesce(F.try_parse_json(text), F.try_parse_json(tidied(text)))
    # Only objects are maps; others would make the cast an error.
    return _once(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast(DOCUMENT)))


def parse_document(text: Column | str) -> Column:
    """The keys and values of a JSON object with lower-case keys; null for anything else.

    Of keys that differ in case only, the one spelled in lower case counts, else the last in the order of spelling.
    """

    def lowered(held: Column) -> Column:
        keys = F.array_distinct(F.transform(F.map_keys(held), F.lower))

        def spelled(key: Column) -> Column:
            same = F.filter(F.map_keys(held), lambda k: F.lower(k) == key)
            return F.coalesce(held[key], held[F.array_max(same)])

        return F.map_from_arrays(keys, F.transform(keys, spelled))

    plain = lambda held: ~F.exists(F.map_keys(held), lambda k: k != F.lower(k))
    return _once(spelled_document(text), lambda held: F.when(plain(held), held).otherwise(lowered(held)))


def types_of(document: Column | str) -> Column:
    """The type of each value of a document, as text (``VOID`` for null)."""
    return F.transform_values(document, lambda _, v: F.schema_of_variant(v))


def misfits(types: Column, wanted: dict[str, Sequence[str]]) -> Column:
    """Names of the keys whose values begin with none of the types that they may have (null is always right)."""
    def wrong(held: Column, name: str, kinds: Sequence[str]) -> Column:
        kind = held[name]
        right = kind == "VOID"
        for k in kinds:
            right = right | kind.startswith(k)
        return F.when(kind.isNotNull() & ~right, F.lit(name))

    return _once(types, lambda held: F.array_compact(F.array(*[wrong(held, n, kinds) for n, kinds in wanted.items()])))


def merged(document: Column, changes: dict[str, Column]) -> Column:
    """JSON text of a document with some values replaced or added; all its other keys stay, known or not."""
    named = F.create_map(*[part for n, v in changes.items() for part in (F.lit(n), F.to_variant_object(F.struct(v.alias("v"))))])
    fresh = F.transform_values(named, lambda _, v: F.variant_get(v, "$.v", "variant"))
    kept = F.map_filter(document, lambda k, _: ~F.lower(k).isin([n.lower() for n in changes]))
    return F.to_json(F.map_concat(kept, fresh))


def as_json(rows: DataFrame, columns: Sequence[str]) -> Column:
    """JSON text of some columns, times to the microsecond with their offset, nulls left out."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"})
