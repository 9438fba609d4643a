"""Variant and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strictly JSON, and strings of any length.
STRICT = {"maxStringLen": "2147483647", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strict_json(text: Column) -> Column:
    """The text as a variant, or null when it is not exactly one JSON value.

    Parsers stop after the first value and ignore what follows. Parsing ``[text,
    mark]`` turns that into a visible error: the array then has other than two
    elements or another second one. The mark is a digest of the text, so no text
    can hold its own. A variant holds up to 128 MiB; larger values are null.
    """
    mark = F.md5(text)
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<variant>", STRICT)
    return F.when((F.size(pair) == 2) & (F.try_variant_get(pair[1], "$", "string") == mark), pair[0])


def strict_fields(text: Column, fields: str) -> Column:
    """The text as a struct of its ``fields`` (DDL), null unless it is exactly one JSON object.

    Only the named fields are kept, each with a limit of its own, so an object's
    size has no bound. Null also for the JSON value null.
    """
    mark = F.md5(text)
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(',{"_mark":"'), mark, F.lit('"}]')), f"array<struct<{fields}, `_mark`: string>>", STRICT)
    return F.when((F.size(pair) == 2) & (pair[1]["_mark"] == mark), pair[0])


def field(doc: Column, path: str) -> Column:
    """The variant at ``path``; SQL null when the path does not exist."""
    return F.try_variant_get(doc, path, "variant")


def kind(value: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, VOID, OBJECT<..>; null if absent."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT")), F.lit(False))


def string_at(doc: Column, path: str) -> Column:
    """The string at ``path``; null for any other JSON type."""
    return F.when(
        kind(field(doc, path)) == "STRING", F.try_variant_get(doc, path, "string")
    )


def integer_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "bigint")


def items_at(doc: Column, path: str) -> Column:
    """The array at ``path`` as array<variant>, empty for anything else."""
    return F.coalesce(
        F.try_variant_get(doc, path, "array<variant>"),
        F.array().cast("array<variant>"),
    )


def as_text(value: Column) -> Column:
    """A present JSON value as text; booleans and null the way Python names them."""
    raw = F.try_variant_get(value, "$", "string")
    # Strings come first: every test looks the value up once more.
    return (
        F.when(kind(value) == "STRING", raw)
        .when(kind(value) == "VOID", F.lit("None"))
        .when(kind(value) == "BOOLEAN", F.initcap(raw))
        .otherwise(raw)
    )


def is_truthy(value: Column) -> Column:
    """False for absent, null, false, zero, and empty text, list or object."""
    raw = F.try_variant_get(value, "$", "string")
    name = kind(value)
    return F.coalesce(
        F.when(name == "BOOLEAN", raw == "true")
        .when(name == "STRING", raw != "")
        .when(name.isNull() | (name == "VOID"), F.lit(False))
        .when(name.rlike("^(ARRAY|OBJECT)"), ~raw.isin("[]", "{}"))
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(1.0)) != 0),
        F.lit(False),
    )


def escaped_length(text: Column) -> Column:
    """Bytes of ``text`` once every character outside ' '..'~' is written as \\uXXXX.

    Plain ASCII counts 1, other characters of the basic plane 6, and characters
    beyond it 12 (a surrogate pair).
    """
    # Whole runs are taken out: one match for each costs far less than one for each character.
    plain = F.length(F.regexp_replace(text, r"[^ -~]++", ""))
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]++", ""))
    total = F.length(text)
    return (total + (total - plain) * 5 + astral * 6).cast("long")


def dumped_length(json: Column) -> Column:
    """Byte size of compact JSON text when re-written with ", " and ": " and
    with non-ASCII characters escaped."""
    outside_strings = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    separators = F.length(F.regexp_replace(outside_strings, r"[^,:]++", ""))
    return escaped_length(json) + separators


def overlaid(outer: Column, inner: Column) -> Column:
    """Two maps as one; of keys in both, the inner map's value stays, whatever
    the session says about duplicate keys."""
    return F.map_concat(F.map_filter(outer, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(inner), k), F.lit(False))), inner)
