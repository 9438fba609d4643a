"""Upper bounds on free-form event fields before they are sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import json as J
from .text import cap_text

# The bounds.
ERROR_CHARS = 2000
DICT_KEYS = 32
VALUE_CHARS = 256
DICT_BYTES = 4096


def cap_value(value: Column) -> Column:
    """Text is cut, JSON scalars keep their type, lists and objects become
    their (cut) JSON text."""
    name = J.kind(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(
        (name == "STRING") | name.rlike("^(ARRAY|OBJECT)"),
        cap_text(text, VALUE_CHARS).cast("variant"),
    ).otherwise(value)


def cap_dict(entries: Column) -> Column:
    """At most 32 keys, values capped, then the longest prefix of entries whose
    JSON stays within 4096 bytes. A null map becomes an empty one."""
    listed = F.slice(F.map_entries(entries), 1, DICT_KEYS)
    capped = F.transform(
        listed,
        lambda e: F.struct(e["key"].alias("key"), cap_value(e["value"]).alias("value")),
    )
    # A lambda computes an expression as often as it names it; a field is read.
    told = F.transform(
        capped,
        lambda e: F.struct(
            e["key"].alias("key"), e["value"].alias("value"),
            F.to_json(e["key"].cast("variant")).alias("_key"), F.to_json(e["value"]).alias("_value"),
        ),
    )
    # '{' and '}' are 2 bytes and n entries need n-1 separators of 2, which is
    # the same as 2 bytes per entry.
    sized = F.transform(
        told,
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"].alias("value"),
            (
                J.escaped_length(e["_key"])
                + J.escaped_length(e["_value"])
                + F.lit(4)
            ).alias("size"),
        ),
    )

    def kept(entries: Column) -> Column:
        return F.aggregate(
            entries,
            F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda acc, e: F.struct(
                (acc["bytes"] + e["size"]).alias("bytes"),
                F.when(acc["open"] & (acc["bytes"] + e["size"] <= DICT_BYTES), acc["n"] + 1)
                .otherwise(acc["n"])
                .alias("n"),
                (acc["open"] & (acc["bytes"] + e["size"] <= DICT_BYTES)).alias("open"),
            ),
            lambda acc: acc["n"],
        )

    # As the one element of an array, entries are measured once and read twice.
    prefix = F.get(F.transform(F.array(sized), lambda s: F.slice(s, F.lit(1), kept(s))), F.lit(0))
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")
    )
    return F.coalesce(
        F.map_from_entries(
            F.transform(
                prefix,
                lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
            )
        ),
        empty,
    )


def cap_events(events: DataFrame) -> DataFrame:
    """Apply the bounds to the fields of an event that callers control."""
    return events.withColumns(
        {
            "error_message": cap_text(F.col("error_message"), ERROR_CHARS),
            "tags": cap_dict(F.col("tags")),
            "client_metadata": cap_dict(F.col("client_metadata")),
        }
    )
