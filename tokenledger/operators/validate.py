"""Validation of JSON events with the lax type rules of the ingest contract.

Two lanes. An event whose fields all have their usual spelling and keep every rule
is read by one typed parse. Whatever fails that goes through the rules in full: its
fields become one array of types and texts, and each rule is stated once for all of
its elements. Only the second lane finds errors, so the first may refuse an event
too often but never accept one it should not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.settle import settle
from ..functions.text import strip
from ..schemas import LOG_STATUSES


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    nullable: bool = True
    limit: int | None = None
    non_negative: bool = False
    default: int | None = None


# The event contract.
FIELDS: tuple[Field, ...] = (
    Field("request_id", "uuid", required=True, nullable=False),
    Field("service", "text", required=True, nullable=False, limit=128),
    Field("provider", "text", required=True, nullable=False, limit=128),
    Field("model", "text", required=True, nullable=False, limit=128),
    Field("status", "status", required=True, nullable=False),
    Field("streamed", "bool", required=True, nullable=False),
    Field("started_at", "time", required=True, nullable=False),
    Field("completed_at", "time", required=True, nullable=False),
    Field("latency_ms", "int", required=True, nullable=False, non_negative=True),
    Field("conversation_id", "uuid"),
    Field("ttft_ms", "int", non_negative=True),
    Field("prompt_tokens", "int", non_negative=True),
    Field("completion_tokens", "int", non_negative=True),
    Field("total_tokens", "int", non_negative=True),
    Field("input_preview", "text", limit=4000),
    Field("output_preview", "text", limit=4000),
    Field("error_type", "text", limit=64),
    Field("error_message", "text", limit=2000),
    Field("pii_redaction_count", "int", nullable=False, non_negative=True, default=0),
    Field("tags", "dict", nullable=False, limit=8192),
    Field("client_metadata", "dict", nullable=False, limit=8192),
    Field("sdk_version", "text", limit=128),
    Field("schema_version", "int", nullable=False, default=1),
    Field("received_at", "time"),
)

_LONG_MAX = 9223372036854775807
_INT_MAX = 2147483647

# Accepted spellings.
_TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
_FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
_UUID = r"^(?:[0-9a-f]{32}|H|urn:uuid:H|\{H\})$".replace(
    "H", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)
_PLAIN_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?$"
_INT_TEXT = r"^[+-]?\d+(?:_\d+)*(?:\.0+)?$"
_NUMBER_TEXT = r"^[+-]?\d+(?:\.\d+)?$"
_ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[Tt _]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:[Zz]|[+\-−]\d{2}:?\d{2})?)?$"
)
# Numbers beyond this are epoch milliseconds, others epoch seconds.
_MILLIS_FROM = 20_000_000_000
_FIRST_MICROS, _LAST_MICROS = -62135596800000000, 253402300799999999


def _is_number(name: Column) -> Column:
    return name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def lax_int(name: Column, text: Column) -> Column:
    """JSON integer, integral float, boolean or integer text as a long.

    Whole numbers beyond 64 bits saturate: they are valid here and refused when
    the row is stored.
    """
    trimmed = strip(text)
    digits = F.when(
        (name == "STRING") & trimmed.rlike(_INT_TEXT), F.regexp_replace(trimmed, r"_|\.0+$", "")
    ).when(name.rlike("^(BIGINT|DECIMAL)") & text.rlike(r"^-?\d+$"), text)
    real = text.try_cast("double")
    return (
        F.when((name == "BIGINT"), text.try_cast("long"))
        .when(name == "BOOLEAN", (text == "true").cast("long"))
        .when(
            name.rlike("^(DOUBLE|FLOAT)"),
            F.when((real == F.floor(real)) & (F.abs(real) < F.lit(9.2e18)), real).try_cast("long"),
        )
        .when(
            digits.isNotNull(),
            F.coalesce(
                digits.try_cast("long"),
                F.when(F.startswith(digits, F.lit("-")), F.lit(-_LONG_MAX)).otherwise(F.lit(_LONG_MAX)),
            ),
        )
    )


def lax_bool(name: Column, text: Column) -> Column:
    lowered = F.lower(text)
    number = F.when(_is_number(name), text.try_cast("double"))
    return (
        F.when(name == "BOOLEAN", text == "true")
        .when((name == "STRING") & lowered.isin(*_TRUE_WORDS), F.lit(True))
        .when((name == "STRING") & lowered.isin(*_FALSE_WORDS), F.lit(False))
        .when(number == 1, F.lit(True))
        .when(number == 0, F.lit(False))
    )


def lax_uuid(name: Column, text: Column) -> Column:
    """Canonical lower-case form of the four accepted spellings."""
    lowered = F.lower(text)
    ok = (name == "STRING") & lowered.rlike(_UUID) & ~F.startswith(text, F.lit("URN"))
    digits = F.regexp_replace(lowered, r"^urn:uuid:|[{}-]", "")
    return F.when(
        ok,
        F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    )


def lax_time(name: Column, text: Column) -> Column:
    """ISO text, or epoch seconds or milliseconds as number or text, in UTC."""
    iso = F.when((name == "STRING") & text.rlike(_ISO_TIME), text)
    clock = F.translate(F.substring(iso, 12, 99), "z,−", "Z.-")
    stamp = F.when(
        F.length(iso) > 10, F.concat(F.substring(iso, 1, 10), F.lit("T"), clock)
    ).otherwise(iso)
    epoch = F.when(
        _is_number(name) | ((name == "STRING") & text.rlike(_NUMBER_TEXT)),
        text.try_cast("decimal(38,9)"),
    )
    scale = F.when(F.abs(epoch) > _MILLIS_FROM, F.lit(1000)).otherwise(F.lit(1_000_000))
    micros = F.floor(epoch * scale).try_cast("long")
    return F.coalesce(
        stamp.try_cast("timestamp"),
        F.when(
            micros.between(_FIRST_MICROS, _LAST_MICROS), F.timestamp_micros(micros)
        ),
    )


# The type a usual event has for each field's.
_TYPED = {"uuid": "string", "text": "string", "status": "string", "time": "string", "int": "bigint", "bool": "boolean", "dict": "map<string,variant>"}

# A typed parse turns other JSON into text; such text may have been a string as well.
_NOT_TEXT = r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$|true$|false$|[{\[])"


def _typed(text: Column) -> Column:
    """The event as a struct of its fields, null unless it is exactly one JSON object of
    the types a usual event has."""
    mark = F.md5(text)
    fields = ", ".join(f"{f.name}: {_TYPED[f.type]}" for f in FIELDS)
    parsed = F.from_json(
        F.concat(F.lit('{"_e":['), text, F.lit(',{"_mark":"'), mark, F.lit('"}]}')),
        f"_e array<struct<{fields}, `_mark`: string>>, _corrupt string",
        {**J.STRICT, "columnNameOfCorruptRecord": "_corrupt"},
    )
    pair = parsed["_e"]
    return F.when(parsed["_corrupt"].isNull() & (F.size(pair) == 2) & (pair[1]["_mark"] == mark), pair[0])


# Long lists of alike expressions are SQL text: one call each instead of dozens.


def _keeps_rules() -> str:
    """Whether the event in ``_typed``, with its times in ``_at_*``, breaks no rule and
    needs no coercion."""
    ok = ["_typed IS NOT NULL"]
    for f in FIELDS:
        v, good = f"_typed.{f.name}", []
        if f.type == "dict":
            # However it is written, every byte of it takes at most six.
            good.append(f"octet_length(to_json({v})) * 6 <= {f.limit}")
        if f.type == "text":
            good.append(f"NOT rlike({v}, r'{_NOT_TEXT}')")
        if f.type == "uuid":
            good.append(f"rlike({v}, r'{_PLAIN_UUID}')")
        if f.type == "time":
            good.append(f"rlike({v}, r'{_PLAIN_TIME}') AND _at_{f.name} IS NOT NULL")
        if f.type == "status":
            good.append(f"{v} IN {LOG_STATUSES}")
        if f.non_negative:
            good.append(f"{v} >= 0")
        if f.limit is not None and f.type != "dict":
            good.append(f"length({v}) <= {f.limit}")
        rule = " AND ".join(good) or "true"
        ok.append(f"({v} IS NOT NULL AND {rule})" if f.required else f"({v} IS NULL OR ({rule}))")
    # A null in place of a default is an error, an absent field is not.
    given = " AND ".join(f"_typed.{f.name} IS NOT NULL" for f in FIELDS if not f.required and not f.nullable)
    ok.append(f"(({given}) OR NOT contains(value, 'null'))")
    return f"coalesce({' AND '.join(ok)}, false)"


def _rules() -> str:
    """One struct per field of the contract."""
    each = (
        f"struct('{f.name}' AS name, '{f.type}' AS type, {f.required} AS required, {f.nullable} AS nullable, "
        f"CAST({'NULL' if f.limit is None else f.limit} AS INT) AS limit, {f.non_negative} AS non_negative)"
        for f in FIELDS
    )
    return f"array({', '.join(each)})"


def _read(x: Column) -> Column:
    """Rules, type and text of a field, with its value under the rules' type."""
    kind, name, text = x["type"], x["t"], x["s"]
    string = F.when(name == "STRING", text)
    return F.struct(
        *[x[c].alias(c) for c in ("name", "type", "required", "nullable", "limit", "non_negative", "t", "s")],
        F.when(kind == "int", lax_int(name, text)).alias("number"),
        F.when(kind == "bool", lax_bool(name, text)).alias("truth"),
        F.when(kind == "time", lax_time(name, text)).alias("time"),
        F.when(kind == "uuid", lax_uuid(name, text)).when(kind.isin("text", "status"), string).alias("text"),
    )


def _judged(x: Column) -> Column:
    """A field's values and the code of the first rule it breaks, or null."""
    none = x["number"].isNull() & x["truth"].isNull() & x["time"].isNull() & x["text"].isNull()
    is_dict = x["type"] == "dict"
    code = (
        F.when(x["t"].isNull(), F.when(x["required"], F.lit("missing")))
        .when(x["nullable"] & (x["t"] == "VOID"), F.lit(None).cast("string"))
        .when(is_dict & ~F.startswith(x["t"], F.lit("OBJECT")), F.lit("type"))
        # Compact UTF-8 text can grow six-fold at most.
        .when(is_dict & (F.octet_length(x["s"]) * 6 > x["limit"]) & (J.dumped_length(x["s"]) > x["limit"]), F.lit("size"))
        .when(~is_dict & none, F.lit("type"))
        .when((x["type"] == "status") & ~x["text"].isin(*LOG_STATUSES), F.lit("enum"))
        .when(x["non_negative"] & (x["number"] < 0), F.lit("range"))
        .when(~is_dict & (F.length(x["text"]) > x["limit"]), F.lit("length"))
    )
    return F.struct(*[x[c].alias(c) for c in ("name", "t", "number", "truth", "time", "text")], code.alias("code"))


_VALUE = {"int": "number", "bool": "truth", "time": "time", "uuid": "text", "text": "text", "status": "text"}


def _value(f: Field, i: int) -> str:
    """A field by either lane."""
    if f.type == "dict":
        given = f"CASE WHEN _usual THEN _typed.{f.name} ELSE try_variant_get(_event.{f.name}, '$', 'map<string,variant>') END"
        return f"coalesce({given}, map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<variant>)))"
    usual = f"_at_{f.name}" if f.type == "time" else f"_typed.{f.name}"
    full = f"get(_fields, {i}).{_VALUE[f.type]}"
    if f.default is not None:
        usual, full = f"coalesce({usual}, {f.default})", f"CASE WHEN get(_fields, {i}).t IS NULL THEN {f.default} ELSE {full} END"
    return f"CASE WHEN _usual THEN {usual} ELSE {full} END"


def validate(bronze: DataFrame) -> DataFrame:
    """Type the JSON in ``value`` and list its violations.

    Adds every contract field, ``errors`` (array of field and code, empty when
    the event is valid) and ``error`` (text, null when valid). Other input
    columns pass through; a ``received_at`` stamped on arrival wins over the
    one in the payload. Fields outside the contract are ignored.
    """
    names = [f.name for f in FIELDS]
    keep = [c for c in bronze.columns if c not in names]
    stamped = "received_at" in bronze.columns
    text = F.col("value")
    df = bronze.select(
        *keep, *([F.col("received_at").alias("_stamp")] if stamped else []), _typed(text).alias("_typed")
    )
    times = [f"try_cast(_typed.{f.name} AS timestamp) AS _at_{f.name}" for f in FIELDS if f.type == "time"]
    df = df.selectExpr("*", *times).selectExpr("*", f"{_keeps_rules()} AS _usual")
    variants = ", ".join(f"{n}: variant" for n in names)
    df = settle(df.withColumn("_event", F.when(~F.col("_usual"), J.strict_fields(text, variants))), ["_usual", "_event"])
    shown = F.zip_with(
        F.expr(_rules()), F.expr(f"array({', '.join(f'_event.{n}' for n in names)})"),
        lambda f, v: F.struct(
            *[f[c].alias(c) for c in ("name", "type", "required", "nullable", "limit", "non_negative")],
            J.kind(v).alias("t"), F.try_variant_get(v, "$", "string").alias("s"),
        ),
    )
    slow = ~F.col("_usual")
    df = df.withColumns(
        {
            # Only what is no object is parsed again, to tell other JSON from none.
            "_root": F.when(
                slow & F.col("_event").isNull(),
                F.when(J.strict_json(text).isNull(), F.lit("unparseable")).otherwise(F.lit("type")),
            ),
            "_fields": F.when(slow, F.transform(F.transform(shown, _read), _judged)),
        }
    )
    broken = F.transform(
        F.filter("_fields", lambda x: x["code"].isNotNull()), lambda x: F.struct(x["name"].alias("field"), x["code"].alias("code"))
    )
    root = F.when(F.col("_root").isNotNull(), F.array(F.struct(F.lit("$").alias("field"), F.col("_root").alias("code"))))
    none = F.array().cast("array<struct<field:string,code:string>>")
    df = df.withColumns({"_found": F.concat(F.coalesce(root, none), F.coalesce(broken, none))})
    values = {f.name: _value(f, i) for i, f in enumerate(FIELDS)}
    if stamped:
        values["received_at"] = f"coalesce(_stamp, {values['received_at']})"
    listed = F.array_join(F.transform("_found", lambda e: F.concat_ws(": ", e["field"], e["code"])), "; ")
    df = df.withColumn("_listed", F.nullif(listed, F.lit("")))
    df = df.selectExpr(*[f"`{c}`" for c in keep], *[f"{values[n]} AS {n}" for n in names], "_found AS errors", "_listed")
    df = settle(df, [*names, "errors", "_listed"])
    return df.withColumn("error", F.concat(F.lit("validation error: "), F.col("_listed"))).drop("_listed")


# The escape of NUL in JSON text; after an odd number of backslashes it is text.
_NUL = r"(?<!\\)(?:\\\\)*\\u0000"


def storage_error(df: DataFrame) -> Column:
    """Text of what the log table cannot hold in an otherwise valid row: whole
    numbers beyond 32 bits and NUL characters. Null when the row fits."""
    wide = [
        F.when(~F.col(c).between(-_INT_MAX - 1, _INT_MAX), F.lit(f"{c} out of range"))
        for c in (
            "latency_ms", "ttft_ms", "prompt_tokens", "completion_tokens",
            "total_tokens", "pii_redaction_count", "schema_version",
        )
    ]
    nul = [
        F.when(F.contains(F.col(c), F.lit("\u0000")), F.lit(f"{c} holds NUL"))
        for c in (
            "service", "provider", "model", "error_type", "error_message",
            "input_preview", "output_preview", "sdk_version",
        )
    ]
    nested = F.when(
        F.to_json("client_metadata").rlike(_NUL),
        F.lit("client_metadata holds NUL"),
    )
    problems = F.concat_ws("; ", *wide, *nul, nested)
    return F.when(problems != "", F.concat(F.lit("processing error: "), problems))


def valid_content(content: Column) -> Column:
    """Stored form of a chat message; null when it is not acceptable.

    1 to 8000 characters as sent, and something left after stripping.
    """
    return F.when(
        F.length(content).between(1, 8000), F.nullif(strip(content), F.lit(""))
    )
