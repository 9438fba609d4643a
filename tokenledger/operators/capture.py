"""From stored HTTP exchanges with model providers to inference events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.classify import captured_error, status_error
from ..functions.enrich import elapsed_ms
from ..functions.redact import Redactor, redact_columns
from ..functions.settle import settle
from ..functions.text import preview, strip, strip_ascii
from ..session import written
from .streams import chunk_blocks, crossing_lines, cut_blocks, fold_lines, is_whole, text_preview, whole_text

SDK_VERSION = "0.4.0"
ERROR_CHARS = 500

Meta = dict[str, Column]


def last_user_text(messages: Column) -> Column:
    """Content of the last user message of a variant message list.

    Lists of content parts give their text parts joined by a space.
    """
    users = F.filter(messages, lambda m: J.string_at(m, "$.role") == "user")
    content = J.field(F.try_element_at(users, F.lit(-1)), "$.content")
    parts = F.filter(
        J.items_at(content, "$"),
        lambda p: J.is_object(p)
        & F.coalesce(
            J.kind(J.field(p, "$.type")).isin("VOID") | (J.string_at(p, "$.type") == "text"),
            J.field(p, "$.type").isNull(),
        ),
    )
    joined = F.array_join(
        F.transform(parts, lambda p: F.coalesce(J.as_text(J.field(p, "$.text")), F.lit(""))), " "
    )
    return F.when(J.kind(content) == "STRING", J.string_at(content, "$")).when(
        F.startswith(J.kind(content), F.lit("ARRAY")), F.nullif(strip(joined), F.lit(""))
    )


# ----------------------------------------------------------------- requests


# Top-level fields the handlers below read. Bodies are parsed for these alone, so
# only a single value is bound by the size of a variant, not a body or a list.
_REQUEST_FIELDS = "model: variant, stream: variant, prompt: variant, messages: array<variant>"
_RESPONSE_FIELDS = (
    "choices: array<variant>, content: array<variant>, usage: variant, message: variant, response: variant, "
    "prompt_eval_count: variant, eval_count: variant"
)


def _items(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<variant>"))


def _chat_request(body: Column) -> Meta:
    return {
        "model": F.coalesce(J.as_text(body["model"]), F.lit("unknown")),
        "streaming": J.is_truthy(body["stream"]),
        "input_text": last_user_text(_items(body["messages"])),
    }


def _ollama_request(body: Column) -> Meta:
    off = (J.kind(body["stream"]) == "BOOLEAN") & (F.try_variant_get(body["stream"], "$", "string") == "false")
    return {
        "model": F.coalesce(J.as_text(body["model"]), F.lit("unknown")),
        "streaming": ~F.coalesce(off, F.lit(False)),
        "input_text": F.coalesce(last_user_text(_items(body["messages"])), J.string_at(body["prompt"], "$")),
    }


# ---------------------------------------------------------------- responses


def _openai_response(body: Column) -> Meta:
    return {
        "output_text": J.string_at(F.get(body["choices"], F.lit(0)), "$.message.content"),
        "prompt_tokens": J.integer_at(body["usage"], "$.prompt_tokens"),
        "completion_tokens": J.integer_at(body["usage"], "$.completion_tokens"),
        "total_tokens": J.integer_at(body["usage"], "$.total_tokens"),
    }


def _with_sum(prompt: Column, completion: Column, text: Column) -> Meta:
    return {
        "output_text": text,
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "total_tokens": prompt + completion,
    }


def _anthropic_response(body: Column) -> Meta:
    blocks = F.filter(_items(body["content"]), lambda b: J.string_at(b, "$.type") == "text")
    text = F.array_join(
        F.transform(blocks, lambda b: F.coalesce(J.as_text(J.field(b, "$.text")), F.lit(""))), ""
    )
    return _with_sum(
        J.integer_at(body["usage"], "$.input_tokens"),
        J.integer_at(body["usage"], "$.output_tokens"),
        F.nullif(text, F.lit("")),
    )


def _ollama_response(body: Column) -> Meta:
    message = J.field(body["message"], "$.content")
    text = F.when(J.is_truthy(message), J.as_text(message)).otherwise(J.as_text(body["response"]))
    return _with_sum(J.integer_at(body["prompt_eval_count"], "$"), J.integer_at(body["eval_count"], "$"), text)


# ------------------------------------------------------------------ streams
# A stream handler sees one complete line: ``doc``, its payload as a variant (null
# without a JSON payload), and ``payload``, its text. It returns what the line
# says: ``text`` it adds, ``done`` for the end marker, and counters: ``usage`` (a
# struct of prompt, completion and total that replaces all counters so far), or
# ``prompt`` and ``completion`` with ``closes`` where their total is taken.


def _nothing(kind: str = "long") -> Column:
    return F.lit(None).cast(kind)


_USAGE = "struct<prompt:bigint,completion:bigint,total:bigint>"


def _openai_stream(doc: Column, payload: Column) -> Meta:
    parts = F.transform(
        J.items_at(doc, "$.choices"), lambda c: F.coalesce(J.string_at(c, "$.delta.content"), F.lit(""))
    )
    usage = F.struct(*[J.integer_at(doc, f"$.usage.{n}_tokens").alias(n) for n in ("prompt", "completion", "total")])
    return {
        "text": F.array_join(parts, ""),
        "usage": F.when(J.is_truthy(J.field(doc, "$.usage")), usage),
        "prompt": _nothing(),
        "completion": _nothing(),
        "closes": F.lit(False),
        "done": payload == "[DONE]",
    }


def _anthropic_stream(doc: Column, payload: Column) -> Meta:
    kind = J.string_at(doc, "$.type")
    delta = (J.string_at(doc, "$.delta.type") == "text_delta") & (kind == "content_block_delta")
    output = F.when(kind == "message_delta", J.integer_at(doc, "$.usage.output_tokens"))
    return {
        "text": F.when(delta, J.as_text(J.field(doc, "$.delta.text"))),
        "usage": _nothing(_USAGE),
        "prompt": F.when(kind == "message_start", J.integer_at(doc, "$.message.usage.input_tokens")),
        "completion": output,
        "closes": output.isNotNull(),
        "done": kind == "message_stop",
    }


def _ollama_stream(doc: Column, payload: Column) -> Meta:
    done = J.is_truthy(J.field(doc, "$.done"))
    message, other = J.field(doc, "$.message.content"), J.field(doc, "$.response")
    return {
        "text": F.when(J.is_truthy(message), J.as_text(message)).when(J.is_truthy(other), J.as_text(other)),
        "usage": _nothing(_USAGE),
        "prompt": F.when(done, J.integer_at(doc, "$.prompt_eval_count")),
        "completion": F.when(done, J.integer_at(doc, "$.eval_count")),
        "closes": done,
        "done": done,
    }


# ----------------------------------------------------------------- handlers


@dataclass(frozen=True)
class Handler:
    """How one provider's exchanges are recognised and read.

    ``matches`` gets host and path columns of a POST request. ``request`` and
    ``response`` get the body: a struct of the fields named in ``request_fields``
    and ``response_fields`` (DDL), or without names the whole body as a variant,
    which holds up to 128 MiB. ``stream`` may be missing for providers that never
    stream; ``events`` says whether stream lines are ``data:`` events or bare JSON.
    """

    name: str
    matches: Callable[[Column, Column], Column]
    request: Callable[[Column], Meta]
    response: Callable[[Column], Meta]
    stream: Callable[[Column, Column], Meta] | None = None
    events: bool = True
    request_fields: str | None = None
    response_fields: str | None = None


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def _ends(text: Column, part: str) -> Column:
    return F.endswith(text, F.lit(part))


OPENAI = Handler(
    "openai",
    lambda host, path: _has(host, "openai.com") & _ends(path, "/chat/completions"),
    _chat_request, _openai_response, _openai_stream, request_fields=_REQUEST_FIELDS, response_fields=_RESPONSE_FIELDS,
)
ANTHROPIC = Handler(
    "anthropic",
    lambda host, path: _has(host, "anthropic") & _ends(path, "/v1/messages"),
    _chat_request, _anthropic_response, _anthropic_stream, request_fields=_REQUEST_FIELDS, response_fields=_RESPONSE_FIELDS,
)
OLLAMA = Handler(
    "ollama",
    lambda host, path: _ends(path, "/api/chat") | _ends(path, "/api/generate"),
    _ollama_request, _ollama_response, _ollama_stream, events=False, request_fields=_REQUEST_FIELDS, response_fields=_RESPONSE_FIELDS,
)
OPENAI_COMPATIBLE = Handler(
    "openai_compatible",
    lambda host, path: ~_has(host, "openai.com") & ~_has(host, "anthropic")
    & _ends(path, "/chat/completions"),
    _chat_request, _openai_response, _openai_stream, request_fields=_REQUEST_FIELDS, response_fields=_RESPONSE_FIELDS,
)

# First match wins.
DEFAULT_HANDLERS: tuple[Handler, ...] = (OPENAI, ANTHROPIC, OLLAMA, OPENAI_COMPATIBLE)


def add_handler(
    handler: Handler, handlers: Sequence[Handler] = DEFAULT_HANDLERS, position: int = 0
) -> tuple[Handler, ...]:
    """The handlers with one more at ``position``, first by default."""
    return (*handlers[:position], handler, *handlers[position:])


def _per_handler(
    handlers: Sequence[Handler], pick: Callable[[Handler], Column | None]
) -> Column:
    """A column that depends on the provider of the row."""
    chosen = F
    for h in handlers:
        value = pick(h)
        if value is not None:
            chosen = chosen.when(F.col("provider") == h.name, value)
    return chosen


def route(captures: DataFrame, handlers: Sequence[Handler] = DEFAULT_HANDLERS) -> DataFrame:
    """Add ``provider``; requests no handler recognises are dropped.

    Only method and URL are read, so nothing else is parsed for other traffic.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    chosen = F
    for h in handlers:
        chosen = chosen.when(h.matches(host, path), F.lit(h.name))
    return (
        captures.filter(F.col("method") == "POST")
        .withColumn("provider", chosen)
        .filter(F.col("provider").isNotNull())
    )


def _bodies(text: Column, fields: Sequence[str | None]) -> dict[str | None, Column]:
    """A body parsed once for every set of fields the handlers ask for."""
    return {f: J.strict_json(text) if f is None else J.strict_fields(text, f) for f in dict.fromkeys(fields)}


def parse_requests(
    routed: DataFrame, handlers: Sequence[Handler] = DEFAULT_HANDLERS
) -> DataFrame:
    """Add ``model``, ``streaming`` and ``input_text`` from the request body.

    A body that is not JSON counts as empty. A body that is JSON but neither an
    object nor empty cannot be read, and the exchange is left out.
    """
    text = F.col("request_body")
    bodies = _bodies(text, [h.request_fields for h in handlers])
    at = {f: f"_body{i}" for i, f in enumerate(bodies)}
    # Only what is no object is parsed again.
    object_ = F.startswith(F.ltrim(text), F.lit("{"))
    doc = routed.withColumns(
        {
            **{at[f]: F.when(F.col("provider").isin([h.name for h in handlers if h.request_fields == f]), b) for f, b in bodies.items()},
            "_other": F.when(~object_, J.strict_json(text)),
        }
    )
    doc = settle(doc, [*at.values(), "_other"])
    parsed = {h.name: h.request(F.col(at[h.request_fields])) for h in handlers}
    names = ["model", "streaming", "input_text"]
    read = doc.filter(~F.coalesce(J.is_truthy(F.col("_other")), F.lit(False))).withColumns(
        {n: _per_handler(handlers, lambda h: parsed[h.name][n]) for n in names}
    )
    return settle(read.drop(*at.values(), "_other"), names)


_META = ("output_text", "prompt_tokens", "completion_tokens", "total_tokens")


def parse_responses(
    exchanges: DataFrame, handlers: Sequence[Handler] = DEFAULT_HANDLERS
) -> DataFrame:
    """Add output text and token counts from the buffered response body; all
    null when it cannot be read."""
    bodies = _bodies(F.col("response_body"), [h.response_fields for h in handlers])
    at = {f: f"_body{i}" for i, f in enumerate(bodies)}
    doc = settle(exchanges.withColumns(
        {at[f]: F.when(F.col("provider").isin([h.name for h in handlers if h.response_fields == f]), b) for f, b in bodies.items()}
    ), list(at.values()))
    parsed = {h.name: h.response(F.col(at[h.response_fields])) for h in handlers}
    read = doc.withColumns(
        {n: _per_handler(handlers, lambda h: parsed[h.name][n]) for n in _META}
    )
    return settle(read.drop(*at.values()), _META)


_SAID = ("text", "usage", "prompt", "completion", "closes", "done")
_REPLY = ("request_id", "provider")


def _payloads(lines: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    """Lines with their ``_payload`` instead of ``line``, null for no payload or no UTF-8."""
    text = strip_ascii(F.try_validate_utf8(F.encode("line", "ISO-8859-1").cast("string")))
    df = settle(lines.withColumn("_text", text).drop("line"), ["_text"])
    is_event = _per_handler(handlers, lambda h: F.lit(h.events))
    payload = F.when(~is_event, F.col("_text")).when(
        F.startswith("_text", F.lit("data:")), strip_ascii(F.substring("_text", 6, 1 << 30))
    )
    return settle(df.withColumn("_payload", payload).drop("_text"), ["_payload"])


def _parse_payloads(df: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    df = settle(df.withColumn("_doc", J.strict_json(F.col("_payload"))), ["_doc"])
    said = {h.name: h.stream(F.col("_doc"), F.col("_payload")) for h in handlers if h.stream}
    df = df.withColumns({n: _per_handler(handlers, lambda h: said[h.name][n] if h.stream else None) for n in _SAID})
    flags = {n: F.coalesce(n, F.lit(False)) for n in ("closes", "done")}
    return settle(df.drop("_doc", "_payload").withColumns(flags), _SAID)


def parse_lines(lines: DataFrame, handlers: Sequence[Handler] = DEFAULT_HANDLERS) -> DataFrame:
    """What every line of :func:`stream_lines` says, by its ``provider``.

    Lines are decoded as a whole; one that is no UTF-8 or no payload says nothing.
    """
    return _parse_payloads(_payloads(lines, handlers), handlers)


def _said(chunks: DataFrame, asked: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    """What the lines of the asked replies say, parsed once and written.

    Lines that say nothing are left out, but for those that cross blocks, of which
    every reply with a complete line has one.
    """
    # Blocks, not chunks, meet the providers; then they are dealt out once more.
    blocks = chunk_blocks(chunks).join(asked.hint("shuffle_hash"), "request_id")
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_blocks(blocks.repartition(tasks, *_REPLY, "_block", "_part"))
    line = F.col("line")
    pieces = cut.withColumns({"line": F.when(is_whole(), line), "_piece": F.when(~is_whole(), line)})
    # Half of the lines are empty or name an event; they need no parsing.
    spoken = _payloads(pieces, handlers).filter((F.col("_payload") != "") | F.col("_piece").isNotNull())
    parsed = _parse_payloads(spoken, handlers)
    says = (F.col("text") != "") | F.col("closes") | F.col("done")
    for name in ("usage", "prompt", "completion"):
        says = says | F.col(name).isNotNull()
    # The cut is read twice, and written for it as what it says.
    kept = written(parsed.filter(F.coalesce(says, F.lit(False)) | F.col("_piece").isNotNull()), "lines")
    columns = [*_REPLY, "seq", "at", "index", *_SAID]
    borders = kept.filter(F.col("_piece").isNotNull()).select(*_REPLY, "_block", "_part", "index", F.col("_piece").alias("line"), "_end")
    crossing = parse_lines(crossing_lines(borders, _REPLY).repartition(tasks, *_REPLY, "seq"), handlers)
    crossing = written(crossing.select(*columns), "lines")
    whole = kept.filter(F.col("_piece").isNull()).withColumns({"seq": F.col("_end.seq"), "at": F.col("_end.at")})
    return whole.select(*columns).unionByName(crossing)


def fold_streams(
    streams: DataFrame, chunks: DataFrame, handlers: Sequence[Handler] = DEFAULT_HANDLERS, whole: bool = True
) -> DataFrame:
    """Add what a streamed reply says and when its first text arrived.

    Needs ``request_id`` and ``provider``. Adds the token columns, ``completed``,
    ``first_text_at`` and ``output_preview``, and with ``whole`` the text itself as
    ``output_text``, the only value as long as a reply. A reply without complete
    lines has nulls.
    """
    asked = streams.select(*_REPLY).distinct()
    said = _said(chunks, asked, handlers)
    folded = fold_lines(said, _REPLY).join(
        text_preview(said, _REPLY).withColumnRenamed("preview", "output_preview"), list(_REPLY), "left"
    )
    if whole:
        folded = folded.join(whole_text(said, _REPLY).withColumnRenamed("whole", "output_text"), list(_REPLY), "left")
    return streams.join(folded, list(_REPLY), "left")


# Exceptions by which a caller gives up, as opposed to failures.
CANCELLATIONS = ("CancelledError", "GeneratorExit")


def stream_status(ended: Column, completed: Column, exception_class: Column) -> Column:
    """A stream that was left early or cancelled is still a success after its end marker."""
    return (
        F.when(exception_class.isin(*CANCELLATIONS), F.when(F.coalesce(completed, F.lit(False)), F.lit("success")).otherwise(F.lit("cancelled")))
        .when(exception_class.isNotNull(), F.lit("error"))
        .when(F.coalesce(ended | completed, F.lit(False)), F.lit("success"))
        .otherwise(F.lit("cancelled"))
    )


def exchange_error(limit: int = ERROR_CHARS) -> tuple[Column, Column]:
    """Type and message of a failed exchange: an HTTP error status or an
    exception; null for the others."""
    code = F.col("status_code")
    http = code >= 400
    raised = F.col("exception_class").isNotNull() & ~F.col("exception_class").isin(*CANCELLATIONS)
    body = F.nullif(F.substring("response_body", 1, limit), F.lit(""))
    kind = F.when(http, status_error(code)).when(raised, captured_error(F.col("exception_class")))
    message = F.when(
        http, F.coalesce(body, F.concat(F.lit("HTTP "), code.cast("string")))
    ).when(
        raised, F.substring(F.coalesce("exception_message", F.lit("")), 1, limit)
    )
    return kind, message


def merge_tags(outer: Column, inner: Column) -> Column:
    """Tags of nested scopes: inner ones win, null ones are ignored."""
    given = F.map_filter(inner, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))
    return J.overlaid(outer, given)


def conversation_of(tags: Column, explicit: Column | None = None) -> Column:
    """The conversation id, taken from the tags unless given explicitly."""
    tagged = J.as_text(F.try_element_at(tags, F.lit("conversation_id")))
    return tagged if explicit is None else F.coalesce(explicit, tagged)


def capture_events(
    captures: DataFrame,
    chunks: DataFrame,
    service: str = "captured",
    handlers: Sequence[Handler] = DEFAULT_HANDLERS,
    redactor: Redactor = Redactor(),
) -> DataFrame:
    """One inference event per recognised exchange.

    Exchanges are parsed once into narrow rows, without their bodies, and written.
    Buffered replies never touch the chunk table: only the chunks of streamed
    requests are folded, and what they say is attached by the request.
    """
    requests = parse_requests(route(captures, handlers), handlers).drop("request_body")
    # A call given up before its reply was complete never becomes an event.
    given_up = F.col("exception_class").isin(*CANCELLATIONS) & (~F.col("streaming") | F.col("status_code").isNull())
    requests = requests.filter(~F.coalesce(given_up, F.lit(False)))
    failed = (F.coalesce(F.col("status_code"), F.lit(0)) >= 400) | (
        F.col("exception_class").isNotNull() & F.col("status_code").isNull()
    )
    kind, message = exchange_error()
    marked = requests.withColumns(
        {"_failed": failed, "_live": F.col("streaming") & ~failed, "error_type": kind, "error_message": message, "_input": preview(F.col("input_text"))}
    ).drop("input_text")
    buffered = marked.withColumn("response_body", F.when(~F.col("_failed") & ~F.col("_live"), F.col("response_body")))
    parsed = parse_responses(buffered, handlers).withColumn("_output", preview(F.col("output_text"))).drop("response_body", "output_text", "exception_message")
    parsed = written(parsed, "exchanges")
    counts = ["prompt_tokens", "completion_tokens", "total_tokens"]
    live = fold_streams(parsed.filter("_live").select(*_REPLY).distinct(), chunks, handlers, whole=False)
    live = live.select(
        *_REPLY, F.lit(True).alias("_live"), "completed", "first_text_at", F.col("output_preview").alias("_preview"), *[F.col(c).alias(f"_{c}") for c in counts]
    )
    joined = parsed.join(live, [*_REPLY, "_live"], "left")
    told = stream_status(F.col("stream_ended"), F.col("completed"), F.col("exception_class"))
    either = lambda a, b: F.when(F.col("_live"), F.col(a)).otherwise(F.col(b))
    events = joined.select(
        "request_id",
        F.lit(service).alias("service"),
        "provider",
        "model",
        F.when(F.col("_live"), told).when(F.col("_failed"), F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("streaming").alias("streamed"),
        "started_at",
        F.col("ended_at").alias("completed_at"),
        elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
        conversation_of(F.col("tags")).alias("conversation_id"),
        elapsed_ms(F.col("started_at"), F.col("first_text_at")).alias("ttft_ms"),
        *[either(f"_{c}", c).alias(c) for c in counts],
        F.col("_input").alias("input_preview"),
        either("_preview", "_output").alias("output_preview"),
        "error_type",
        "error_message",
        F.lit(0).alias("pii_redaction_count"),
        "tags",
        F.from_json(
            F.lit('{"auto_instrumented":true,"transport":"httpx"}'), "map<string,variant>"
        ).alias("client_metadata"),
        F.lit(SDK_VERSION).alias("sdk_version"),
        F.lit(1).alias("schema_version"),
    )
    return redact_columns(
        events, ["input_preview", "output_preview", "error_message"], redactor=redactor
    )
