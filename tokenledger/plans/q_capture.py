"""Stored exchanges turned into events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as L
from ..functions import json as J
from ..operators import capture as X
from ..operators.instrument import instrument_calls
from ..operators.streams import stream_lines
from . import inputs as I
from .q_redaction import _SUM, staged
from .registry import query

_WITH = f"WITH {I.CAPTURES_SQL}"


def _routed(spark, sf):
    captures, chunks = I.captures(spark, sf)
    return X.route(captures), chunks


def _parsed(spark, sf):
    routed, chunks = _routed(spark, sf)
    return X.parse_requests(routed), chunks


def _streams(spark, sf, *providers):
    """Folded streams of some providers."""
    requests, chunks = _parsed(spark, sf)
    mine = requests.filter(F.col("provider").isin(*providers))
    return X.fold_streams(mine.join(chunks.select("request_id").distinct(), "request_id"), chunks)


@query("a11_exchanges", f"""{_WITH} SELECT count(*) AS exchanges, count(*) FILTER (WHERE coalesce(code = 200, false) AND streaming AND call) AS streamed FROM cap0""")
def _(spark, sf):
    captures, chunks = I.captures(spark, sf)
    pieces = chunks.groupBy("request_id").agg(F.count("*").alias("n"))
    return captures.join(pieces, "request_id", "left").agg(
        F.count("*").alias("exchanges"), F.count("n").alias("streamed")
    )


@query("e1_route", f"{_WITH} SELECT request_id, provider FROM cap")
def _(spark, sf):
    return _routed(spark, sf)[0].select("request_id", "provider")


@query("e2_other_traffic", f"{_WITH} SELECT call AS captured, count(*) AS exchanges FROM cap0 GROUP BY 1")
def _(spark, sf):
    captures, _ = I.captures(spark, sf)
    known = X.route(captures).select("request_id", F.lit(True).alias("captured"))
    return captures.join(known, "request_id", "left").groupBy(
        F.coalesce("captured", F.lit(False)).alias("captured")
    ).agg(F.count("*").alias("exchanges"))


SHOP = X.Handler(
    "shop",
    matches=lambda host, path: (host == "example.com") & F.endswith(path, F.lit("/orders")),
    request=lambda body: {
        "model": F.concat(F.lit("item-"), J.as_text(J.field(body, "$.item"))),
        "streaming": F.lit(False),
        "input_text": F.lit(None).cast("string"),
    },
    response=lambda body: {
        "output_text": J.as_text(J.field(body, "$.ok")),
        "prompt_tokens": F.lit(1).cast("long"),
        "completion_tokens": F.lit(2).cast("long"),
        "total_tokens": F.lit(3).cast("long"),
    },
)


@query("e3_custom_handler", f"""{_WITH} SELECT request_id, coalesce(provider, 'shop') AS provider,
  CASE WHEN call THEN 'model-' || (conv_id % 4) ELSE 'item-' || turn END AS model FROM cap0""")
def _(spark, sf):
    captures, _ = I.captures(spark, sf)
    handlers = X.add_handler(SHOP)
    return X.parse_requests(X.route(captures, handlers), handlers).select("request_id", "provider", "model")


@query("e4_request_meta", f"{_WITH} SELECT request_id, 'model-' || (conv_id % 4) AS model, streaming FROM cap")
def _(spark, sf):
    return _parsed(spark, sf)[0].select("request_id", "model", "streaming")


@query("e5_last_user_text", f"{_WITH} SELECT request_id, input_text FROM cap")
def _(spark, sf):
    return _parsed(spark, sf)[0].select("request_id", "input_text")


_META_SQL = "request_id, output_text, prompt_tokens, completion_tokens, total_tokens"
_META = ("request_id", "output_text", "prompt_tokens", "completion_tokens", "total_tokens")


def _whole_sql(*providers):
    names = ", ".join(f"'{p}'" for p in providers)
    return f"{_WITH} SELECT {_META_SQL} FROM cap WHERE provider IN ({names}) AND code = 200 AND NOT streaming AND conv_id % 17 <> 8"


def _whole(spark, sf, *providers):
    requests, _ = _parsed(spark, sf)
    mine = requests.filter(F.col("provider").isin(*providers) & (F.col("status_code") == 200) & ~F.col("streaming"))
    readable = X.parse_responses(mine).filter(F.col("response_body") != "oops{")
    return readable.select(*_META)


@query("e6_openai_response", _whole_sql("openai", "openai_compatible"))
def _(spark, sf):
    return _whole(spark, sf, "openai", "openai_compatible")


@query("e7_anthropic_response", _whole_sql("anthropic"))
def _(spark, sf):
    return _whole(spark, sf, "anthropic")


@query("e8_ollama_response", _whole_sql("ollama"))
def _(spark, sf):
    return _whole(spark, sf, "ollama")


@query("e9_stream_lines", f"""{_WITH}, n AS (SELECT *, CASE WHEN half THEN ceil(len(words) / 2.0)::INT ELSE len(words) END AS w FROM cap WHERE live)
SELECT request_id, CASE provider WHEN 'ollama' THEN w + (NOT half)::INT
  WHEN 'anthropic' THEN 3 + 3 * w + 4 * (NOT half)::INT ELSE 2 * w + 4 * (NOT half)::INT END AS lines FROM n""")
def _(spark, sf):
    _, chunks = I.captures(spark, sf)
    return stream_lines(chunks).groupBy("request_id").agg(F.count("*").cast("int").alias("lines"))


def _stream_sql(*providers):
    names = ", ".join(f"'{p}'" for p in providers)
    return f"{_WITH} SELECT {_META_SQL}, NOT half AS completed FROM cap WHERE live AND provider IN ({names})"


@query("e10_openai_stream", _stream_sql("openai", "openai_compatible"))
def _(spark, sf):
    return _streams(spark, sf, "openai", "openai_compatible").select(*_META, "completed")


@query("e11_anthropic_stream", _stream_sql("anthropic"))
def _(spark, sf):
    return _streams(spark, sf, "anthropic").select(*_META, "completed")


@query("e12_ollama_stream", _stream_sql("ollama"))
def _(spark, sf):
    return _streams(spark, sf, "ollama").select(*_META, "completed")


def _events(spark, sf):
    return X.capture_events(*I.captures(spark, sf), service="gateway")


@query("e13_first_token", f"{_WITH} SELECT request_id, CASE WHEN live THEN ttft_ms END AS ttft_ms FROM cap")
def _(spark, sf):
    return _events(spark, sf).select("request_id", "ttft_ms")


@query("e14_stream_outcome", f"{_WITH} SELECT request_id, status FROM cap WHERE live")
def _(spark, sf):
    folded = _streams(spark, sf, "openai", "anthropic", "ollama", "openai_compatible")
    status = X.stream_status(F.col("stream_ended"), F.col("completed"), F.col("exception_class"))
    return folded.select("request_id", status.alias("status"))


@query("e15_status_labels", """SELECT o_orderkey, CASE WHEN code IN (401, 403) THEN 'auth' WHEN code = 429 THEN 'rate_limit' WHEN code IN (408, 504) THEN 'timeout'
  WHEN code BETWEEN 400 AND 499 THEN 'invalid_request' ELSE 'provider_error' END AS label FROM (SELECT o_orderkey, 400 + o_orderkey % 200 AS code FROM orders)""")
def _(spark, sf):
    code = F.lit(400) + F.col("o_orderkey") % 200
    return I.table(spark, sf, "orders").select("o_orderkey", L.status_error(code).alias("label"))


_CLASSES = ("RateLimitError", "ReadTimeout", "AuthenticationError", "AuthError", "PermissionDenied", "ConnectError",
            "ConnectionReset", "BadRequestError", "InvalidRequestError", "NotFoundError", "ValueError")


def _class_sql(labels):
    return (
        "SELECT event_id, (" + str(list(_CLASSES)) + ")[(event_id % 11 + 1)::INT] AS error_class, ("
        + str(list(labels)) + ")[(event_id % 11 + 1)::INT] AS label FROM events"
    )


def _classes(spark, sf):
    names = F.array(*[F.lit(c) for c in _CLASSES])
    index = (F.col("event_id") % 11).cast("int")
    return I.table(spark, sf, "events").select("event_id", names[index].alias("error_class"))


@query("e16_captured_error_labels", _class_sql(("rate_limit", "timeout", "auth", "auth", "auth", "connection", "connection",
                                                "provider_error", "provider_error", "provider_error", "provider_error")))
def _(spark, sf):
    return _classes(spark, sf).withColumn("label", L.captured_error(F.col("error_class")))


@query("e17_call_error_labels", _class_sql(("rate_limit", "timeout", "auth", "provider_error", "auth", "provider_error", "connection",
                                            "invalid_request", "invalid_request", "invalid_request", "provider_error")))
def _(spark, sf):
    return _classes(spark, sf).withColumn("label", L.call_error(F.col("error_class")))


@query("e18_http_errors", f"{_WITH} SELECT request_id, error_type, error_message FROM cap WHERE code >= 400")
def _(spark, sf):
    kind, message = X.exchange_error()
    routed = _routed(spark, sf)[0].filter(F.col("status_code") >= 400)
    return routed.select("request_id", kind.alias("error_type"), message.alias("error_message"))


@query("e19_unreadable_response", f"{_WITH} SELECT request_id, status, NULL::BIGINT AS prompt_tokens, NULL::VARCHAR AS output_preview FROM cap WHERE code = 200 AND NOT streaming AND conv_id % 17 = 8")
def _(spark, sf):
    captures, chunks = I.captures(spark, sf)
    events = X.capture_events(captures.filter(F.col("response_body") == "oops{"), chunks)
    return events.select("request_id", "status", "prompt_tokens", "output_preview")


_PREVIEW = r"nullif(substr(regexp_replace({}, '^\s+|\s+$', '', 'g'), 1, 280), '')"
_EVENT_SQL = f"""{_WITH}, shown AS (SELECT *, {_PREVIEW.format('input_text')} AS i, {_PREVIEW.format('output_text')} AS o FROM cap),
{staged('shown', 'i', 'request_id', name='ri')}, {staged('shown', 'o', 'request_id', name='ro')}, {staged('shown', 'error_message', 'request_id', name='re')},
event AS (SELECT s.*, ri.text AS input_preview, ro.text AS output_preview, re.text AS red_error,
  (ri.h + ro.h + re.h)::INTEGER AS pii_redaction_count FROM shown s
  JOIN (SELECT *, {_SUM} AS h FROM ri) ri USING (request_id) JOIN (SELECT *, {_SUM} AS h FROM ro) ro USING (request_id)
  JOIN (SELECT *, {_SUM} AS h FROM re) re USING (request_id))"""


@query("e20_events", f"""{_EVENT_SQL} SELECT request_id, 'gateway' AS service, provider, 'model-' || (conv_id % 4) AS model, status, streaming AS streamed, started_at,
  conversation_id, CASE WHEN live THEN ttft_ms END AS ttft_ms, prompt_tokens, completion_tokens, total_tokens, input_preview, output_preview,
  error_type, red_error AS error_message, pii_redaction_count, '{{"auto_instrumented":true,"transport":"httpx"}}' AS client_metadata FROM event""")
def _(spark, sf):
    events = _events(spark, sf).drop("completed_at", "latency_ms", "tags", "sdk_version", "schema_version")
    return events.withColumn("client_metadata", F.to_json("client_metadata"))


@query("e21_merge_tags", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":"outer","b":"inner"}' ELSE '{"a":"inner","b":"inner"}' END AS tags FROM events""")
def _(spark, sf):
    kinds = "map<string,variant>"
    inner = F.when(F.col("event_id") % 2 == 0, '{"a":null,"b":"inner"}').otherwise('{"a":"inner","b":"inner"}')
    merged = X.merge_tags(
        F.from_json(F.lit('{"a":"outer","b":"outer"}'), kinds), F.from_json(inner, kinds)
    )
    return I.table(spark, sf, "events").select("event_id", F.to_json(merged).alias("tags"))


@query("e22_conversation_id", f"{_WITH} SELECT request_id, conversation_id AS tagged, CASE WHEN conv_id % 2 = 0 THEN 'given' ELSE conversation_id END AS explicit FROM cap")
def _(spark, sf):
    routed, _ = _routed(spark, sf)
    conv = F.conv(F.substring("request_id", 25, 8), 16, 10).cast("long")
    given = F.when(conv % 2 == 0, "given")
    return routed.select(
        "request_id",
        X.conversation_of(F.col("tags")).alias("tagged"),
        X.conversation_of(F.col("tags"), given).alias("explicit"),
    )


# --------------------------------------------------------------------- hooks


def _requests(spark, sf):
    """One request per assistant turn: the question it answers."""
    rows = I.table(spark, sf, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    return rows.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"]).select(
        F.format_string("00000000-0000-4000-c000-%08x%04x", "conv_id", "turn").alias("request_id"),
        F.lit(None).cast("string").alias("conversation_id"),
        F.lit("mock").alias("provider"),
        F.when(F.col("conv_id") % 5 == 0, "broken").when(F.col("conv_id") % 5 == 1, "stream").otherwise("plain").alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("asked").alias("content"))).alias("messages"),
        F.from_json(F.lit('{"conversation_id":"c-1"}'), "map<string,variant>").alias("tags"),
        empty.alias("metadata"),
    )


def word_model(request):
    """Repeats the question; counts words."""
    text = request["messages"][-1]["content"]
    n = max(len(text.split()), 1)
    usage = {"prompt_tokens": n, "completion_tokens": n, "total_tokens": 2 * n}
    if request["model"] == "broken":
        raise ConnectionError("lost 10.0.0.5")
    if request["model"] == "stream":
        return iter([(text, None), ("", usage)])
    return text, usage


@query("k4_instrumented_calls", rf"""WITH asked AS (SELECT c.conv_id, c.turn, b.text, printf('00000000-0000-4000-c000-%08x%04x', c.conv_id, c.turn) AS request_id,
  greatest(len(regexp_extract_all(b.text, '\S+')), 1)::BIGINT AS n FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn WHERE c.role = 'assistant'),
cut AS (SELECT *, {_PREVIEW.format('text')} AS t FROM asked), {staged('cut', 't', 'request_id, conv_id, n')}
SELECT request_id, 'c-1' AS conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, conv_id % 5 = 1 AS streamed,
  CASE WHEN conv_id % 5 > 0 THEN n END AS prompt_tokens, CASE WHEN conv_id % 5 > 0 THEN 2 * n END AS total_tokens,
  text AS input_preview, CASE WHEN conv_id % 5 > 0 THEN text END AS output_preview,
  CASE WHEN conv_id % 5 = 0 THEN 'connection' END AS error_type, CASE WHEN conv_id % 5 = 0 THEN 'lost [REDACTED_IP]' END AS error_message FROM stage""")
def _(spark, sf):
    events = instrument_calls(_requests(spark, sf), word_model, "batch")
    return events.select(
        "request_id", "conversation_id", "status", "streamed", "prompt_tokens", "total_tokens",
        "input_preview", "output_preview", "error_type", "error_message",
    )
