"""Sources, sinks, validation, enrichment, caps and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import caps as C
from ..functions import enrich as E
from ..functions.text import word_count
from ..operators import sampling as S
from ..operators.dedupe import first_wins, unseen
from ..operators.process import check, to_logs
from ..operators.validate import valid_content, validate
from ..schemas import LOG_COLUMNS, ROLES
from ..session import shared_dir
from ..sources import bronze as B
from ..sources import tables as T
from ..sources.store import LogStore
from ..streaming.ingest import ingest_batch
from . import inputs as I
from .registry import query

# Damaged events by remainder of their id, see inputs.shape_events.
_INVALID = "(1, 2, 3, 4, 5, 6, 8, 14, 15, 18, 19, 20, 23, 24, 25, 26)"
_REFUSED = "(7, 21)"
_KNOWN = "(SELECT *, event_id % 50 AS m FROM raw) AS known"


def _events(spark, sf, damaged=True):
    return I.events_json(spark, sf, damaged)


def _violations(spark, sf, *codes):
    errors = F.explode("errors").alias("_e")
    return (
        validate(_events(spark, sf))
        .select("event_id", errors)
        .select("event_id", "_e.field", "_e.code")
        .filter(F.col("code").isin(*codes))
    )


# ------------------------------------------------------------ sources, sinks


@query("a1_envelope_events", f"""WITH {I.BATCHES_SQL}
SELECT batch_id, (event_id - min(event_id) OVER (PARTITION BY batch_id))::BIGINT AS pos,
  printf('00000000-0000-4000-8000-%012x', event_id) AS request_id FROM batched
UNION ALL SELECT 'empty-' || (event_id // 1000), NULL, NULL FROM events GROUP BY 1""")
def _(spark, sf):
    events = B.explode_envelopes(I.envelopes(spark, sf))
    doc = F.try_parse_json("value")
    return events.select(
        "batch_id", "pos", F.try_variant_get(doc, "$.request_id", "string").alias("request_id")
    )


@query("a3_poison_events", """SELECT event_id, CASE WHEN event_id % 50 IN (6, 19, 23, 24, 25, 26) THEN 'poison'
  WHEN event_id % 50 = 20 THEN 'no object' ELSE 'json' END AS decoded FROM events""")
def _(spark, sf):
    checked = validate(_events(spark, sf))
    root = F.get(F.filter("errors", lambda e: e["field"] == "$"), 0)["code"]
    return checked.select(
        "event_id",
        F.when(root == "unparseable", "poison").when(root == "type", "no object").otherwise("json").alias("decoded"),
    )


@query("a4_arrival_stamp", """SELECT TIMESTAMP '2024-02-01 00:00:00' AS received_at, count(*) AS events FROM events""")
def _(spark, sf):
    own = F.concat(F.lit('{"received_at":"1999-01-01T00:00:00Z",'), F.substring("value", 2, 1 << 30))
    sent = _events(spark, sf, False).withColumn("value", own)
    stamped = B.stamp(sent, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return validate(stamped).groupBy("received_at").agg(F.count("*").alias("events"))


@query("a5_arrival_defaults", """SELECT count(*) AS events, count(*) AS received, count(*) AS processed FROM events""")
def _(spark, sf):
    logs = to_logs(check(_events(spark, sf, False)).checked)
    return logs.agg(
        F.count("*").alias("events"), F.count("received_at").alias("received"),
        F.count("processed_at").alias("processed"),
    )


def _deliveries(spark, sf):
    """Every event one to three times; later copies look slower."""
    copies = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    return I.raw_logs(spark, sf).withColumn("copy", F.explode(copies)).withColumn(
        "latency_ms", F.col("latency_ms") + F.col("copy")
    )


@query("a6_first_wins", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, latency_ms FROM raw")
def _(spark, sf):
    return first_wins(_deliveries(spark, sf), ["started_at", "copy"]).select("request_id", "latency_ms")


@query("a6_insert_new", f"""WITH {I.RAW_LOGS_SQL} SELECT request_id, latency_ms FROM raw
WHERE started_at >= TIMESTAMP '2024-01-15 00:00:00'""")
def _(spark, sf):
    logs = I.raw_logs(spark, sf)
    stored = logs.filter(F.col("started_at") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    fresh = first_wins(_deliveries(spark, sf), ["started_at", "copy"])
    return unseen(fresh, stored).select("request_id", "latency_ms")


@query("a6_store_twice", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, latency_ms, started_at FROM raw")
def _(spark, sf):
    store = LogStore(spark, shared_dir(spark, "store"))
    sent = _events(spark, sf, False).select("value")
    ingest_batch(sent, store, 0)
    ingest_batch(sent, store, 1)
    return store.logs().select("request_id", "latency_ms", "started_at")


@query("a10_compacted_store", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, latency_ms, started_at FROM raw")
def _(spark, sf):
    """All events in three batches, the last also holding the first's again; two of them packed, one as it came."""
    store = LogStore(spark, shared_dir(spark, "store"))
    sent = _events(spark, sf, False).select("value", F.pmod(F.xxhash64("value"), F.lit(3)).alias("part"))
    for batch_id, parts in enumerate(((0,), (1,), (0, 2))):
        ingest_batch(sent.filter(F.col("part").isin(*parts)).select("value"), store, batch_id)
        store.compact(fan=2)
    store.expire()
    return store.logs().select("request_id", "latency_ms", "started_at")


_MISSING_ALL = "; ".join(
    f"{n}: missing" for n in (
        "request_id", "service", "provider", "model", "status", "streamed", "started_at",
        "completed_at", "latency_ms",
    )
)
# The error text of every damaged shape.
_ERRORS_SQL = f"""CASE m
  WHEN 1 THEN 'validation error: latency_ms: missing' WHEN 2 THEN 'validation error: status: enum'
  WHEN 3 THEN 'validation error: latency_ms: range' WHEN 4 THEN 'validation error: latency_ms: type'
  WHEN 5 THEN 'validation error: request_id: type'
  WHEN 6 THEN 'validation error: $: unparseable; {_MISSING_ALL}'
  WHEN 7 THEN 'processing error: latency_ms out of range' WHEN 8 THEN 'validation error: model: length'
  WHEN 14 THEN 'validation error: tags: type' WHEN 15 THEN 'validation error: tags: size'
  WHEN 18 THEN 'validation error: input_preview: length'
  WHEN 19 THEN 'validation error: $: unparseable; {_MISSING_ALL}'
  WHEN 23 THEN 'validation error: $: unparseable; {_MISSING_ALL}' WHEN 24 THEN 'validation error: $: unparseable; {_MISSING_ALL}'
  WHEN 25 THEN 'validation error: $: unparseable; {_MISSING_ALL}' WHEN 26 THEN 'validation error: $: unparseable; {_MISSING_ALL}'
  WHEN 20 THEN 'validation error: $: type; {_MISSING_ALL}'
  WHEN 21 THEN 'processing error: model holds NUL' END"""


@query("a7_dead_letters", f"""WITH {I.RAW_LOGS_SQL}
SELECT error, CASE WHEN m IN {_REFUSED} THEN 'processing' ELSE 'validation' END AS stage,
  m IN (6, 19, 23, 24, 25, 26) AS wrapped, count(*) AS events
FROM (SELECT {_ERRORS_SQL} AS error, m FROM {_KNOWN}) WHERE error IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    letters = check(_events(spark, sf)).dead_letters
    return letters.groupBy(
        "error", "stage", F.startswith("data", F.lit('{"__unparseable__":')).alias("wrapped")
    ).agg(F.count("*").alias("events"))


@query("a8_pricing", f"WITH {I.RAW_LOGS_SQL}, {I.PRICES_SQL} SELECT p_model AS model, input_rate, output_rate, count(request_id) AS calls FROM prices LEFT JOIN raw ON model = p_model GROUP BY ALL")
def _(spark, sf):
    calls = I.raw_logs(spark, sf).groupBy("model").agg(F.count("*").alias("calls"))
    return E.pricing(spark).join(calls, "model", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


@query("a9_available_models", """WITH asked AS (SELECT DISTINCT (['gpt-4o-mini', 'gpt-4.1', 'claude-sonnet-4-5', 'mock-1', 'retired-1'])[(conv_id % 5 + 1)::INT] AS model FROM conversations),
known(model, provider, label) AS (VALUES ('gpt-4o-mini', 'openai', 'GPT-4o mini'), ('gpt-4.1', 'openai', 'GPT-4.1'), ('mock-1', 'mock', 'Mock model (offline)'))
SELECT model, provider, label FROM asked JOIN known USING (model)""")
def _(spark, sf):
    asked = I.conversations(spark, sf).select("model").distinct()
    models = T.available_models(T.model_catalog(spark), ["openai", "mock"])
    return asked.join(models, "model").select("model", "provider", "label")


@query("a10_log_scan", f"WITH {I.LOGS_SQL} SELECT request_id, conversation_id, started_at, status, total_tokens, estimated_cost_usd FROM logs")
def _(spark, sf):
    return I.stored_logs(spark, sf).select(
        "request_id", "conversation_id", "started_at", "status", "total_tokens", "estimated_cost_usd"
    )


# ---------------------------------------------------------------- validation

_ALWAYS_MISSING = "('request_id'), ('service'), ('provider'), ('model'), ('status'), ('streamed'), ('started_at'), ('completed_at'), ('latency_ms')"


@query("b1_required_fields", f"""SELECT event_id, field, 'missing' AS code FROM events, (VALUES {_ALWAYS_MISSING}) f(field)
WHERE event_id % 50 IN (6, 19, 20, 23, 24, 25, 26) OR (event_id % 50 = 1 AND field = 'latency_ms')""")
def _(spark, sf):
    return _violations(spark, sf, "missing")


@query("b2_lax_types", f"""WITH {I.RAW_LOGS_SQL}
SELECT event_id, CASE WHEN m = 5 THEN NULL ELSE request_id END AS request_id,
  CASE WHEN m IN (1, 4) THEN NULL WHEN m = 3 THEN -1 WHEN m = 7 THEN 2147483648 WHEN m = 22 THEN 1 ELSE latency_ms END::BIGINT AS latency_ms,
  CASE WHEN m = 11 AND NOT streamed THEN false ELSE streamed END AS streamed,
  CASE WHEN m = 12 THEN date_trunc('millisecond', started_at) ELSE started_at END AS started_at
FROM {_KNOWN} WHERE m NOT IN (6, 19, 20, 23, 24, 25, 26)""")
def _(spark, sf):
    readable = ~F.exists("errors", lambda e: e["field"] == "$")
    return validate(_events(spark, sf)).filter(readable).select(
        "event_id", "request_id", "latency_ms", "streamed", "started_at"
    )


@query("b2_type_errors", """SELECT event_id, CASE event_id % 50 WHEN 4 THEN 'latency_ms' WHEN 5 THEN 'request_id'
  WHEN 14 THEN 'tags' ELSE '$' END AS field, 'type' AS code FROM events WHERE event_id % 50 IN (4, 5, 14, 20)""")
def _(spark, sf):
    return _violations(spark, sf, "type")


@query("b3_unknown_fields_ignored", f"""SELECT event_id % 50 = 17 AS has_unknown_field, count(*) AS events FROM events WHERE event_id % 50 NOT IN {_INVALID} GROUP BY 1""")
def _(spark, sf):
    checked = validate(_events(spark, sf)).filter(F.col("error").isNull())
    return checked.groupBy(F.contains("value", F.lit("x_new_field")).alias("has_unknown_field")).agg(
        F.count("*").alias("events")
    )


@query("b4_status_values", "SELECT event_id, 'status' AS field, 'enum' AS code FROM events WHERE event_id % 50 = 2")
def _(spark, sf):
    return _violations(spark, sf, "enum")


@query("b5_non_negative", "SELECT event_id, 'latency_ms' AS field, 'range' AS code FROM events WHERE event_id % 50 = 3")
def _(spark, sf):
    return _violations(spark, sf, "range")


@query("b6_length_limits", "SELECT event_id, CASE event_id % 50 WHEN 8 THEN 'model' ELSE 'input_preview' END AS field, 'length' AS code FROM events WHERE event_id % 50 IN (8, 18)")
def _(spark, sf):
    return _violations(spark, sf, "length")


@query("b7_map_size", "SELECT event_id, 'tags' AS field, 'size' AS code FROM events WHERE event_id % 50 = 15")
def _(spark, sf):
    return _violations(spark, sf, "size")


@query("b8_defaults", f"""WITH {I.RAW_LOGS_SQL} SELECT event_id, 1::BIGINT AS schema_version, 0::BIGINT AS pii_redaction_count, ttft_ms::BIGINT AS ttft_ms,
  replace(tags_json, ' ', '') AS tags FROM {_KNOWN} WHERE m NOT IN {_INVALID}""")
def _(spark, sf):
    return validate(_events(spark, sf)).filter(F.col("error").isNull()).select(
        "event_id", "schema_version", "pii_redaction_count", "ttft_ms", F.to_json("tags").alias("tags")
    )


# A truncated event makes its whole batch unreadable, trailing text as well.
_VERDICTS_SQL = f"""WITH {I.BATCHES_SQL}, judged AS (
  SELECT batch_id, max(CASE WHEN event_id % 50 IN (6, 19, 23, 24, 25, 26) THEN 1 ELSE 0 END) AS broken,
    count(*) AS n, count(*) FILTER (WHERE event_id % 50 IN {_INVALID}) AS bad FROM batched GROUP BY 1)
SELECT batch_id, CASE WHEN broken = 1 THEN 0 ELSE n END AS events, CASE WHEN broken = 1 THEN 0 ELSE bad END AS invalid,
  broken = 0 AND n BETWEEN 1 AND 500 AND bad = 0 AS accepted FROM judged
UNION ALL SELECT 'empty-' || (event_id // 1000), 0, 0, false FROM events GROUP BY 1"""


@query("b9_batch_verdicts", _VERDICTS_SQL)
def _(spark, sf):
    return B.judge_batches(B.explode_envelopes(I.envelopes(spark, sf, True)))


@query("b9_accepted_events", f"""WITH {I.BATCHES_SQL}
SELECT batch_id, count(*) AS events FROM batched GROUP BY 1 HAVING count(*) <= 500""")
def _(spark, sf):
    events = B.accepted_events(B.explode_envelopes(I.envelopes(spark, sf)))
    return events.groupBy("batch_id").agg(F.count("*").alias("events"))


@query("b10_accept_or_park", f"""SELECT CASE WHEN event_id % 50 IN {_INVALID} THEN 'validation' WHEN event_id % 50 IN {_REFUSED} THEN 'processing' ELSE 'stored' END AS outcome, count(*) AS events FROM events GROUP BY 1""")
def _(spark, sf):
    checked = check(_events(spark, sf)).checked
    return checked.groupBy(F.coalesce("stage", F.lit("stored")).alias("outcome")).agg(F.count("*").alias("events"))


@query("b11_storage_limits", f"""WITH {I.RAW_LOGS_SQL} SELECT event_id, {_ERRORS_SQL} AS error FROM {_KNOWN} WHERE m IN {_REFUSED}""")
def _(spark, sf):
    return check(_events(spark, sf)).checked.filter(F.col("stage") == "processing").select("event_id", "error")


@query("b12_merge_tags", f"""WITH {I.RAW_LOGS_SQL} SELECT event_id, '{{"channel":"web",' || substr(replace(tags_json, ' ', ''), 2) AS client_metadata FROM raw""")
def _(spark, sf):
    checked = check(_events(spark, sf, False)).checked
    return checked.select("event_id", F.to_json("client_metadata").alias("client_metadata"))


@query("b13_log_rows", f"""WITH {I.LOGS_SQL} SELECT request_id, conversation_id, service, provider, model, status, streamed, started_at,
  started_at AS completed_at, latency_ms, ttft_ms, prompt_tokens, completion_tokens, total_tokens, tokens_per_second, estimated_cost_usd,
  error_type, error_message, 'mail user' || event_id || '@example.com' AS input_preview, NULL::VARCHAR AS output_preview,
  0 AS pii_redaction_count, '0.4.0' AS sdk_version, 1 AS schema_version, '{{"channel":"web",' || substr(replace(tags_json, ' ', ''), 2) AS client_metadata,
  TIMESTAMP '2024-02-01 00:00:00' AS received_at FROM logs""")
def _(spark, sf):
    stamped = B.stamp(_events(spark, sf, False), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    rows = check(stamped).logs.select(*LOG_COLUMNS)
    return rows.withColumn("client_metadata", F.to_json("client_metadata"))


@query("b14_message_content", """SELECT conv_id, turn, trim(text) AS content FROM conversations WHERE length(text) BETWEEN 1 AND 8000 AND trim(text) <> ''""")
def _(spark, sf):
    padded = F.concat(F.lit(" \t"), "text", F.lit("\n"))
    rows = I.table(spark, sf, "conversations").withColumn("content", valid_content(padded))
    return rows.filter(F.col("content").isNotNull()).select("conv_id", "turn", "content")


@query("b15_roles", """SELECT role, role IN ('system', 'user', 'assistant') AS accepted, count(*) AS messages FROM
(SELECT role FROM conversations UNION ALL SELECT upper(role) FROM conversations) GROUP BY ALL""")
def _(spark, sf):
    roles = I.table(spark, sf, "conversations").select("role")
    both = roles.unionByName(roles.select(F.upper("role").alias("role")))
    return both.groupBy("role", F.col("role").isin(*ROLES).alias("accepted")).agg(F.count("*").alias("messages"))


@query("b16_model_check", f"""WITH {I.CONVERSATIONS_SQL} SELECT id, CASE model WHEN 'claude-sonnet-4-5' THEN NULL WHEN 'retired-1' THEN NULL WHEN 'mock-1' THEN 'mock' ELSE 'openai' END AS provider,
  model NOT IN ('claude-sonnet-4-5', 'retired-1') AS accepted FROM conv""")
def _(spark, sf):
    models = T.available_models(T.model_catalog(spark), ["openai", "mock"])
    accepted, rejected = T.split_by_model(I.conversations(spark, sf), models)
    return accepted.select("id", "provider", F.lit(True).alias("accepted")).unionByName(
        rejected.select("id", F.lit(None).cast("string").alias("provider"), F.lit(False).alias("accepted"))
    )


# ---------------------------------------------------------------- enrichment


@query("c1_total_tokens", f"WITH {I.LOGS_SQL} SELECT request_id, total_tokens::BIGINT AS total_tokens FROM logs")
def _(spark, sf):
    total = E.total_tokens(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))
    return I.raw_logs(spark, sf).select("request_id", total.alias("total_tokens"))


@query("c2_cost", f"WITH {I.LOGS_SQL} SELECT request_id, model, estimated_cost_usd FROM logs")
def _(spark, sf):
    return E.with_cost(I.raw_logs(spark, sf)).select("request_id", "model", "estimated_cost_usd")


@query("c3_tokens_per_second", f"WITH {I.LOGS_SQL} SELECT request_id, tokens_per_second FROM logs")
def _(spark, sf):
    rate = E.tokens_per_second(F.col("completion_tokens"), F.col("latency_ms"))
    return I.raw_logs(spark, sf).select("request_id", rate.alias("tokens_per_second"))


@query("c4_elapsed_ms", f"WITH {I.LOGS_SQL} SELECT request_id, latency_ms::BIGINT AS latency_ms FROM logs")
def _(spark, sf):
    # 999 microseconds on top must not count.
    end = F.timestamp_micros(F.unix_micros("completed_at") + 999)
    return I.stored_logs(spark, sf).select(
        "request_id", E.elapsed_ms(F.col("started_at"), end).alias("latency_ms")
    )


@query("c5_word_usage", r"""SELECT conv_id, turn, greatest(len(regexp_extract_all(text, '\S+')), 1)::BIGINT AS words FROM conversations""")
def _(spark, sf):
    return I.table(spark, sf, "conversations").select("conv_id", "turn", word_count(F.col("text")).alias("words"))


@query("c6_success_rate", f"WITH {I.LOGS_SQL} SELECT model, count(*) FILTER (WHERE status = 'success') * 100.0::DOUBLE / count(*) AS success_rate FROM logs GROUP BY 1")
def _(spark, sf):
    per = I.raw_logs(spark, sf).groupBy("model").agg(
        F.count_if(F.col("status") == "success").alias("ok"), F.count("*").alias("n")
    )
    return per.select("model", E.success_rate(F.col("ok"), F.col("n")).alias("success_rate"))


# ---------------------------------------------------------------------- caps


@query("f1_cap_text", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1999) || '…' ELSE text END AS text FROM documents")
def _(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", C.cap_text(F.col("text"), C.ERROR_CHARS).alias("text"))


@query("f2_cap_value", """SELECT doc_id, CASE WHEN length(text) > 256 THEN substr(text, 1, 255) || '…' ELSE text END AS text,
  n_chars::VARCHAR AS number, '["' || lang || '",1]' AS list FROM documents""")
def _(spark, sf):
    values = {
        "text": F.col("text").cast("variant"),
        "number": F.col("n_chars").cast("variant"),
        "list": F.parse_json(F.concat(F.lit('["'), "lang", F.lit('", 1]'))),
    }
    return I.table(spark, sf, "documents").select(
        "doc_id",
        *[F.try_variant_get(C.cap_value(v), "$", "string").alias(n) for n, v in values.items()],
    )


@query("f3_cap_map", """WITH parts AS (SELECT doc_id, range AS i, substr(text, (1 + range * 200)::BIGINT, 200) AS part FROM documents, unnest(range(greatest(40, ceil(length(text) / 200))::BIGINT)) AS t(range)),
capped AS (SELECT doc_id, i, length(part) AS chars,
  4 + 4 + length('k' || (100 + i)) + sum(0) OVER () + (length(to_json(part)::VARCHAR) - 2)
  + 5 * length(regexp_replace(to_json(part)::VARCHAR, '[ -~]', '', 'g'))
  + 6 * length(regexp_replace(to_json(part)::VARCHAR, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS size
  FROM parts WHERE i < 32),
run AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM capped)
SELECT doc_id, count(*) FILTER (WHERE total <= 4096) AS kept, coalesce(sum(chars) FILTER (WHERE total <= 4096), 0)::BIGINT AS chars FROM run GROUP BY 1""")
def _(spark, sf):
    last = F.greatest(F.lit(40), F.ceil(F.length("text") / 200)).cast("int") - 1
    numbers = F.sequence(F.lit(0), last)
    tags = F.map_from_arrays(
        F.transform(numbers, lambda i: F.concat(F.lit("k"), (i + 100).cast("string"))),
        F.transform(numbers, lambda i: F.col("text").substr(i * 200 + 1, F.lit(200)).cast("variant")),
    )
    capped = I.table(spark, sf, "documents").select("doc_id", C.cap_dict(tags).alias("t"))
    texts = F.transform(F.map_values("t"), lambda v: F.length(F.try_variant_get(v, "$", "string")))
    return capped.select(
        "doc_id", F.size("t").cast("long").alias("kept"),
        F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"),
    )


@query("f4_cap_events", f"""WITH {I.RAW_LOGS_SQL} SELECT request_id, CASE WHEN event_id % 7 = 0 THEN repeat('e', 1999) || '…' ELSE error_message END AS error_message,
  replace(tags_json, ' ', '') AS tags, '{{"note":"' || CASE WHEN event_id % 7 = 0 THEN repeat('n', 255) || '…' ELSE 'short' END || '"}}' AS client_metadata FROM raw""")
def _(spark, sf):
    long = F.col("event_id") % 7 == 0
    note = F.when(long, F.repeat(F.lit("n"), 5000)).otherwise("short").cast("variant")
    events = I.raw_logs(spark, sf).withColumns(
        {
            "error_message": F.when(long, F.repeat(F.lit("e"), 4000)).otherwise(F.col("error_message")),
            "tags": F.from_json("tags_json", "map<string,variant>"),
            "client_metadata": F.create_map(F.lit("note"), note),
        }
    )
    return C.cap_events(events).select(
        "request_id", "error_message", F.to_json("tags").alias("tags"), F.to_json("client_metadata").alias("client_metadata")
    )


# ------------------------------------------------------------------ sampling


@query("g1_keep_all", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, status FROM raw")
def _(spark, sf):
    return S.sample(I.raw_logs(spark, sf), S.KeepAll()).select("request_id", "status")


@query("g2_probability", """SELECT rate, count(*) AS events, true AS within_bounds FROM events, (VALUES (0.0::DOUBLE), (4e-7), (0.25), (1.0)) r(rate) GROUP BY 1""")
def _(spark, sf):
    logs = I.raw_logs(spark, sf)
    kept = {r: F.count_if(S.Probability(r).keep(logs)) for r in (0.0, 4e-7, 0.25, 1.0)}
    counts = logs.agg(
        F.count("*").alias("events"),
        F.array(
            *[F.struct(F.lit(r).alias("rate"), k.alias("kept")) for r, k in kept.items()]
        ).alias("_r"),
    )
    # Six standard deviations of the binomial count.
    slack = 6 * F.sqrt(F.col("events") * F.col("rate") * (1 - F.col("rate")))
    return counts.select("events", F.inline("_r")).select(
        "rate", "events", (F.abs(F.col("kept") - F.col("events") * F.col("rate")) <= slack).alias("within_bounds")
    )


@query("g3_keep_errors", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, status FROM raw WHERE status IN ('error', 'cancelled')")
def _(spark, sf):
    return S.sample(I.raw_logs(spark, sf), S.AlwaysKeepErrors(S.Probability(0.0))).select("request_id", "status")


@query("g4_custom_predicate", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, status, completion_tokens FROM raw WHERE coalesce(completion_tokens > 300, true)")
def _(spark, sf):
    sampler = S.CustomSampler(F.col("completion_tokens") > 300)
    return S.sample(I.raw_logs(spark, sf), sampler).select("request_id", "status", "completion_tokens")


@query("g4_custom_function", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, status FROM raw WHERE coalesce(completion_tokens > 300, true)")
def _(spark, sf):
    def long(event):
        return event["completion_tokens"] > 300  # raises on a null, which keeps the event

    logs = I.raw_logs(spark, sf).select("request_id", "status", "completion_tokens")
    return S.sample(logs, S.CustomSampler(long)).select("request_id", "status")


@query("g5_drop_ledger", f"WITH {I.RAW_LOGS_SQL} SELECT 'sampled' AS reason, count(*) AS dropped FROM raw WHERE status = 'success' HAVING count(*) > 0")
def _(spark, sf):
    return S.drop_ledger(I.raw_logs(spark, sf), S.AlwaysKeepErrors(S.Probability(0.0)))
