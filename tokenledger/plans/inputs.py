"""Inputs of the registered queries, derived by Spark from the given tables.

Every derivation covers the whole table. Remainders of ids only decide which
shape a row takes, so that rare shapes occur in a fixed share of rows. The SQL
texts describe the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.enrich import enrich

AS_OF = "2024-01-31 00:00:00"

# Runs in Spark and DuckDB alike.
LOG_COLUMNS_SQL = (
    "event_id",
    "printf('00000000-0000-4000-8000-%012x', event_id) AS request_id",
    "printf('00000000-0000-4000-9000-%012x', user_id) AS conversation_id",
    "'answer-desk' AS service",
    "CASE WHEN event_id % 5 = 3 THEN 'anthropic' "
    "WHEN event_id % 5 = 4 THEN 'openai_compatible' ELSE 'openai' END AS provider",
    "CASE event_id % 5 WHEN 0 THEN 'gpt-4.1' WHEN 1 THEN 'gpt-4.1-mini' "
    "WHEN 2 THEN 'gpt-4o-mini' WHEN 3 THEN 'claude-sonnet-4-5' ELSE 'unpriced-7b' END AS model",
    "CASE WHEN event_type = 'error' THEN 'error' "
    "WHEN event_id % 20 = 7 THEN 'cancelled' ELSE 'success' END AS status",
    "event_id % 4 <> 2 AS streamed",
    "ts AS started_at",
    "CAST(120 + floor(value * 10) AS INT) AS latency_ms",
    "CASE WHEN event_id % 4 <> 2 AND event_type <> 'error' "
    "THEN CAST(120 + event_id % 380 AS INT) END AS ttft_ms",
    "CAST(20 + event_id % 380 AS INT) AS prompt_tokens",
    "CASE WHEN event_type <> 'error' THEN CAST(20 + (event_id * 7) % 580 AS INT) END AS completion_tokens",
    "CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 "
    "THEN CAST(40 + event_id % 380 + (event_id * 7) % 580 AS INT) END AS total_tokens",
    "CASE WHEN event_type = 'error' THEN CASE event_id % 6 "
    "WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'timeout' WHEN 2 THEN 'provider_error' "
    "WHEN 3 THEN 'connection' WHEN 4 THEN 'unknown' END END AS error_type",
    "CASE WHEN event_type = 'error' THEN 'made-up failure' END AS error_message",
    "props AS tags_json",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape_logs(events: DataFrame) -> DataFrame:
    """Log rows from rows of the events table, batch or stream."""
    return events.selectExpr(*LOG_COLUMNS_SQL).withColumn(
        "started_at", F.col("started_at").cast("timestamp")
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_logs(table(spark, sf_dir, "events"))


def shape_stored(logs: DataFrame) -> DataFrame:
    """Enriched log rows with the remaining listing columns."""
    finished = F.timestamp_micros(F.unix_micros("started_at") + F.col("latency_ms") * 1000)
    return enrich(logs).withColumns(
        {
            "total_tokens": F.col("total_tokens").cast("int"),
            "input_preview": F.concat(F.lit("question "), F.col("event_id").cast("string")),
            "output_preview": F.when(
                F.col("status") != "error", F.concat(F.lit("answer "), F.col("event_id").cast("string"))
            ),
            "pii_redaction_count": F.lit(0),
            "completed_at": finished,
            "processed_at": finished,
        }
    )


def stored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_stored(raw_logs(spark, sf_dir))


RAW_LOGS_SQL = f"raw AS (SELECT {', '.join(LOG_COLUMNS_SQL)} FROM events)"

# The price list once more, as SQL.
PRICES_SQL = """prices(p_model, input_rate, output_rate) AS (VALUES
  ('gpt-4.1', 2.0::DOUBLE, 8.0::DOUBLE), ('gpt-4.1-mini', 0.4, 1.6),
  ('gpt-4o-mini', 0.15, 0.6), ('claude-sonnet-4-5', 3.0, 15.0), ('mock-1', 0.0, 0.0))"""

LOGS_SQL = f"""{RAW_LOGS_SQL}, {PRICES_SQL}, logs AS (
  SELECT raw.* EXCLUDE (total_tokens),
    coalesce(total_tokens, prompt_tokens + completion_tokens)::INTEGER AS total_tokens,
    CASE WHEN completion_tokens > 0 AND latency_ms > 0
      THEN round(completion_tokens / (latency_ms / 1000.0::DOUBLE), 2) END AS tokens_per_second,
    round(prompt_tokens / 1000000.0::DOUBLE * input_rate
      + completion_tokens / 1000000.0::DOUBLE * output_rate, 6) AS estimated_cost_usd,
    'question ' || event_id AS input_preview,
    CASE WHEN status <> 'error' THEN 'answer ' || event_id END AS output_preview,
    0 AS pii_redaction_count,
    started_at + to_milliseconds(latency_ms) AS completed_at,
    started_at + to_milliseconds(latency_ms) AS processed_at
  FROM raw LEFT JOIN prices ON model = p_model)"""


# ------------------------------------------------------------------- events

_OPTIONAL = (
    "ttft_ms", "prompt_tokens", "completion_tokens", "total_tokens", "error_type", "error_message",
)


def _json(text):
    """A string column as JSON text."""
    return F.to_json(text.cast("variant"))


def shape_events(events: DataFrame, damaged: bool = False) -> DataFrame:
    """One JSON event per row, as a producer sends it.

    With ``damaged`` the remainder of the id by 50 decides what is unusual about
    an event; most remainders mean nothing is. 1 to 8, 14, 15, 18 to 21 and 23 to
    26 are invalid, 9 to 13 and 22 unusual but accepted, 16 and 17 lack or add a field.
    """
    logs = shape_logs(events)
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    m = F.col("event_id") % 50 if damaged else F.lit(0)
    latency = F.col("latency_ms").cast("string")
    shape = {
        "request_id": F.when(m == 5, F.lit("not-a-uuid"))
        .when(m == 13, F.concat(F.lit("{"), F.upper("request_id"), F.lit("}")))
        .otherwise(F.col("request_id")),
        "status": F.when(m == 2, F.upper("status")).otherwise(F.col("status")),
        "model": F.when(m == 8, F.repeat(F.lit("m"), 129))
        .when(m == 21, F.lit("a\u0000b"))
        .otherwise(F.col("model")),
        "input_preview": F.when(m == 18, F.repeat(F.lit("x"), 4001)).otherwise(
            F.concat(F.lit("mail user"), F.col("event_id").cast("string"), F.lit("@example.com"))
        ),
    }
    fields = [
        *[c.alias(n) for n, c in shape.items()],
        "conversation_id", "service", "provider",
        F.when(m == 12, F.lit(None).cast("string")).otherwise(iso).alias("started_at"),
        iso.alias("completed_at"),
        *_OPTIONAL,
        F.struct(F.lit("web").alias("channel")).alias("client_metadata"),
        F.lit("0.4.0").alias("sdk_version"),
    ]
    head = F.concat(
        F.when(m == 1, F.lit(""))
        .when(m == 3, F.lit('"latency_ms":-1,'))
        .when(m == 4, F.lit('"latency_ms":900.5,'))
        .when(m == 7, F.lit('"latency_ms":2147483648,'))
        .when(m == 9, F.concat(F.lit('"latency_ms":" '), latency, F.lit('",')))
        .when(m == 10, F.concat(F.lit('"latency_ms":'), latency, F.lit(".0,")))
        .when(m == 22, F.lit('"latency_ms":true,'))
        .otherwise(F.concat(F.lit('"latency_ms":'), latency, F.lit(","))),
        F.when(m == 11, F.when(F.col("streamed"), '"streamed":"Yes",').otherwise('"streamed":0,'))
        .otherwise(F.concat(F.lit('"streamed":'), F.col("streamed").cast("string"), F.lit(","))),
        F.when(m == 12, F.concat(F.lit('"started_at":'), F.unix_millis("started_at").cast("string"), F.lit(",")))
        .otherwise(F.lit("")),
        F.when(m == 14, F.lit('"tags":null,'))
        .when(m == 15, F.concat(F.lit('"tags":{"k":"'), F.repeat(F.lit("t"), 9000), F.lit('"},')))
        .otherwise(F.concat(F.lit('"tags":'), F.col("tags_json"), F.lit(","))),
        F.when(m == 16, F.lit("")).otherwise(F.lit('"schema_version":1,')),
        F.when(m == 17, F.lit('"x_new_field":{"a":1},')).otherwise(F.lit("")),
    )
    whole = F.concat(F.lit("{"), head, F.substring(F.to_json(F.struct(*fields)), 2, 1 << 30))
    value = (
        F.when(m == 6, F.substring(whole, F.lit(1), F.length(whole) - 1))
        .when(m == 19, F.concat(whole, F.lit(" trailing")))
        .when(m == 20, F.lit("[1]"))
        # What a lenient reader would take for the event in it.
        .when(m == 23, F.concat(whole, F.lit(',"x":1')))
        .when(m == 24, F.concat(F.lit('1,"event":'), whole))
        .when(m == 25, F.concat(F.lit('{"latency_ms":-1},"event":'), whole))
        .when(m == 26, F.translate(whole, '"', "'"))
        .otherwise(whole)
    )
    return logs.select("event_id", value.alias("value"))


def events_json(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"), damaged)


def envelopes(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """Batch documents: runs of 501 consecutive ids are in turn cut into batches
    of 25 and kept whole, which is one event too many. Per 1,000 ids there is
    also an empty batch."""
    events = events_json(spark, sf_dir, damaged)
    run = F.floor(F.col("event_id") / 501)
    batch = F.when(run % 2 == 1, F.format_string("large-%d", run)).otherwise(
        F.format_string("batch-%d-%d", run, F.floor(F.col("event_id") / 25))
    )
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    joined = F.array_join(F.transform(ordered, lambda e: e["value"]), ",")
    filled = events.groupBy(batch.alias("batch_id")).agg(
        F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("value")
    )
    block = F.floor(F.col("event_id") / 1000)
    empty = events.groupBy(F.format_string("empty-%d", block).alias("batch_id")).agg(
        F.lit('{"events":[]}').alias("value")
    )
    return filled.unionByName(empty)


BATCHES_SQL = """batched AS (
  SELECT event_id, CASE WHEN event_id // 501 % 2 = 1 THEN 'large-' || (event_id // 501)
    ELSE 'batch-' || (event_id // 501) || '-' || (event_id // 25) END AS batch_id
  FROM events)"""


# ------------------------------------------------------------- conversations


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per conversation of the given table."""
    c = F.col("conv_id")
    model = F.element_at(
        F.array(*[F.lit(x) for x in ("gpt-4o-mini", "gpt-4.1", "claude-sonnet-4-5", "mock-1", "retired-1")]),
        (c % 5 + 1).cast("int"),
    )
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.max("turn").alias("_last"),
            F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system_prompt"),
        )
        .select(
            F.format_string("00000000-0000-4000-a000-%012x", c).alias("id"),
            F.when(c % 3 != 0, F.concat(F.lit("Conversation "), c.cast("string"))).alias("title"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("openai", "openai", "anthropic", "mock", "openai")]),
                (c % 5 + 1).cast("int"),
            ).alias("provider"),
            model.alias("model"),
            "system_prompt",
            F.timestamp_seconds(F.lit(1704067200) + c * 60).alias("created_at"),
            F.timestamp_seconds(F.lit(1704067200) + c * 60 + F.col("_last")).alias("updated_at"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages; some assistant turns are errors or were cancelled."""
    c, t = F.col("conv_id"), F.col("turn")
    assistant = F.col("role") == "assistant"
    mix = (c * 7 + t) % 11
    return table(spark, sf_dir, "conversations").select(
        F.format_string("00000000-0000-4000-b000-%08x%04x", c, t).alias("id"),
        F.format_string("00000000-0000-4000-a000-%012x", c).alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.when(assistant & (mix == 0), "error")
        .when(assistant & (mix == 5), "cancelled")
        .otherwise("complete")
        .alias("status"),
        F.when(assistant, F.format_string("00000000-0000-4000-c000-%08x%04x", c, t)).alias("request_id"),
        F.when(assistant, (c % 90 + 10).cast("int")).alias("prompt_tokens"),
        F.when(assistant, (t * 5 + 1).cast("int")).alias("completion_tokens"),
        F.timestamp_seconds(F.lit(1704067200) + c * 60 + t).alias("created_at"),
    )


CONVERSATIONS_SQL = """conv AS (
  SELECT printf('00000000-0000-4000-a000-%012x', conv_id) AS id,
    CASE WHEN conv_id % 3 <> 0 THEN 'Conversation ' || conv_id END AS title,
    (['openai', 'openai', 'anthropic', 'mock', 'openai'])[(conv_id % 5 + 1)::INT] AS provider,
    (['gpt-4o-mini', 'gpt-4.1', 'claude-sonnet-4-5', 'mock-1', 'retired-1'])[(conv_id % 5 + 1)::INT] AS model,
    max(CASE WHEN role = 'system' THEN text END) AS system_prompt,
    make_timestamp((1704067200 + conv_id * 60) * 1000000) AS created_at,
    make_timestamp((1704067200 + conv_id * 60 + max(turn)) * 1000000) AS updated_at
  FROM conversations GROUP BY conv_id),
msg AS (
  SELECT printf('00000000-0000-4000-b000-%08x%04x', conv_id, turn) AS id,
    printf('00000000-0000-4000-a000-%012x', conv_id) AS conversation_id,
    role, text AS content,
    CASE WHEN role = 'assistant' AND (conv_id * 7 + turn) % 11 = 0 THEN 'error'
      WHEN role = 'assistant' AND (conv_id * 7 + turn) % 11 = 5 THEN 'cancelled'
      ELSE 'complete' END AS status,
    CASE WHEN role = 'assistant' THEN printf('00000000-0000-4000-c000-%08x%04x', conv_id, turn) END AS request_id,
    CASE WHEN role = 'assistant' THEN (conv_id % 90 + 10)::INTEGER END AS prompt_tokens,
    CASE WHEN role = 'assistant' THEN (turn * 5 + 1)::INTEGER END AS completion_tokens,
    make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS created_at,
    conv_id, turn
  FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Streamed pieces and end states of all assistant turns.

    A finished turn has all words and a last piece with the usage; an unfinished
    one has the first half of its words, or none when the id is divisible by 3.
    """
    spoken = messages(spark, sf_dir).filter(F.col("role") == "assistant")
    words = F.split("content", " ", -1)
    done = F.col("status") == "complete"
    none = F.conv(F.right("conversation_id", F.lit(12)), 16, 10).cast("long") % 3 == 0
    kept = F.when(done, F.size(words)).when(none, 0).otherwise(F.floor(F.size(words) / 2)).cast("int")
    pieces = F.transform(
        F.slice(words, F.lit(1), kept),
        lambda w, i: F.struct(
            i.cast("long").alias("seq"),
            F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)).alias("text"),
            F.lit(None).cast("struct<prompt_tokens:int,completion_tokens:int>").alias("usage"),
        ),
    )
    last = F.struct(
        F.size(words).cast("long").alias("seq"),
        F.lit("").alias("text"),
        F.struct("prompt_tokens", "completion_tokens").alias("usage"),
    )
    chunks = spoken.select(
        "request_id",
        F.inline(F.when(done, F.concat(pieces, F.array(last))).otherwise(pieces)),
    )
    ends = spoken.select(
        "request_id", "conversation_id",
        done.alias("ended"),
        F.when(F.col("status") == "error", F.lit("  model \n gave   up ")).alias("exception_message"),
        (F.col("created_at") + F.expr("INTERVAL 30 SECONDS")).alias("ended_at"),
    )
    return chunks, ends


TURNS_SQL = f"""{CONVERSATIONS_SQL},
turn AS (
  SELECT request_id, conversation_id, status AS outcome,
    created_at + INTERVAL 30 SECONDS AS ended_at,
    array_to_string(list_slice(string_split(content, ' '), 1,
      CASE WHEN status = 'complete' THEN len(string_split(content, ' '))
        WHEN conv_id % 3 = 0 THEN 0
        ELSE len(string_split(content, ' ')) // 2 END), ' ') AS text,
    CASE WHEN status = 'complete' THEN prompt_tokens END AS prompt_tokens,
    CASE WHEN status = 'complete' THEN completion_tokens END AS completion_tokens
  FROM msg WHERE role = 'assistant')"""


# ------------------------------------------------------------------ captures

CHUNK_BYTES = 17
_PIECE_MS = 10


def _capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation row as an exchange: assistant rows are model calls
    that answer the row before, the others are requests to a shop."""
    rows = table(spark, sf_dir, "conversations")
    before = rows.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked")
    )
    # Rows are few bytes for the work they make, so they are dealt out by count.
    rows = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    call = F.col("role") == "assistant"
    df = rows.join(before, ["conv_id", "turn"], "left").withColumns(
        {
            "request_id": F.format_string("00000000-0000-4000-c000-%08x%04x", c, t),
            "call": call,
            "vendor": F.when(call, c % 4),
            "streaming": (c + t) % 3 != 0,
            "raised": F.when(c % 13 == 5, "ReadTimeout").when(c % 13 == 6, "RateLimitError").when(c % 13 == 7, "ConnectError"),
            "code": F.when(c % 13 >= 5, F.when(c % 13 <= 7, None).otherwise(200)).otherwise(200),
            "mix": (c * 7 + t) % 11,
            "prompt": 10 + c % 50,
            "completion": t * 3 + 1,
            "started_at": F.timestamp_seconds(F.lit(1704067200) + c * 60 + t),
        }
    )
    http = F.when(c % 9 == 1, 429).when(c % 9 == 2, 503).when(c % 9 == 3, 401).when(c % 9 == 4, 404)
    df = df.withColumn(
        "code", F.when(F.col("code").isNotNull(), F.coalesce(http, F.col("code"))).cast("int")
    )
    fine = F.coalesce(F.col("code") == 200, F.lit(False))
    streamed = F.col("call") & F.col("streaming") & fine
    return df.withColumns(
        {
            "streamed_ok": streamed,
            "dropped": streamed & (F.col("mix") == 7),
            "half": streamed & F.col("mix").isin(5, 7),
            "ended": streamed & ~F.col("mix").isin(5, 6, 7),
        }
    )


def _body(df: DataFrame) -> DataFrame:
    """Add the text of a streamed reply in its vendor's format."""
    words = F.split("text", " ", -1)
    n_words = F.size(words)
    kept = F.when(F.col("half"), F.ceil(n_words / 2)).otherwise(n_words).cast("int")
    # Nothing in the lambda depends on the list, or every word would cut the text again.
    spoken = F.concat(
        F.transform(F.slice(words, F.lit(1), F.least(kept, n_words - 1)), lambda w: F.concat(w, F.lit(" "))),
        F.slice(words, n_words, F.greatest(kept - n_words + 1, F.lit(0))),
    )
    p, n = F.col("prompt").cast("string"), F.col("completion").cast("string")

    def lines(before: str, after: str):
        return F.array_join(
            F.transform(spoken, lambda w: F.concat(F.lit(before), _json(w), F.lit(after))), ""
        )

    def unless_half(text):
        return F.when(F.col("half"), F.lit("")).otherwise(text)

    openai = F.concat(
        lines('data: {"choices":[{"delta":{"content":', "}}]}\n\n"),
        unless_half(
            F.concat(
                F.lit('data: {"choices":[],"usage":{"prompt_tokens":'), p,
                F.lit(',"completion_tokens":'), n, F.lit(',"total_tokens":'),
                (F.col("prompt") + F.col("completion")).cast("string"),
                F.lit("}}\n\ndata: [DONE]\n\n"),
            )
        ),
    )
    anthropic = F.concat(
        F.lit('event: message_start\ndata: {"type":"message_start","message":{"usage":{"input_tokens":'), p,
        F.lit("}}}\n\n"),
        lines(
            'event: content_block_delta\ndata: {"type":"content_block_delta","delta":{"type":"text_delta","text":',
            "}}\n\n",
        ),
        unless_half(
            F.concat(
                F.lit('data: {"type":"message_delta","usage":{"output_tokens":'), n,
                F.lit('}}\n\ndata: {"type":"message_stop"}\n\n'),
            )
        ),
    )
    ollama = F.concat(
        lines('{"message":{"content":', '},"done":false}\n'),
        unless_half(
            F.concat(
                F.lit('{"done":true,"prompt_eval_count":'), p, F.lit(',"eval_count":'), n, F.lit("}\n")
            )
        ),
    )
    return df.withColumn(
        "body", F.when(F.col("vendor") == 1, anthropic).when(F.col("vendor") == 2, ollama).otherwise(openai)
    )


def _whole_response(df: DataFrame):
    text, p, n = _json(F.col("text")), F.col("prompt").cast("string"), F.col("completion").cast("string")
    openai = F.concat(
        F.lit('{"choices":[{"message":{"content":'), text, F.lit('}}],"usage":{"prompt_tokens":'), p,
        F.lit(',"completion_tokens":'), n, F.lit(',"total_tokens":'),
        (F.col("prompt") + F.col("completion")).cast("string"), F.lit("}}"),
    )
    anthropic = F.concat(
        F.lit('{"content":[{"type":"text","text":'), text,
        F.lit('},{"type":"tool_use"},{"type":"text","text":"!"}],"usage":{"input_tokens":'), p,
        F.lit(',"output_tokens":'), n, F.lit("}}"),
    )
    ollama = F.concat(
        F.lit('{"message":{"content":'), text, F.lit('},"done":true,"prompt_eval_count":'), p,
        F.lit(',"eval_count":'), n, F.lit("}"),
    )
    c = F.col("conv_id")
    return (
        F.when(~F.col("call"), F.lit('{"ok":true}'))
        .when(F.col("code").isNull() | F.col("streamed_ok"), F.lit(None).cast("string"))
        .when(F.col("code") == 404, F.lit(""))
        .when(F.col("code") >= 400, F.concat(F.lit("refused, write to ops"), c.cast("string"), F.lit("@example.com")))
        .when(c % 17 == 8, F.lit("oops{"))
        .when(F.col("vendor") == 1, anthropic)
        .when(F.col("vendor") == 2, ollama)
        .otherwise(openai)
    )


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored exchanges and the chunks of streamed replies."""
    df = _capture_rows(spark, sf_dir)
    asked = _json(F.coalesce("asked", F.lit("")))
    parts = F.concat(
        F.lit('[{"type":"text","text":'), asked, F.lit('},{"type":"image_url"},{"text":"end"}]')
    )
    request = F.concat(
        F.lit('{"model":"model-'), F.col("vendor").cast("string"),
        F.lit('","messages":[{"role":"system","content":"be brief"},{"role":"user","content":'),
        F.when(F.col("conv_id") % 2 == 0, asked).otherwise(parts),
        F.lit('},{"role":"assistant","content":"go on"}]'),
        F.when(F.col("streaming"), F.lit(',"stream":true}'))
        .when(F.col("vendor") == 2, F.lit(',"stream":false}'))
        .otherwise(F.lit("}")),
    )
    size = F.octet_length("body")
    pieces = F.greatest(F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("long")
    bodies = _body(df)
    url = (
        F.when(F.col("vendor") == 0, "https://api.openai.com/v1/chat/completions")
        .when(F.col("vendor") == 1, "https://api.anthropic.com/v1/messages")
        .when(F.col("vendor") == 2, "http://localhost:11434/api/chat")
        .when(F.col("vendor") == 3, "http://my-vllm:8000/v1/chat/completions")
        .otherwise("https://example.com/api/orders")
    )
    took = F.when(F.col("streamed_ok"), pieces * _PIECE_MS + 5).otherwise(F.lit(250))
    exchanges = bodies.select(
        "request_id",
        F.lit("POST").alias("method"),
        url.alias("url"),
        F.when(F.col("call"), request)
        .otherwise(F.concat(F.lit('{"item":'), F.col("turn").cast("string"), F.lit("}")))
        .alias("request_body"),
        F.col("code").alias("status_code"),
        _whole_response(df).alias("response_body"),
        F.when(F.col("dropped"), F.lit("RemoteProtocolError")).when(F.col("call") & F.col("code").isNull(), F.col("raised")).alias("exception_class"),
        F.when(F.col("dropped") | (F.col("call") & F.col("code").isNull()), F.lit("peer 10.0.0.5 closed the line")).alias("exception_message"),
        F.col("ended").alias("stream_ended"),
        "started_at",
        F.timestamp_micros(F.unix_micros("started_at") + took * 1000).alias("ended_at"),
        F.from_json(
            F.concat(F.lit('{"conversation_id":"'), F.format_string("00000000-0000-4000-a000-%012x", "conv_id"), F.lit('","user_id":7}')),
            "map<string,variant>",
        ).alias("tags"),
    )
    # Encoded before there are pieces, or every piece would encode the whole body again.
    sent = bodies.filter("streamed_ok").select("request_id", "started_at", F.encode("body", "UTF-8").alias("body"), pieces.alias("pieces"))
    cut = sent.select("request_id", "started_at", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("seq"))
    chunks = cut.select(
        "request_id", "seq",
        F.timestamp_micros(F.unix_micros("started_at") + (F.col("seq") + 1) * _PIECE_MS * 1000).alias("at"),
        F.substring("body", F.col("seq").cast("int") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("bytes"),
    )
    return exchanges, chunks


# What the exchanges mean, told from the source columns without any parsing.
CAPTURES_SQL = """cap0 AS (
  SELECT c.conv_id, c.turn, c.role, c.text, b.text AS asked,
    printf('00000000-0000-4000-c000-%08x%04x', c.conv_id, c.turn) AS request_id,
    printf('00000000-0000-4000-a000-%012x', c.conv_id) AS conversation_id,
    c.role = 'assistant' AS call,
    CASE WHEN c.role = 'assistant' THEN
      (['openai', 'anthropic', 'ollama', 'openai_compatible'])[(c.conv_id % 4 + 1)::INT] END AS provider,
    (c.conv_id + c.turn) % 3 <> 0 AS streaming,
    CASE c.conv_id % 13 WHEN 5 THEN 'ReadTimeout' WHEN 6 THEN 'RateLimitError' WHEN 7 THEN 'ConnectError' END AS raised,
    CASE WHEN c.conv_id % 13 BETWEEN 5 AND 7 THEN NULL
      ELSE CASE c.conv_id % 9 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 404 ELSE 200 END END AS code,
    (c.conv_id * 7 + c.turn) % 11 AS mix,
    10 + c.conv_id % 50 AS prompt, c.turn * 3 + 1 AS completion,
    make_timestamp((1704067200 + c.conv_id * 60 + c.turn) * 1000000) AS started_at,
    string_split(c.text, ' ') AS words
  FROM conversations c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn),
cap1 AS (
  SELECT *, coalesce(code = 200, false) AND streaming AND call AS live,
    coalesce(code = 200, false) AND streaming AND call AND mix IN (5, 7) AS half,
    CASE WHEN conv_id % 2 = 0 THEN coalesce(asked, '') ELSE trim(coalesce(asked, '') || ' end') END AS input_text
  FROM cap0 WHERE call),
cap2 AS (
  SELECT *,
    CASE WHEN live AND half THEN array_to_string(list_slice(words, 1, ceil(len(words) / 2.0)::INT), ' ')
        || CASE WHEN len(words) > 1 THEN ' ' ELSE '' END
      WHEN live THEN text
      WHEN code IS NULL OR code >= 400 OR conv_id % 17 = 8 THEN NULL
      WHEN provider = 'anthropic' THEN text || '!' ELSE text END AS output_text,
    CASE WHEN code IS NULL OR code >= 400 OR (NOT live AND conv_id % 17 = 8) THEN NULL
      WHEN half AND provider <> 'anthropic' THEN NULL ELSE prompt END AS prompt_tokens,
    CASE WHEN code IS NULL OR code >= 400 OR (NOT live AND conv_id % 17 = 8) OR half THEN NULL
      ELSE completion END AS completion_tokens,
    CASE WHEN code IS NULL OR code >= 400 THEN 'error'
      WHEN NOT live THEN 'success' WHEN mix = 7 THEN 'error' WHEN mix = 5 THEN 'cancelled' ELSE 'success' END AS status,
    CASE WHEN live THEN strlen(CASE provider
      WHEN 'anthropic' THEN 'event: message_start' || chr(10)
        || 'data: {"type":"message_start","message":{"usage":{"input_tokens":' || prompt || '}}}' || chr(10) || chr(10)
        || 'event: content_block_delta' || chr(10)
        || 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":'
        || to_json(words[1] || CASE WHEN len(words) > 1 THEN ' ' ELSE '' END) || '}}' || chr(10)
      WHEN 'ollama' THEN '{"message":{"content":' || to_json(words[1] || CASE WHEN len(words) > 1 THEN ' ' ELSE '' END) || '},"done":false}' || chr(10)
      ELSE 'data: {"choices":[{"delta":{"content":' || to_json(words[1] || CASE WHEN len(words) > 1 THEN ' ' ELSE '' END) || '}}]}' || chr(10) END) END AS first_bytes,
    CASE WHEN code IS NULL THEN CASE raised WHEN 'ReadTimeout' THEN 'timeout' WHEN 'RateLimitError' THEN 'rate_limit' ELSE 'connection' END
      WHEN code = 429 THEN 'rate_limit' WHEN code = 503 THEN 'provider_error' WHEN code = 401 THEN 'auth'
      WHEN code = 404 THEN 'invalid_request' WHEN live AND mix = 7 THEN 'provider_error' END AS error_type,
    CASE WHEN code IS NULL OR (live AND mix = 7) THEN 'peer 10.0.0.5 closed the line'
      WHEN code = 404 THEN 'HTTP 404'
      WHEN code >= 400 THEN 'refused, write to ops' || conv_id || '@example.com' END AS error_message
  FROM cap1),
cap AS (
  SELECT *, prompt_tokens + completion_tokens AS total_tokens,
    (10 * ceil(first_bytes / 17.0))::BIGINT AS ttft_ms FROM cap2)"""
