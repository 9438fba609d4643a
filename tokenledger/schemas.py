"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per model call.
INFERENCE_LOGS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("streamed", T.BooleanType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("ttft_ms", T.IntegerType()),
        T.StructField("prompt_tokens", T.IntegerType()),
        T.StructField("completion_tokens", T.IntegerType()),
        T.StructField("total_tokens", T.IntegerType()),
        T.StructField("tokens_per_second", T.DoubleType()),
        T.StructField("estimated_cost_usd", T.DoubleType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("input_preview", T.StringType()),
        T.StructField("output_preview", T.StringType()),
        T.StructField("pii_redaction_count", T.IntegerType()),
        T.StructField("sdk_version", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("client_metadata", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)
LOG_COLUMNS = [f.name for f in INFERENCE_LOGS.fields if f.name != "processed_at"]

# As stored: the layout adds two partition columns.
STORED_LOGS = T.StructType(
    INFERENCE_LOGS.fields
    + [
        T.StructField("batch_id", T.LongType()),
        T.StructField("started_date", T.DateType()),
    ]
)

DEAD_LETTERS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

CONVERSATIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("system_prompt", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("prompt_tokens", T.IntegerType()),
        T.StructField("completion_tokens", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# A stored HTTP exchange with a model provider, and the body pieces of a
# streamed reply.
CAPTURES = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("request_body", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("response_body", T.StringType()),
        T.StructField("exception_class", T.StringType()),
        T.StructField("exception_message", T.StringType()),
        T.StructField("stream_ended", T.BooleanType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("tags", T.MapType(T.StringType(), T.VariantType())),
    ]
)

CAPTURE_CHUNKS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("bytes", T.BinaryType()),
    ]
)

ROLES = ("system", "user", "assistant")
LOG_STATUSES = ("success", "error", "cancelled")
