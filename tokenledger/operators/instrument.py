"""Run a user's model function over a table of requests and log every call."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import call_error
from ..functions.redact import Redactor, redact_columns
from ..functions.text import preview
from .capture import ERROR_CHARS, SDK_VERSION, conversation_of

_OUTCOME = (
    "status string, streamed boolean, started_at timestamp, completed_at timestamp, "
    "latency_ms long, ttft_ms long, output_text string, prompt_tokens long, "
    "completion_tokens long, total_tokens long, error_class string, error_text string"
)
_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def _call(fn: Callable[[dict], object], request: dict) -> dict:
    """One call. A reply is ``(text, usage dict)``, or an iterator of such pairs
    for a streamed one. Exceptions end up in the returned row."""
    clock = time.monotonic()
    row = {
        "status": "success", "streamed": False, "started_at": datetime.now(timezone.utc),
        "ttft_ms": None, "error_class": None, "error_text": None,
    }
    texts: list[str] = []
    usage: dict = {}
    try:
        reply = fn(request)
        if isinstance(reply, tuple):
            texts.append(reply[0] or "")
            usage = reply[1] or {}
        else:
            row["streamed"] = True
            for text, counted in reply:
                if text:
                    if row["ttft_ms"] is None:
                        row["ttft_ms"] = int((time.monotonic() - clock) * 1000)
                    texts.append(text)
                usage = counted or usage
    except GeneratorExit:
        row["status"] = "cancelled"
    except Exception as exc:
        row.update(status="error", error_class=type(exc).__name__, error_text=str(exc))
    row["latency_ms"] = int((time.monotonic() - clock) * 1000)
    row["completed_at"] = datetime.now(timezone.utc)
    row["output_text"] = "".join(texts)
    row.update({n: usage.get(n) for n in _USAGE})
    return row


def instrument_calls(
    requests: DataFrame,
    fn: Callable[[dict], object],
    service: str,
    redactor: Redactor = Redactor(),
) -> DataFrame:
    """Call ``fn`` for every request and return one inference event per call.

    ``requests`` has ``request_id``, ``conversation_id``, ``provider``,
    ``model``, ``messages`` (role and content), ``tags`` and ``metadata`` (both
    map<string,variant>). Only the call itself runs in Python; labels, previews
    and redaction are Spark expressions. A call is made again when its task is
    run again.
    """
    plain = ["request_id", "conversation_id", "provider", "model", "messages"]
    given = requests.select(*plain, F.to_json("tags").alias("tags"), F.to_json("metadata").alias("metadata"))
    names = [c.split()[0] for c in _OUTCOME.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + ", " + _OUTCOME

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_call(fn, r) for r in frame[plain].to_dict("records")]
            outcome = pd.DataFrame(rows, columns=names, index=frame.index)
            for c in (*_USAGE, "ttft_ms"):
                outcome[c] = outcome[c].astype("Int64")
            yield pd.concat([frame, outcome], axis=1)

    called = given.mapInPandas(run, schema)
    tags = F.from_json("tags", "map<string,variant>")
    users = F.filter("messages", lambda m: m["role"] == "user")
    failed: Column = F.col("error_class").isNotNull()
    events = called.select(
        "request_id",
        F.lit(service).alias("service"),
        "provider", "model", "status", "streamed", "started_at", "completed_at", "latency_ms",
        conversation_of(tags, F.col("conversation_id")).alias("conversation_id"),
        "ttft_ms",
        *_USAGE,
        preview(F.try_element_at(users, F.lit(-1))["content"]).alias("input_preview"),
        preview(F.col("output_text")).alias("output_preview"),
        call_error(F.col("error_class")).alias("error_type"),
        F.when(failed, F.substring("error_text", 1, ERROR_CHARS)).alias("error_message"),
        F.lit(0).alias("pii_redaction_count"),
        tags.alias("tags"),
        F.from_json("metadata", "map<string,variant>").alias("client_metadata"),
        F.lit(SDK_VERSION).alias("sdk_version"),
        F.lit(1).alias("schema_version"),
    )
    return redact_columns(
        events, ["input_preview", "output_preview", "error_message"], redactor=redactor
    )
