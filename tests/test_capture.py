from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenledger import schemas
from tokenledger.operators import capture as X

START = datetime(2024, 1, 1)
OPENAI = "https://api.openai.com/v1/chat/completions"
ANTHROPIC = "https://api.anthropic.com/v1/messages"
OLLAMA = "http://localhost:11434/api/chat"


def _chat(text="hi", **more):
    return json.dumps({"model": "m", "messages": [{"role": "user", "content": text}], **more})


def _row(rid, url=OPENAI, body=None, code=200, reply=None, exc=None, ended=True, method="POST"):
    return (rid, method, url, _chat() if body is None else body, code, reply, exc, "boom" if exc else None,
            ended, START, START + timedelta(milliseconds=900), None)


def _events(spark, rows, bodies=None, handlers=X.DEFAULT_HANDLERS, piece=5):
    chunks = [
        (rid, i // piece, START + timedelta(milliseconds=10 * (i // piece + 1)), bytearray(body[i:i + piece]))
        for rid, body in (bodies or {}).items()
        for i in range(0, len(body), piece)
    ]
    captures = spark.createDataFrame(rows, schemas.CAPTURES)
    frame = spark.createDataFrame(chunks, schemas.CAPTURE_CHUNKS)
    return {r.request_id: r for r in X.capture_events(captures, frame, handlers=handlers).collect()}


def test_whole_replies(spark):
    openai = json.dumps({"choices": [{"message": {"content": "ok"}}], "usage": {"prompt_tokens": 6, "completion_tokens": 2, "total_tokens": 8}})
    anthropic = json.dumps({"content": [{"type": "text", "text": "Good "}, {"type": "text", "text": "day"}], "usage": {"input_tokens": 31, "output_tokens": 6}})
    ollama = json.dumps({"response": "eleven geese", "prompt_eval_count": 21, "eval_count": 9})
    got = _events(spark, [
        _row("o", body=_chat("write to kim@shop.test"), reply=openai),
        _row("a", ANTHROPIC, reply=anthropic),
        _row("l", "http://h/api/generate", json.dumps({"model": "small-1", "prompt": "once", "stream": False}), reply=ollama),
        _row("v", "http://my-vllm:8000/v1/chat/completions", reply=openai),
        _row("n", "https://example.com/api/orders"), _row("g", method="GET"), _row("x", body="[1]"),
        _row("u", reply="not json"), _row("e", code=429, reply='{"error": "slow"}'), _row("h", code=500, reply=""),
        _row("c", code=None, exc="ConnectTimeout"),
    ])
    assert set(got) == {"o", "a", "l", "v", "u", "e", "h", "c"}
    assert (got["o"].provider, got["o"].input_preview, got["o"].pii_redaction_count, got["o"].total_tokens) == ("openai", "write to [REDACTED_EMAIL]", 1, 8)
    assert (got["a"].output_preview, got["a"].total_tokens, got["a"].streamed) == ("Good day", 37, False)
    assert (got["l"].input_preview, got["l"].output_preview, got["l"].total_tokens) == ("once", "eleven geese", 30)
    assert got["v"].provider == "openai_compatible"
    assert (got["u"].status, got["u"].output_preview, got["u"].prompt_tokens) == ("success", None, None)
    assert (got["e"].error_type, got["e"].error_message) == ("rate_limit", '{"error": "slow"}')
    assert (got["h"].error_type, got["h"].error_message) == ("provider_error", "HTTP 500")
    assert (got["c"].status, got["c"].error_type, got["c"].latency_ms) == ("error", "timeout", 900)


def _sse(*docs, done=True):
    lines = [b"data: " + json.dumps(d, ensure_ascii=False).encode() + b"\n\n" for d in docs]
    return b"".join(lines) + (b"data: [DONE]\n\n" if done else b"")


def _delta(text):
    return {"choices": [{"delta": {"content": text}}]}


def test_streams(spark):
    usage = {"choices": [], "usage": {"prompt_tokens": 8, "completion_tokens": 3, "total_tokens": 11}}
    stream = _chat(stream=True)
    anthropic = b"".join(
        f"event: {e['type']}\r\ndata: {json.dumps(e)}\r\n\r\n".encode()
        for e in [
            {"type": "message_start", "message": {"usage": {"input_tokens": 14}}},
            {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Sure"}},
            {"type": "content_block_delta", "delta": {"type": "text_delta", "text": ", done"}},
            {"type": "message_delta", "usage": {"output_tokens": 5}},
            {"type": "message_stop"},
        ]
    )
    ollama = b"".join(json.dumps(d).encode() + b"\n" for d in [
        {"message": {"content": "Two "}}, {"response": "parts"}, {"done": True, "prompt_eval_count": 17, "eval_count": 2}])
    bodies = {
        "full": _sse(_delta(""), _delta("Grüße 😀"), _delta(" x"), usage),
        "left": _sse(_delta("a"), usage), "cut": _sse(_delta("part"), done=False) + b'data: {"choices":[{"delta":{"content":"lost"}}]}',
        "raised": _sse(_delta("part"), done=False), "anth": anthropic, "olla": ollama,
    }
    got = _events(spark, [
        _row("full", body=stream), _row("left", body=stream, ended=False), _row("cut", body=stream, ended=False),
        _row("raised", body=stream, exc="RemoteProtocolError", ended=False),
        _row("anth", ANTHROPIC, stream), _row("olla", OLLAMA, _chat()), _row("silent", body=stream),
    ], bodies)
    assert {k: r.status for k, r in got.items()} == {
        "full": "success", "left": "success", "cut": "cancelled", "raised": "error", "anth": "success", "olla": "success", "silent": "success"}
    assert (got["full"].output_preview, got["full"].total_tokens) == ("Grüße 😀 x", 11)
    first = len(_sse(_delta(""), done=False)) + len(_sse(_delta("Grüße 😀"), done=False)) - 1
    assert got["full"].ttft_ms == 10 * -(-first // 5)
    assert got["cut"].output_preview == "part"
    assert (got["raised"].error_type, got["raised"].error_message) == ("provider_error", "boom")
    assert (got["anth"].output_preview, got["anth"].total_tokens) == ("Sure, done", 19)
    assert (got["olla"].output_preview, got["olla"].total_tokens, got["olla"].streamed) == ("Two parts", 19, True)
    assert (got["silent"].ttft_ms, got["silent"].output_preview) == (None, None)


def test_cancelled_calls(spark):
    stream = _chat(stream=True)
    bodies = {"done": _sse(_delta("whole")), "gone": _sse(_delta("half"), done=False), "late": _sse(_delta("half"), done=False)}
    got = _events(spark, [
        _row("done", body=stream, exc="GeneratorExit", ended=False), _row("gone", body=stream, exc="GeneratorExit", ended=False),
        _row("late", body=stream, exc="CancelledError", ended=False), _row("none", code=None, exc="CancelledError"), _row("fail", code=None, exc="ReadError"),
    ], bodies)
    assert {k: (r.status, r.error_type) for k, r in got.items()} == {
        "done": ("success", None), "gone": ("cancelled", None), "late": ("cancelled", None), "fail": ("error", got["fail"].error_type)}
    assert got["fail"].error_type is not None


def test_custom_handler_comes_first(spark):
    shop = X.Handler(
        "shop", lambda host, path: host == "models.shop.test",
        lambda body: {"model": F.lit("a"), "streaming": F.lit(False), "input_text": F.try_variant_get(body, "$.prompt", "string")},
        lambda body: {"output_text": F.try_variant_get(body, "$.completion", "string"), **{
            n: F.lit(1).cast("long") for n in ("prompt_tokens", "completion_tokens", "total_tokens")}},
    )
    rows = [_row("a", "https://Models.shop.test/v1/chat/completions", '{"prompt": "p"}', reply='{"completion": "c"}')]
    got = _events(spark, rows, handlers=X.add_handler(shop))
    assert (got["a"].provider, got["a"].input_preview, got["a"].output_preview) == ("shop", "p", "c")


@pytest.mark.parametrize("content,want", [
    ("plain", "plain"), ([{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}], "a b"), ([], None), (5, None), ([{"type": None, "text": None}], "None")])
def test_last_user_text(spark, content, want):
    body = json.dumps([{"role": "user", "content": "old"}, {"role": "user", "content": content}, {"role": "assistant", "content": "x"}])
    df = spark.createDataFrame([(body,)], "b string").select(F.parse_json("b").cast("array<variant>").alias("m"))
    assert df.select(X.last_user_text(F.col("m")).alias("t")).first().t == want
