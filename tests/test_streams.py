"""Streamed replies by lines against plain Python."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tokenledger import schemas
from tokenledger.operators import capture as X
from tokenledger.operators import streams as S
from tokenledger.plans import inputs as I
from tokenledger.session import written

START = datetime(2024, 1, 1)


def _chunks(spark, bodies, cut):
    rows = []
    for rid, body in bodies.items():
        at, n = 0, 0
        while at < len(body):
            size = cut()
            rows.append((rid, n, START + timedelta(milliseconds=n), bytearray(body[at : at + size])))
            at, n = at + size, n + 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schemas.CAPTURE_CHUNKS)


def test_lines_of_any_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHUNKS", 4)
    r = random.Random(2)
    bodies = {f"r{i}": "".join(r.choices(["\n", "a", "é", "\r\n", " ", "😀", "x" * 9], k=r.randrange(0, 120))).encode() for i in range(40)}
    bodies |= {None: b"null key\nx\n", "none": b"no line end", "ends": b"\n\n\n", "hot": b"line of text\n" * 3000}
    got: dict = {}
    for row in S.stream_lines(_chunks(spark, bodies, lambda: r.choice([1, 1, 2, 5, 40]))).collect():
        got.setdefault(row.request_id, []).append((row.seq, row["index"], row.line))
    for rid, body in bodies.items():
        want = body.decode("latin-1").split("\n")[:-1]
        assert [l for *_, l in sorted(got.get(rid, []))] == want, rid
    assert S.stream_lines(_chunks(spark, {}, lambda: 1)).count() == 0


def test_previews_equal_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHUNKS", 3)
    r = random.Random(3)
    texts = {f"t{i}": ["".join(r.choices([" ", "\n", "a", "é😀", "\x1c", "word"], weights=[6, 2, 1, 1, 1, 1], k=r.randrange(0, 5))) for _ in range(r.randrange(0, 30))] for i in range(300)}
    texts |= {"blank": [" "] * 20, "late": [" "] * 20 + ["x"] + [" "] * 20, "far": ["a"] + [" "] * 20 + ["b"], "none": [""]}
    frame = spark.createDataFrame([(k, i, 0, t) for k, v in texts.items() for i, t in enumerate(v)], "k string, seq long, index int, text string")
    whole = {x.k: x.whole for x in S.whole_text(frame, ["k"]).collect()}
    seen = {x.k: x.preview for x in S.text_preview(frame, ["k"], 7).collect()}
    for k, v in texts.items():
        said = "".join(v)
        assert whole.get(k, "") == said and seen.get(k) == (said.strip()[:7] or None), k


def test_counters_in_odd_orders(spark):
    def line(**doc):
        return f"data: {json.dumps(doc)}\n"

    start, delta = (lambda n: line(type="message_start", message={"usage": {"input_tokens": n}})), (lambda n: line(type="message_delta", usage={"output_tokens": n}))
    bodies = {
        "late start": delta(3) + start(5), "two": start(5) + delta(1) + delta(3) + start(9), "again": start(5) + delta(1) + start(9) + delta(2), "none": start(5), "text": "data: x\n"}
    asked = spark.createDataFrame([(k, "anthropic") for k in bodies] + [("silent", "anthropic")], "request_id string, provider string")
    got = {r.request_id: (r.prompt_tokens, r.completion_tokens, r.total_tokens) for r in X.fold_streams(asked, _chunks(spark, {k: v.encode() for k, v in bodies.items()}, lambda: 7)).collect()}
    assert got == {"late start": (5, 3, None), "two": (9, 3, 8), "again": (9, 2, 11), "none": (5, None, None), "text": (None, None, None), "silent": (None, None, None)}


def test_one_reply_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHUNKS", 256)
    body = b"".join(b'data: {"choices":[{"delta":{"content":"w%d "}}]}\n\n' % i for i in range(30_000)) + b"data: [DONE]\n\n"
    chunks = _chunks(spark, {"hot": body}, lambda: 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in S.stream_lines(chunks).groupBy(F.spark_partition_id()).count().collect()) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    asked = spark.createDataFrame([("hot", "openai")], "request_id string, provider string")
    row = X.fold_streams(asked, chunks).first()
    text = "".join(f"w{i} " for i in range(30_000))
    assert row.output_text == text and row.output_preview == text.strip()[:280] and row.completed


def test_chunks_are_dealt_out_by_count(spark):
    chunks = _chunks(spark, {f"r{i}": b"data: x\n" * 40 for i in range(200)}, lambda: 9)
    # Few bytes when compressed, which would all be merged into one task for each branch.
    assert S.stream_lines(chunks).select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_bodies_larger_than_a_variant(spark):
    pad = "y" * (1 << 20)
    body = F.concat(
        F.lit('{"model":"m","stream":false,"pad":"'), F.repeat(F.lit(pad), 60), F.lit('","messages":[{"role":"system","content":"'), F.repeat(F.lit(pad), 80),
        F.lit('"},{"role":"user","content":"asked"}]}'))
    reply = F.concat(
        F.lit('{"choices":[{"message":{"content":"said"}}],"log":"'), F.repeat(F.lit(pad), 140), F.lit('","usage":{"prompt_tokens":4,"completion_tokens":2,"total_tokens":6}}'))
    frame = spark.range(1).select(F.lit("openai").alias("provider"), body.alias("request_body"), reply.alias("response_body"))
    row = X.parse_responses(X.parse_requests(frame).drop("request_body")).drop("response_body").first()
    assert (row.model, row.streaming, row.input_text, row.output_text, row.total_tokens) == ("m", False, "asked", "said", 6)


def test_fields_of_other_kinds_do_not_hide_the_rest(spark):
    rows = [('{"model":5,"messages":7,"stream":"yes"}', "5", True, None), ('{"messages":{"role":"user"}}', "unknown", False, None), (" {} ", "unknown", False, None),
            ("[]", "unknown", False, None), ("null", "unknown", False, None), ("not json", "unknown", False, None), (None, "unknown", False, None),
            ('{"model":null,"messages":["x",{"role":"user","content":"c"}]}', "None", False, "c")]
    frame = spark.createDataFrame([(i, "openai", r[0]) for i, r in enumerate(rows)] + [(99, "openai", "[1]"), (98, "openai", '"text"')], "id int, provider string, request_body string")
    got = {r.id: (r.model, r.streaming, r.input_text) for r in X.parse_requests(frame).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 50)
    r = random.Random(4)
    bodies = {f"r{i}": "".join(r.choices(["\n", "é", "x" * 30, "y"], k=60)).encode() for i in range(20)} | {"large": b"z" * 500 + b"\n"}
    chunks = _chunks(spark, bodies, lambda: r.choice([1, 7, 20]))
    assert S.chunk_blocks(chunks).filter(F.length("_text") >= 50 + 20).count() == 0
    got: dict = {}
    for row in S.stream_lines(chunks).collect():
        got.setdefault(row.request_id, []).append((row.seq, row["index"], row.line))
    for rid, body in bodies.items():
        assert [l for *_, l in sorted(got.get(rid, []))] == body.decode("latin-1").split("\n")[:-1], rid


def test_lines_are_cut_once_and_only_what_is_said_is_written(spark, monkeypatch):
    body = b"".join(b'event: x\r\ndata: {"choices":[{"delta":{"content":"w%d "}}]}\r\n\r\n' % i for i in range(50))
    chunks = _chunks(spark, {"a": body, "mute": b"\n\nevent: x\ndata: 5\n\n", "open": b"data: 1"}, lambda: 9)
    frames = []
    monkeypatch.setattr(X, "written", lambda frame, name: frames.append(frame) or written(frame, name))
    asked = spark.createDataFrame([(k, "openai") for k in ("a", "mute", "open", "none")], "request_id string, provider string")
    got = {r.request_id: (r.completed, r.output_text) for r in X.fold_streams(asked, chunks).collect()}
    assert got == {"a": (False, "".join(f"w{i} " for i in range(50))), "mute": (False, None), "open": (None, None), "none": (None, None)}
    lines = frames[0]
    # Lines with text, and the first and last pieces of three replies, one of which has no newline.
    assert lines.filter(F.col("_piece").isNull()).count() == 50 and lines.filter(F.col("_piece").isNotNull()).count() == 5
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "Union" not in plan


def test_a_body_is_cut_into_words_once_and_encoded_once(spark, tmp_path):
    texts = ["one", "", "two  words ", "é 😀 \n x", None]
    rows = [(c, 1, "assistant", t) for c in range(40) for t in [texts[c % 5]]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    chunks = I.captures(spark, str(tmp_path))[1]
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    lambdas = re.findall(r"lambdafunction\((.*?), lambda [wx]_", plan)
    assert lambdas and not any("split(" in x for x in lambdas)
    assert "encode(" not in plan[: plan.index("Generate explode")]
    bodies: dict = {}
    for r in chunks.collect():
        bodies.setdefault(r.request_id, {})[r.seq] = r.bytes
    for rid, cut in bodies.items():
        conv = int(rid[24:32], 16)
        if texts[conv % 5] is None:
            assert cut == {0: None}
            continue
        body = b"".join(bytes(cut[i]) for i in range(len(cut)))
        words = texts[conv % 5].split(" ")
        half = (conv * 7 + 1) % 11 in (5, 7)
        said = [w if i == len(words) - 1 else w + " " for i, w in enumerate(words)][: -(-len(words) // 2) if half else None]
        lines = [x.removeprefix(b"data: ") for x in body.split(b"\n") if b'"content"' in x or b'"text_delta"' in x]
        docs = [json.loads(x) for x in lines]
        got = [d["choices"][0]["delta"]["content"] if "choices" in d else d["message"]["content"] if "message" in d else d["delta"]["text"] for d in docs]
        assert got == said, rid
