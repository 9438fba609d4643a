from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tokenledger.operators.process import check
from tokenledger.operators.validate import valid_content, validate
from tokenledger.sources import bronze as B

INTS = [("900", 900), (" 900 ", 900), ("900.0", 900), ("900.", None), ("1_000", 1000), ("+5", 5), ("-0", 0),
        ("0x10", None), ("1e3", None), ("", None), (900.0, 900), (900.5, None), (True, 1), (1e30, None),
        ("1__0", None), ("007", 7), (None, None), ([1], None), ({}, None)]
BOOLS = [(1, True), (0, False), (2, None), (1.0, True), (0.5, None), ("yes", True), ("Yes", True), ("ON", True),
         ("t", True), ("x", None), (" true", None), ("", None), (None, None), ("1", True)]
U = "00000000-0000-4000-8000-00000000000a"
UUIDS = [(U.upper(), U), ("{" + U + "}", U), ("urn:uuid:" + U, U), (U.replace("-", ""), U),
         ("{" + U.replace("-", "") + "}", None), ("urn:uuid:" + U.replace("-", ""), None), ("URN:UUID:" + U, None),
         (" " + U, None), (5, None), ("0000000000-00-4000-8000-00000000000a", None)]
TEN = datetime(2024, 1, 1, 10)
TIMES = [("2024-01-01", datetime(2024, 1, 1)), ("2024-01-01T10:00", TEN), ("2024-01-01 10:00:00", TEN),
         ("2024-01-01t10:00:00z", TEN), ("2024-01-01_10:00:00Z", TEN), ("2024-01-01T10:00:00,5Z", TEN.replace(microsecond=500000)),
         ("2024-01-01T10:00:00.1234567Z", TEN.replace(microsecond=123456)),
         ("2024-01-01T15:30:00+0530", TEN), ("2024-01-01T15:30:00+05:30", TEN), ("2024-01-01T10:00:00+05", None),
         ("2024-01-01T10:00:00 Z", None), ("1704103200", TEN), (1704103200, TEN), (1704103200000, TEN),
         ("1704103200000", TEN), (1704103200.25, TEN.replace(microsecond=250000)), (True, None), ("2024-02-30", None),
         ("2024-01-01T24:00:00", None), ("2024-01-01T10", None), ("2024-01-01T10:00:60", None), ("1e5", None),
         ("+1704103200", TEN), (None, None)]


@pytest.mark.parametrize(
    "field,cases",
    [("latency_ms", INTS), ("streamed", BOOLS), ("request_id", UUIDS), ("started_at", TIMES)],
)
def test_lax_types(spark, event, field, cases):
    rows = [(i, event(**{field: raw})) for i, (raw, _) in enumerate(cases)]
    out = validate(spark.createDataFrame(rows, "i int, value string"))
    value = F.col(field).cast("timestamp_ntz") if field == "started_at" else F.col(field)
    got = {r.i: (r.v, r.error) for r in out.select("i", value.alias("v"), "error").collect()}
    for i, (raw, want) in enumerate(cases):
        value, error = got[i]
        if want is None:
            assert error == f"validation error: {field}: type", (raw, value, error)
        else:
            assert (value, error) == (want, None), raw


def _errors(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return [r.error for r in validate(frame).orderBy("i").collect()]


def test_field_rules(spark, event):
    ok, *bad = _errors(
        spark,
        event(unknown=1, tags={}, conversation_id=None),
        event(latency_ms=...),
        event(status="SUCCESS"),
        event(latency_ms=-1),
        event(input_preview="x" * 5000),
        event(tags={f"k{i}": "v" * 200 for i in range(60)}),
        event(tags=None),
        event(pii_redaction_count=None),
        event(schema_version="x"),
    )
    assert ok is None
    assert [b.removeprefix("validation error: ") for b in bad] == [
        "latency_ms: missing", "status: enum", "latency_ms: range", "input_preview: length",
        "tags: size", "tags: type", "pii_redaction_count: type", "schema_version: type",
    ]


def test_map_size_counts_escaped_bytes(spark, event):
    maps = [
        {"k": "é" * 1363}, {"k": "é" * 1364}, {"k": "😀" * 681}, {"k": "😀" * 682}, {"k": "\x7f" * 1364},
        *[{"k": "x" * n, "l": {"a:b": [1, 2]}, "m": '",:'} for n in (8140, 8145, 8146, 8147, 8148, 8150, 8160)],
    ]
    got = _errors(spark, *[event(tags=m) for m in maps])
    want = [len(json.dumps(m)) > 8192 for m in maps]
    assert [e is not None for e in got] == want
    assert True in want[5:] and False in want[5:]


def test_json_must_be_one_object(spark, event):
    good = event()
    got = _errors(spark, good[:-1], good + " x", "[1]", "5", "", good + "}", good + "," + good)
    assert all(e.startswith("validation error: $: ") for e in got)


def test_repeated_key_keeps_the_last(spark, event):
    text = event()[:-1] + ', "latency_ms": 7}'
    row = validate(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.latency_ms, row.error) == (7, None)


def test_processing_errors_and_dead_letters(spark, event):
    texts = [event(latency_ms=2147483648), event(model="a\u0000b"), event(total_tokens=..., prompt_tokens=2147483647),
             '{"this": "is not a valid event"}', "{"]
    letters = check(spark.createDataFrame([(t,) for t in texts], "value string")).dead_letters.collect()
    stages = sorted((r.stage, r.error[:20]) for r in letters)
    assert [s for s, _ in stages] == ["processing"] * 3 + ["validation"] * 2
    assert '{"__unparseable__":"{"}' in [r.data for r in letters]
    assert max(len(r.error) for r in letters) <= 1000


def test_message_content(spark):
    rows = [(" hi ",), ("",), ("  \x1c",), ("x" * 8001,)]
    out = spark.createDataFrame(rows, "c string").select(valid_content(F.col("c")).alias("c")).collect()
    assert [r.c for r in out] == ["hi", None, None, None]


def test_batches_are_accepted_as_a_whole(spark, event):
    def batch(n, bad=False):
        events = [event()] * n + (['{"request_id": "not-a-uuid"}'] if bad else [])
        return '{"events": [' + ",".join(events) + "]}"

    rows = [("good", batch(2)), ("bad", batch(2, True)), ("empty", batch(0)), ("full", batch(500)), ("over", batch(501)), ("text", "x")]
    events = B.explode_envelopes(spark.createDataFrame(rows, "batch_id string, value string"))
    verdicts = {r.batch_id: r.accepted for r in B.judge_batches(events).collect()}
    assert verdicts == {"good": True, "bad": False, "empty": False, "full": True, "over": False, "text": False}
    counts = {r.batch_id: r["count"] for r in B.accepted_events(events).groupBy("batch_id").count().collect()}
    assert counts == {"good": 2, "full": 500}


def test_accepted_batches_are_never_broadcast(spark, event):
    text = '{"events": [' + event() + "]}"
    batch = F.when(F.col("id") < 30, F.format_string("b%d", F.col("id") % 20))  # half of them come twice, ten have no id
    events = B.explode_envelopes(spark.range(40).select(batch.alias("batch_id"), F.lit(text).alias("value")))
    accepted = B.accepted_events(events)
    assert "Broadcast" not in accepted._jdf.queryExecution().executedPlan().toString()
    assert accepted.count() == 30 and accepted.filter("batch_id IS NULL").count() == 0


def test_envelope_files(spark, event, tmp_path):
    (tmp_path / "a.json").write_text('{"events": [' + event() + ",\n" + event() + "]}")
    events = B.explode_envelopes(B.read_envelopes(spark, str(tmp_path)))
    assert [r.pos for r in events.orderBy("pos").collect()] == [0, 1]
